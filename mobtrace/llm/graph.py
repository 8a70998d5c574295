"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobtrace.llm.storage import kept


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); label is the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours and then the label
    of its label, so paths halve. Sums before shuffles and plain joins only: a node
    with very many links is split by the adaptive skew join.
    """
    edges = kept(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = kept(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("lower"))
        over = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        step = step.join(over, F.col("lower") == F.col("via")).select("node", "label", F.least("lower", "beyond").alias("lower"))
        step = kept(step, "labels")
        labels = step.select("node", F.col("lower").alias("label"))
        if step.filter("lower < label").isEmpty():
            return labels
