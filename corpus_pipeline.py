"""A corpus pipeline over ``documents``: language, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its
result is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.

Rows with null or blank text leave at the first stage. Rows without ``doc_id`` and
repeated rows are documents like others: of each group of near-duplicates one row stays.
Extra columns of the table are carried along; an empty table gives an empty packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobtrace.llm import langid, odd_sketch, packing, pii
from mobtrace.llm.storage import free_name, kept

#: How far the best language must be from an even guess (0) towards certainty (1), however many languages there are.
LEAST = 0.05


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language can't be told."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    return langid.recognised(docs, model, LEAST)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return odd_sketch.deduplicated(docs, odd_sketch.USUAL)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; ``n_chars`` follows where a text has changed."""
    new = free_name(docs, "masked")
    masked = pii.redact(docs.withColumn(new, F.col("text")), new)
    changed = ~F.col(new).eqNullSafe(F.col("text"))
    masked = masked.withColumn("n_chars", F.when(changed, F.length(new).cast("long")).otherwise(F.col("n_chars")))
    return masked.withColumn("text", F.col(new)).select(*docs.columns)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into bins: a row for each piece, with its shard, bin and place."""
    return packing.pack_texts(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", bins)]

#: None of the stages can be put in SQL as a whole; the tests compare each with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
