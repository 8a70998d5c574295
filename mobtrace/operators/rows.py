"""Predicates, top-k and existence over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_true(flag: Column) -> Column:
    """Keeps rows whose flag is false or null."""
    return ~F.coalesce(flag, F.lit(False))


def surely_false(flag: Column) -> Column:
    """Keeps rows whose flag is false; null is dropped."""
    return flag != F.lit(True)


def top(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle where it can."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def flag(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with a flag that tells whether ``other`` has the row's key."""
    keys = other.select(F.col(key).alias("__key")).distinct()
    return df.join(keys, F.col(key) == F.col("__key"), "left").withColumn(name, F.col("__key").isNotNull()).drop("__key")


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with its place in an order, from 1; rows are sorted in ranges, and no task holds them all.

    The order must be total.
    """
    from mobtrace.sources.scratch import cut

    rows = cut(df.orderBy(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("__range").agg(F.count("*").alias("__rows"))  # a row for each range
    before = counts.select("__range", (F.sum("__rows").over(Window.orderBy("__range")) - F.col("__rows")).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return rows.withColumn(name, within.cast("long")).join(before, "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def running_sum(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row in a total order; rows are sorted in ranges, and no task holds them all."""
    from mobtrace.sources.scratch import cut

    rows = cut(df.orderBy(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = rows.groupBy("__range").agg(F.sum(value).alias("__sum"))  # a row for each range
    before = sums.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__before"))
    within = F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, within).join(before, "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def around(asked: DataFrame, known: DataFrame, by: str, at: str, width: int = 30 * 86400) -> DataFrame:
    """``asked`` with ``before`` and ``after``: the rows of ``known``, as structs, that are last up to and first behind ``at`` with the same ``by``.

    Both are sorted together, so no pairs are made, and a key's rows are taken by stretches of
    ``width``: within one, two running windows (upwards and downwards) find the neighbours; beyond
    its ends the last and first rows of the stretches around are looked up in a table of these.
    ``known`` has each (``by``, ``at``) once; asked rows without either have no neighbours.
    """
    own, other = F.struct(*asked.columns), F.struct(*known.columns)
    usable = known.filter(F.col(by).isNotNull() & F.col(at).isNotNull())
    none = lambda df, columns: F.lit(None).cast(df.select(F.struct(*columns)).schema[0].dataType)
    q = asked.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(1).alias("__asks"), own.alias("__q"), none(known, known.columns).alias("__v"))
    v = usable.select(F.col(by).alias("__by"), F.col(at).alias("__at"), F.lit(0).alias("__asks"), none(asked, asked.columns).alias("__q"), other.alias("__v"))
    both = q.unionByName(v).withColumn("__part", F.floor(F.col("__at") / width))
    up = Window.partitionBy("__by", "__part").orderBy("__at", "__asks").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("__by", "__part").orderBy(F.desc("__at"), F.desc("__asks")).rowsBetween(Window.unboundedPreceding, 0)
    when = F.when(F.col("__v").isNotNull(), F.col("__at"))
    ends = both.groupBy("__by", "__part").agg(F.min_by("__v", when).alias("__first"), F.max_by("__v", when).alias("__last"))
    earlier = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("__by").orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("__by").alias("__of"), F.col("__part").alias("__in"), F.last("__last", True).over(earlier).alias("__earlier"), F.last("__first", True).over(later).alias("__later"))
    met = both.withColumns({"__before": F.last("__v", True).over(up), "__after": F.last("__v", True).over(down)}).filter("__asks = 1")
    met = met.join(ends, (F.col("__by") == F.col("__of")) & (F.col("__part") == F.col("__in")), "left")
    keyed = F.col("__by").isNotNull() & F.col("__at").isNotNull()
    return met.select("__q.*", F.when(keyed, F.coalesce("__before", "__earlier")).alias("before"), F.when(keyed, F.coalesce("__after", "__later")).alias("after"))


def earlier_is_nearer(at: Column) -> Column:
    """Whether of a row's neighbours, both with a time ``t``, the earlier is as near as the later or nearer."""
    return F.col("before").isNotNull() & (F.col("after").isNull() | (at - F.col("before.t") <= F.col("after.t") - at))
