"""Edits of tables as set-based jobs: upserts, partial updates, erasure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobtrace.operators import rows

Rule = Mapping[str, str]
#: Ids of places that edits add begin here, by the edit's id or by the venue's.
NEW_PLACE, NEW_VENUE = 1_000_000_000, 2_000_000_000


def latest(edits: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last edit of each key."""
    rest = [c for c in edits.columns if c not in keys]
    best = edits.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: Rule) -> DataFrame:
    """``old`` with the rows of ``new``, one for each key.

    A column's rule says what holds where both have the key: ``new`` or ``old`` value,
    the ``greatest``, ``filled`` (new unless null), or ``united`` arrays. Rerunning with
    the same rows changes nothing.
    """
    right = new.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"__{c}") for c in old.columns if c not in keys], F.lit(True).alias("__new"))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    both = old.withColumn("__old", F.lit(True)).join(right, on, "full")

    def value(c: str) -> Column:
        a, b = F.col(c), F.col(f"__{c}")
        met = {"new": b, "old": a, "greatest": F.greatest(a, b), "filled": F.coalesce(b, a), "united": F.array_union(a, b)}[rules.get(c, "old")]
        return F.when(F.col("__old").isNull(), b).when(F.col("__new").isNull(), a).otherwise(met).alias(c)

    picked = [F.when(F.col("__old").isNull(), F.col(f"__k{list(keys).index(c)}")).otherwise(F.col(c)).alias(c) if c in keys else value(c) for c in old.columns]
    return both.select(*picked)


def partial_update(old: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Columns of ``edits`` replace those of ``old`` where they aren't null; keys without a row are ignored."""
    changed = [c for c in edits.columns if c != key]
    right = edits.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in changed])
    both = old.join(right, F.col(key) == F.col("__key"), "left")
    return both.select(*[F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in old.columns])


def erase(tables: Mapping[str, DataFrame], users: DataFrame, columns: Mapping[str, str]) -> dict[str, DataFrame]:
    """Every table without the rows of the given users; ``columns`` names each table's user column."""
    out = {}
    for name, df in tables.items():
        gone = users.select(F.col("user_id").alias("__gone")).distinct()
        out[name] = df.join(gone, F.col(columns[name]) == F.col("__gone"), "left_anti")
    return out


def without_orphans(places: DataFrame, visits: DataFrame, removed: DataFrame) -> DataFrame:
    """``places`` without those whose only visit is among the removed ones; a place without visits stays."""
    gone = removed.select("visit_id").distinct().withColumn("__gone", F.lit(1))
    left = visits.join(gone, "visit_id", "left").groupBy("place_id").agg(F.count("*").alias("n"), F.count("__gone").alias("g"))
    orphan = left.filter((F.col("n") == F.col("g")) & (F.col("n") == 1)).select("place_id")
    return places.join(orphan, "place_id", "left_anti")


def offsets_at(asked: DataFrame, visits: DataFrame) -> DataFrame:
    """``asked`` (id, user_id, t) with ``offset``: that of the user's visit whose arrival is nearest in time.

    Instants and arrivals are sorted together for each user, so no pairs are made. Of two as near the earlier counts.
    """
    v = visits.groupBy("user_id", F.col("arrival").alias("t")).agg(F.min_by("utc_offset", "visit_id").cast("long").alias("offset"))
    near = rows.around(asked, v, "user_id", "t").filter("before is not null or after is not null")
    return near.select(*asked.columns, F.when(rows.earlier_is_nearer(F.col("t")), F.col("before.offset")).otherwise(F.col("after.offset")).alias("offset"))


def routed_places(edits: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits with place_id and branch, places): where each edit (id, user_id, new_place, new_venue, name, old_place) leads.

    A new venue leads to the user's place of that venue, which is added where there is none;
    a new place to that place; otherwise the name makes a place of its own, or, where the old
    place isn't a venue's, renames it. The last name given to a place holds.
    """
    known = places.select("user_id", F.col("venue_id").alias("new_venue"), F.col("place_id").alias("of_venue")).filter("new_venue is not null")
    old = places.select("user_id", F.col("place_id").alias("old_place"), F.col("venue_id").alias("old_venue"), F.col("name").alias("old_name"))
    e = edits.join(known, ["user_id", "new_venue"], "left").join(old, ["user_id", "old_place"], "left")
    same = F.col("old_name") == F.col("name")
    custom = F.col("old_place").isNull() | F.col("old_venue").isNotNull()
    branch = F.when(same, "same").when(F.col("new_venue").isNotNull(), "venue").when(F.col("new_place").isNotNull(), "place").when(custom, "custom").otherwise("renamed")
    to = F.when(branch.isin("same", "renamed"), F.col("old_place")).when(branch == "venue", F.coalesce("of_venue", F.lit(NEW_VENUE) + F.col("new_venue"))).when(branch == "place", F.col("new_place")).otherwise(F.lit(NEW_PLACE) + F.col("id"))
    e = e.withColumns({"branch": branch, "place_id": to})
    added = e.filter("branch = 'custom' or (branch = 'venue' and of_venue is null)").select("user_id", "place_id", F.when(F.col("branch") == "venue", F.concat(F.lit("venue "), "new_venue")).otherwise(F.col("name")).alias("name"), F.when(F.col("branch") == "venue", F.col("new_venue")).alias("venue_id")).dropDuplicates(["user_id", "place_id"])
    names = e.filter("branch = 'renamed'").groupBy("user_id", "place_id").agg(F.max_by("name", "id").alias("__name"))
    after = places.select("user_id", "place_id", "name", "venue_id").unionByName(added).join(names, ["user_id", "place_id"], "left").withColumn("name", F.coalesce("__name", "name")).drop("__name")
    return e, after
