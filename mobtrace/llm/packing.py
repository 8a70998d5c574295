"""Best-fit packing of documents into bins of fixed capacity, under conflict constraints.

No bin holds two documents of one source, nor two of one cluster of duplicates. Rows are
written with their place in the table and dealt to shards by a hash of it, so that shards
are of even size whatever the rows hold, and each shard is packed by itself, longest piece first:
open bins are ordered by residual capacity and carry bitmaps of their sources and
clusters; from the smallest residual that is large enough the search goes on to the next
until the tightest compatible bin is found, and a new bin is opened if there is none.
A text longer than a bin fills whole bins of its own; its rest is packed like others.

Edge cases: null lengths count as 0, and rows of length 0 take a place in a bin like
others; a null source or cluster conflicts with nothing; ties in length are broken by
id, cluster, source and the row's place; repeated rows are packed each, also where all rows
are equal; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobtrace.llm.storage import kept

#: Capacity of a bin, and rows that a shard has on average: a task holds one shard.
CAPACITY, SHARD_ROWS = 8192, 4096
SCHEMA = "doc_id long, piece int, length long, shard long, bin int, start long, residual long"


class Bins:
    """Open bins in the order of their residual capacity, with a bit for every source and cluster."""

    def __init__(self, capacity: int, sources: int, clusters: int, most: int):
        self.capacity = capacity
        self.keys: list[tuple[int, int]] = []  # (residual, bin), in order
        self.ids = np.zeros(0, np.int64)
        self.bits = [np.zeros((max(1, most), 1 + n // 64), np.uint64) for n in (sources, clusters)]
        self.n = 0

    def place(self, length: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin and the residual that it is left with; source and cluster are -1 for none."""
        asked = [(b, x // 64, np.uint64(1 << (x % 64))) for b, x in zip(self.bits, (source, cluster), strict=True) if x >= 0]
        at, step = bisect.bisect_left(self.keys, (length, -1)), 16
        found = -1
        while at < len(self.keys) and found < 0:
            ids = self.ids[at : at + step]
            clash = np.zeros(len(ids), bool)
            for bits, word, bit in asked:
                clash |= (bits[ids, word] & bit) != 0
            free = np.flatnonzero(~clash)
            if len(free):
                found = at + int(free[0])
            at, step = at + step, step * 4
        if found < 0:
            own, residual = self.n, self.capacity
            self.n += 1
        else:
            residual, own = self.keys.pop(found)
            self.ids = np.delete(self.ids, found)
        for bits, word, bit in asked:
            bits[own, word] |= bit
        left = residual - length
        spot = bisect.bisect_left(self.keys, (left, own))
        self.keys.insert(spot, (left, own))
        self.ids = np.insert(self.ids, spot, own)
        return own, left


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Rows (doc_id, length, source, cluster, tie) of one shard, with their bins; a row for each piece."""
    full = rows.length.to_numpy("int64") // capacity
    rest = rows.length.to_numpy("int64") % capacity
    # rows of whole bins only have no rest to pack
    rows = rows.assign(rest=np.where((rest == 0) & (full > 0), -1, rest), full=full)
    rows = rows.sort_values(["rest", "doc_id", "cluster", "source", "tie"], ascending=[False, True, True, True, True], kind="stable", na_position="last")
    source, cluster = (pd.factorize(rows[c])[0] for c in ("source", "cluster"))
    # a cluster with one row in the shard can't conflict
    counts = np.bincount(cluster[cluster >= 0], minlength=1)
    again = np.where((cluster >= 0) & (counts[cluster] > 1), cluster, -1)
    cluster = pd.factorize(np.where(again < 0, None, again))[0]
    bins = Bins(capacity, int(source.max(initial=-1)) + 1, int(cluster.max(initial=-1)) + 1, len(rows))
    out = []
    whole = 0
    for i, (doc_id, left, n) in enumerate(zip(rows.doc_id.tolist(), rows.rest.tolist(), rows.full.tolist(), strict=True)):
        for piece in range(n):
            out.append((doc_id, piece, capacity, -1 - whole, 0, 0))
            whole += 1
        if left >= 0:
            own, residual = bins.place(left, int(source[i]), int(cluster[i]))
            out.append((doc_id, n, left, own, capacity - residual - left, residual))
    out = pd.DataFrame(out, columns=["doc_id", "piece", "length", "bin", "start", "residual"])
    # bins that one document fills come after the shared ones
    out["bin"] = np.where(out.bin < 0, bins.n - 1 - out.bin, out.bin)
    last = out.groupby("bin").residual.transform("min")
    return out.assign(residual=last)


def pack(docs: DataFrame, length: Column, cluster: Column, source: Column | None = None, key: str = "doc_id", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each piece of each row: doc_id, piece, length, shard, bin, start within the bin, residual of the full bin."""
    source = F.col("source") if source is None else source
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(length.cast("long"), F.lit(0)).alias("length"), source.cast("string").alias("source"), cluster.cast("string").alias("cluster"))
    rows = kept(rows.withColumn("tie", F.monotonically_increasing_id()), "lengths")
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("tie"), F.lit(shards)))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(group, capacity).assign(shard=int(key[0]))
        return out[["doc_id", "piece", "length", "shard", "bin", "start", "residual"]]

    return rows.groupBy("shard").applyInPandas(run, SCHEMA)


def pack_texts(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Packs texts by their UTF-8 bytes; copies with equal words, whatever case and white space, are one cluster."""
    text = F.coalesce(F.col("text"), F.lit(""))
    same = F.md5(F.regexp_replace(F.lower(text), r"\s+", " "))
    return pack(docs, F.octet_length(text), same, capacity=capacity, shard_rows=shard_rows)
