"""Exact top-k by inner product: ball trees per shard, searched by branch and bound.

Vectors are dealt to cells of space: halving a bounded sample of them again and again gives
a small tree of planes, along which every row finds its cell; a cell of many rows has
several shards. Each shard's ball tree is built once and kept as a row of a table. A query's
upper bound for a ball is ``q.centre + |q| * radius``. In a first round every query meets the
cell of its greatest bound, which gives it a kth score; in further rounds it meets, greatest
bounds first, those cells whose bound reaches the kth score found so far, twice as many each
round, and within a shard's tree nodes are visited in the order of their bounds and left out
in the same way. Cells that a query can't use are never joined to it, and a shard is copied
only for further blocks of many queries. What comes to the driver is bounded: the sample,
and a ball for each of ``CELLS`` cells of vectors of one length.

Components x become floor(256 * x). Edge cases: vectors that are null or hold null or
non-finite components take no part, on either side; candidates of another length than
the query are left out for it; a query is not its own candidate, nor is any row with its
id; rows without id are candidates that lose ties, and never queries; repeated rows are
candidates each; query rows of one id share one ranking, over all their vectors; scores are
exact while products and sums stay below 2**53; fewer than k candidates give fewer ranks.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from mobtrace.llm.storage import kept

LEAF = 64
#: Stands for a missing id, and so comes last among equals.
NO_ID = 2**63 - 1
#: Rows of a shard and queries of a block: what one task holds.
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
#: Rows of the sample that space is cut by, and cells at most; beyond these, cells have more shards.
SAMPLE, CELLS = 10_000, 512


class BallTree:
    """Nodes as arrays: centre, radius, children (-1 in leaves) and the rows of a leaf as a range of ``order``."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.arange(len(vectors))
        self.centre, self.radius, self.child, self.range = [], [], [], []
        waiting = [(0, len(vectors), -1, 0)]
        while waiting:
            start, end, parent, side = waiting.pop()
            own = self.order[start:end]
            points = vectors[own]
            centre = points.mean(axis=0)
            away = np.sqrt(((points - centre) ** 2).sum(axis=1))
            node = len(self.centre)
            self.centre.append(centre)
            self.radius.append(away.max())
            self.child.append([-1, -1])
            self.range.append((start, end))
            if parent >= 0:
                self.child[parent][side] = node
            if end - start > LEAF and away.max() > 0:
                first = points[away.argmax()]
                second = points[((points - first) ** 2).sum(axis=1).argmax()]
                middle = start + (end - start) // 2
                by = np.argsort(points @ (second - first), kind="stable")
                self.order[start:end] = own[by]
                waiting += [(middle, end, node, 1), (start, middle, node, 0)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, a number that no inner product with a vector of the node exceeds."""
        size = np.sqrt((queries**2).sum(axis=1))
        top = queries @ self.centre.T + size[:, None] * self.radius
        return top + 1e-6 * np.abs(top) + 1e-3


def search(tree: BallTree, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, bound: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
    """The k best (score, id), of those that score ``least`` at least; smaller ids first among equals."""
    best: list[tuple[int, int]] = []
    waiting = [(-bound[0], 0)]
    while waiting:
        top, node = heapq.heappop(waiting)
        if -top < least:
            break
        left, right = tree.child[node]
        if left >= 0:
            heapq.heappush(waiting, (-bound[left], left))
            heapq.heappush(waiting, (-bound[right], right))
            continue
        rows = tree.order[slice(*tree.range[node])]
        scores = vectors[rows] @ query
        some = np.flatnonzero((scores >= least) & (ids[rows] != query_id))
        if len(some):
            best += [(int(scores[i]), int(ids[rows[i]])) for i in some]
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[k:]
            if len(best) == k:
                least = max(least, best[-1][0])
    return best


def whole(vector: Column) -> Column:
    """floor(256 * x) of every component as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: bad(x.cast("double")))


class Planes:
    """A binary tree of planes, by halving a sample along its spread; gives each vector its cell."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.planes: list[tuple[np.ndarray, float, int, int]] = []  # direction, offset, left, right; a cell c is -1 - c
        self.cells = 0
        self.root = self._cut(sample, cells)

    def _cut(self, own: np.ndarray, cells: int) -> int:
        away = ((own - own.mean(axis=0)) ** 2).sum(axis=1) if len(own) else np.zeros(1)
        if cells < 2 or len(own) < 2 or away.max() == 0:
            self.cells += 1
            return -self.cells
        first = own[away.argmax()]
        second = own[((own - first) ** 2).sum(axis=1).argmax()]
        along = own @ (second - first)
        middle = float(np.median(along))
        left = along < middle
        if not left.any():
            left = along <= middle
        at = len(self.planes)
        self.planes.append((second - first, middle, 0, 0))
        a = self._cut(own[left], cells // 2)
        b = self._cut(own[~left], cells - cells // 2)
        self.planes[at] = (second - first, middle, a, b)
        return at

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int64)
        waiting = [(self.root, np.arange(len(vectors)))]
        while waiting:
            node, rows = waiting.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                direction, middle, a, b = self.planes[node]
                left = vectors[rows] @ direction < middle
                waiting += [(a, rows[left]), (b, rows[~left])]
        return out


def placed(rows: DataFrame, sample_rows: int, shard_rows: int, n: int) -> DataFrame:
    """``rows`` with ``cell``: the cell of space, by the vectors' length and the planes of a sample."""
    sample = rows.filter(F.pmod(F.xxhash64("place"), F.lit(1_000_000)) < 1_000_000 * min(1.0, sample_rows / max(1, n))).select("vector").limit(2 * sample_rows).toPandas()
    by_length: dict[int, Planes] = {}
    for length, own in sample.groupby(sample.vector.map(len)):
        by_length[int(length)] = Planes(np.stack(own.vector.to_numpy()), min(CELLS, -(-n // shard_rows)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch.vector.map(len).to_numpy()
            cell = np.zeros(len(batch), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                if int(size) in by_length:
                    cell[at] = by_length[int(size)].cell(np.stack(batch.vector.iloc[at].to_numpy()))
            yield batch.assign(cell=cell * 100_000 + np.minimum(length, 99_999))

    return rows.mapInPandas(run, "vec_id long, vector array<double>, asks boolean, place long, cell long")


TREE = "cell long, shard long, length int, centre array<double>, radius double, ids binary, kind string, vectors binary, tree binary"


def trees(rows: DataFrame) -> DataFrame:
    """One row for each shard and length of vectors: its ball, its vectors and its tree."""

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for length, some in own.groupby(own.vector.map(len)):
            vectors = np.stack(some.vector.to_numpy())
            tree = BallTree(vectors)
            kind = "<i2" if np.abs(vectors).max() < 2**15 else "<f8"
            out.append((*key, int(length), tree.centre[0].tolist(), float(tree.radius[0]), some.vec_id.to_numpy("int64").tobytes(), kind, vectors.astype(kind).tobytes(), pickle.dumps(tree)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TREE.split(", ")])

    return rows.groupBy("cell", "shard").applyInPandas(run, TREE)


def cell_balls(base: DataFrame) -> DataFrame:
    """A ball around the balls of each cell's shards."""

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        centres = np.stack(own.centre.to_numpy())
        centre = centres.mean(axis=0)
        radius = float((np.sqrt(((centres - centre) ** 2).sum(axis=1)) + own.radius.to_numpy()).max())
        return pd.DataFrame([(*key, centre.tolist(), radius)], columns=["cell", "length", "centre", "radius"])

    return base.select("cell", "length", "centre", "radius").groupBy("cell", "length").applyInPandas(run, "cell long, length int, centre array<double>, radius double")


def _group(k: int):
    def run(key: tuple, shards: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        for row in shards.itertuples() if len(asked) else ():
            vectors = np.frombuffer(row.vectors, row.kind).astype(float).reshape(-1, row.length)
            ids, tree = np.frombuffer(row.ids, np.int64), pickle.loads(row.tree)  # noqa: S301 - written by this module
            q = np.stack(asked["query"].to_numpy())
            bounds = tree.bounds(q)
            for i, (query_id, least) in enumerate(zip(asked.query_id.to_numpy("int64"), asked.least.fillna(-np.inf).to_numpy("float64"), strict=True)):
                found += [(query_id, vec_id, score) for score, vec_id in search(tree, vectors, ids, q[i], query_id, bounds[i], k, least)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return run


def _best(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _reach(balls: pd.DataFrame):
    """For each query the cells of its length with their upper bounds, best first; ``balls`` is a row for each cell."""
    by_length = {int(n): (own.cell.to_numpy(), np.stack(own.centre.to_numpy()), own.radius.to_numpy()) for n, own in balls.groupby("length")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                rows = []
                for q in some["query"]:
                    cells, centre, radius = by_length.get(len(q), (np.zeros(0, int), np.zeros((0, len(q))), np.zeros(0)))
                    top = centre @ q + np.sqrt((q**2).sum()) * radius
                    top = top + 1e-6 * np.abs(top) + 1e-3
                    order = np.argsort(-top, kind="stable")
                    rows.append([{"cell": int(cells[i]), "bound": float(top[i])} for i in order])
                yield some.assign(reach=rows)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query row."""
    spark = vectors.sparkSession
    rows = vectors.filter(usable(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), whole(F.col(vector)).alias("vector"), is_query.alias("asks"))
    rows = kept(rows.withColumn("place", F.monotonically_increasing_id()), "vectors")
    n = rows.count()
    cells = kept(placed(rows, sample, shard_rows, n), "cells")
    # a cell of more rows than a shard has is dealt further by the rows' places
    sizes = kept(cells.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).alias("shards")), "cell-sizes")
    dealt = cells.join(sizes, "cell").withColumn("shard", F.pmod(F.xxhash64("place"), F.col("shards")))
    base = kept(trees(dealt.select("cell", "shard", F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "vector")), "trees")
    balls = cell_balls(base).toPandas()
    most = int(balls.groupby("length").size().max()) if len(balls) else 0
    asked = cells.filter("asks and vec_id is not null").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")).dropDuplicates(["query_id", "query"])
    schema = "query_id long, query array<double>, reach array<struct<cell:long,bound:double>>"
    asked = kept(asked.mapInPandas(_reach(balls), schema).withColumn("place", F.monotonically_increasing_id()), "asked")
    found, result, at, step = None, "query_id long, vec_id long, score long", 0, 1
    while at < most:
        rows = asked.select("query_id", "query", "place", F.slice("reach", at + 1, step).alias("reach"))
        if found is None:
            rows = rows.withColumn("least", F.lit(None).cast("double"))
        else:  # the kth score so far holds only where k rows were found
            kth = found.groupBy("query_id").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n")).filter(F.col("n") >= k).drop("n")
            rows = rows.join(kth, "query_id", "left")
        rows = rows.select("query_id", "query", "place", "least", F.explode("reach").alias("r")).filter("least is null or r.bound >= least")
        rows = rows.select("query_id", "query", "place", "least", F.col("r.cell").alias("cell")).join(sizes, "cell")
        rows = kept(rows.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards"), "meets")
        if rows.isEmpty():  # bounds fall from round to round
            break
        counts = kept(rows.groupBy("cell", "shard").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("blocks")), "blocks")
        left = rows.join(counts, ["cell", "shard"]).withColumn("block", F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int")).drop("blocks", "place")
        right = base.join(counts, ["cell", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        by = ["cell", "shard", "block"]
        new = right.groupBy(*by).cogroup(left.groupBy(*by)).applyInPandas(_group(k), result)
        best = _best(new if found is None else found.unionByName(new), k).select("query_id", "vec_id", "score")
        found = kept(best, "found")
        at, step = at + step, step * 2 if at else 3
    if found is None:
        found = spark.createDataFrame([], result)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
