"""Category trees given as (category_id, parent_id, name) edges, and trees of cells over points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobtrace.functions import geo
from mobtrace.sources.scratch import cut


def paths(edges: DataFrame, root: str = "") -> DataFrame:
    """category_id, and the ids and names from the root down to it, level by level to the last one.

    Edges that don't hang on the root, cycles among them, have no path.
    """
    own = edges.select("category_id", "parent_id", "name")
    level = own.filter(F.col("parent_id") == root).select("category_id", F.array("category_id").alias("ids"), F.array("name").alias("names"))
    out = level = cut(level, "level")
    child = own.select(F.col("category_id").alias("child"), "parent_id", F.col("name").alias("child_name"))
    while True:
        level = level.join(child, F.col("category_id") == F.col("parent_id")).filter(~F.array_contains("ids", F.col("child")))
        level = level.select(F.col("child").alias("category_id"), F.array_append("ids", F.col("child")).alias("ids"), F.array_append("names", F.col("child_name")).alias("names"))
        level = cut(level, "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def split_cells(codes: np.ndarray, n: np.ndarray, most: int, deepest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Cells of sorted codes with counts, a depth at a time: depth, prefixes, counts, whether a cell and its parent may hold codes beyond these.

    A cell may hold others if the first or the last code lies in it; such cells are all
    given, as their counts are only parts. Of the others those that aren't split are given;
    their parents are split, or may hold others.
    """
    active = np.arange(len(codes))
    for depth in range(deepest + 1):
        shift = 2 * (deepest - depth)
        prefix = codes[active] >> shift
        starts = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
        cells, counts = prefix[starts], np.add.reduceat(n[active], starts)
        edge = (cells == codes[0] >> shift) | (cells == codes[-1] >> shift)
        parent = (cells >> 2 == codes[0] >> shift + 2) | (cells >> 2 == codes[-1] >> shift + 2)
        ended = ~edge & ((counts < most) | (depth == deepest))
        yield depth, cells[edge | ended], counts[edge | ended], edge[edge | ended], parent[edge | ended]
        active = active[np.repeat(~ended, np.diff(np.r_[starts, len(active)]))]
        if not len(active):
            return


def adaptive_cells(points: DataFrame, x: Column, y: Column, most: int, deepest: int = 30) -> DataFrame:
    """(depth, cx, cy, n) of the cells of the unit square that hold fewer than ``most`` points, split in four from the whole square on.

    A cell at depth ``deepest`` (about 4 cm of the equator at 30) is not split, however many
    points it holds. Points of equal codes are counted first, so a hot spot is one row; codes
    are then dealt by ranges, and a task counts its cells from its sorted codes (16 bytes a
    distinct code). Only cells that reach over a task's range, at most two a depth, are summed
    afterwards, and decide about the cells right below them. x and y of 1 count to the last
    cell; a point without x or y, or outside the square, is in none.
    """
    side = 1 << deepest
    at = lambda v: F.least(F.floor(v.cast("double") * side), F.lit(side - 1))
    inside = points.filter(x.between(0, 1) & y.between(0, 1))
    codes = inside.select(geo.interleaved(at(x), at(y)).alias("code")).groupBy("code").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            code, n = (np.concatenate(c) for c in zip(*held, strict=True))
            for depth, *found in split_cells(code, n, most, deepest):
                arrays = [pa.array(np.full(len(found[0]), depth, dtype=np.int64)), *(pa.array(c) for c in found)]
                yield pa.RecordBatch.from_arrays(arrays, names=["depth", "cell", "n", "edge", "below_edge"])

    ranged = codes.repartitionByRange("code").sortWithinPartitions("code")
    cells = cut(ranged.mapInArrow(run, "depth long, cell long, n long, edge boolean, below_edge boolean"), "cells")
    edges = cells.filter("edge").groupBy("depth", "cell").agg(F.sum("n").alias("n"))
    split = edges.filter(F.col("n") >= most).select((F.col("depth") + 1).alias("depth"), F.col("cell").alias("parent"))
    sure = cells.filter("not edge and not below_edge").select("depth", "cell", "n")
    asked = cells.filter("not edge and below_edge").select("depth", "cell", "n").unionByName(edges.filter((F.col("n") < most) | (F.col("depth") == deepest)))
    below = asked.withColumn("parent", F.shiftright("cell", 2)).join(split, ["depth", "parent"], "left_semi").select("depth", "cell", "n")
    whole = asked.filter("depth = 0").select("depth", "cell", "n")
    return sure.unionByName(below).unionByName(whole).select("depth", geo.every_second_bit(F.shiftright("cell", 1)).alias("cx"), geo.every_second_bit(F.col("cell")).alias("cy"), "n")
