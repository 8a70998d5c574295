"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are rows x of whole numbers; X holds the centred rows. From a start direction v_1,
each round forms u_k = X v_k - beta_(k-1) u_(k-1), made orthogonal to all earlier u and
scaled to length one by alpha_k, then v_(k+1) = X'u_k - alpha_k v_k, made orthogonal to all
earlier v and scaled by beta_k. The alphas and betas are an upper bidiagonal matrix B; its
small SVD on the driver gives the largest singular values of X and, through the v, their right
vectors: the components. A singular value s has the deviation s / sqrt(n).

A round is one Spark job: each task forms its rows' part of u from its block of rows and at
once its part of X'u; Spark sums these parts by dimension. A vector u is as long as
the table, so it is never gathered or stored: as u_k = X p_k for a short p_k, its rows are made
again wherever they are needed, and a lost executor takes nothing along. The products
of u with all earlier ones are p_j'(X'u), so reorthogonalisation is full on both sides; where it
takes away much of u (more than half its square), X'u is formed again by another job.
The driver holds a few matrices of dimensions by rounds; rounds are at most the dimensions.

Rounds end when the wanted components have residuals below ``TOLERANCE`` times the smallest
gap between their singular values, or all directions are used up. Where alpha or beta vanishes
before that, the next v is a new direction orthogonal to all others, so components of
equal deviation are all found.

Edge cases: rows whose vector is null, or holds null, NaN or infinite entries, take no part and have no
rows in the result; a shorter vector counts as zero in the dimensions that it lacks; where fewer than the wanted
number of components have a deviation (few or equal rows, constant dimensions) only those come
out, for one row none; repeated rows and null or equal ids count each; a deviation
sum beyond a long is null; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobtrace.llm.storage import kept

#: Components that are wanted, whole steps of one unit of an entry and what is added to them.
COMPONENTS, STEPS, SHIFT = 8, 1024, 100_000
#: Residual that ends the rounds, in parts of the smallest gap; deviations below this part of the largest count as none.
TOLERANCE, LEAST = 1e-12, 1e-10
#: Bytes of rows that a task reads at most where there are more than tasks, entries of vectors that a task works on at once.
BYTES_A_TASK, ENTRIES_AT_ONCE = 64_000_000, 1_000_000

Rows = Iterator[pa.RecordBatch]


def whole_numbers(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x: each entry c as floor(STEPS * c) + SHIFT, for the rows whose entries are all finite."""
    finite = F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(finite).select(F.col(key).alias("vec_id"), F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS) + SHIFT).alias("x"))


def blocks(batches: Rows, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some rows at a time and their whole numbers as a matrix."""
    at_once = max(1, ENTRIES_AT_ONCE // max(1, dims))
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            part = batch.slice(at, at_once)
            lists = part.column(part.schema.get_field_index("x"))
            flat, lens = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()
            if len(flat) == len(lens) * dims and (lens == dims).all():
                yield part, flat.reshape(len(lens), dims)
                continue
            x = np.full((len(lens), dims), SHIFT, np.int64)
            row = np.repeat(np.arange(len(lens)), lens)
            x[row, np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
            yield part, x


class Centred:
    """The rows of a written table (vec_id, x), taken as centred vectors."""

    def __init__(self, rows: DataFrame, n: int, sums: np.ndarray):
        self.rows, self.n, self.sums, self.dims = rows, n, sums, len(sums)

    def summed(self, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all blocks of centred rows of what ``part`` makes of a block, entry by entry, summed by Spark."""
        n, sums, dims = self.n, self.sums, self.dims

        def run(batches: Rows) -> Rows:
            total = 0.0
            for _, x in blocks(batches, dims):
                total = total + part((x * n - sums) / n)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["at", "value"])

        found = self.rows.select("x").mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        return np.array([r.value for r in sorted(found)])

    def normal(self, q: np.ndarray) -> np.ndarray:
        """X'(Xq)."""
        return self.summed(lambda x: x.T @ (x @ q))


def orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """``v`` less its parts along ``basis``, twice, as once isn't enough in floating point."""
    if basis:
        b = np.array(basis)
        for _ in range(2):
            v = v - b.T @ (b @ v)
    return v


def bidiagonal(alphas: list[float], betas: list[float]) -> np.ndarray:
    return np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)


def enough(alphas: list[float], betas: list[float], wanted: int) -> bool:
    """Whether the wanted singular values have residuals far below the gaps between them and to the next one."""
    if len(alphas) <= wanted:
        return False
    left, s, _ = np.linalg.svd(bidiagonal(alphas, betas))
    gap = np.min(s[:wanted] - s[1 : wanted + 1])
    return bool(np.all(np.abs(betas[-1] * left[-1, :wanted]) <= TOLERANCE * gap))


def components(x: Centred, wanted: int = COMPONENTS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of the centred rows, a column each, and their singular values, largest first."""
    draw = np.random.default_rng(seed)
    vs: list[np.ndarray] = []
    ps: list[np.ndarray] = []  # u_k = X p_k
    zs: list[np.ndarray] = []  # X'u_k
    alphas: list[float] = []
    betas: list[float] = []
    v = draw.standard_normal(x.dims)
    v /= np.linalg.norm(v)
    while True:
        q = v - betas[-1] * ps[-1] if ps else v
        z = x.normal(q)
        for _ in range(3):
            square = q @ z
            c = np.array(ps) @ z if ps else np.zeros(0)  # products of Xq with all earlier u
            if not len(c) or not square > 0:
                break
            q, z = q - np.array(ps).T @ c, z - np.array(zs).T @ c
            if c @ c <= 0.5 * square:
                break
            z = x.normal(q)
        alpha = float(np.sqrt(max(q @ z, 0.0)))
        none = alpha <= LEAST * max([*alphas, *betas, 0.0]) or alpha == 0
        if none and (not betas or betas[-1] == 0):
            break  # a direction drawn among all that are left has no deviation, so none of them has
        # where X v holds nothing new, u_k is left out: its products with others count as zero
        vs.append(v)
        alphas.append(0.0 if none else alpha)
        ps.append(np.zeros(x.dims) if none else q / alpha)
        zs.append(np.zeros(x.dims) if none else z / alpha)
        if len(vs) == x.dims:
            break
        v = orthogonal(zs[-1] - alphas[-1] * v, vs)
        beta = float(np.linalg.norm(v))
        if none or beta <= LEAST * max(alphas):  # nothing new along this path: go on in a direction not seen yet
            v, beta = orthogonal(draw.standard_normal(x.dims), vs), 0.0
        v /= np.linalg.norm(v)
        betas.append(beta)
        if beta > 0 and enough(alphas, betas, wanted):
            break
    if not alphas:
        return np.zeros((x.dims, 0)), np.zeros(0)
    _, s, right = np.linalg.svd(bidiagonal(alphas, betas))
    return (np.array(vs).T @ right.T)[:, :wanted], s[:wanted]


def centred(rows: DataFrame) -> Centred | None:
    """Counts and sums of all rows; None if there is no entry."""
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims")).first()
    if not shape.n or not shape.dims:
        return None
    entries = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c") - SHIFT).alias("s")).collect()
    sums = np.zeros(shape.dims, np.int64)
    for r in entries:
        sums[r.at] = r.s
    return Centred(rows, shape.n, sums + shape.n * SHIFT)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """Per row and component: n, the row's squared deviation, its whitened value, the component's share of the trace, and the largest entry of the whitened covariance less the identity."""
    kind = dict(df.dtypes)[key]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = df.sparkSession
    rows = kept(whole_numbers(df, key, vector), "whole-numbers")
    x = centred(rows)
    if x is None:
        return spark.createDataFrame([], schema)
    tasks = max(spark.sparkContext.defaultParallelism, -(-x.n * x.dims * 8 // BYTES_A_TASK))
    x.rows = rows.coalesce(tasks)
    vectors, s = components(x, wanted)
    e = s**2 / x.n
    trace = x.summed(lambda c: np.array([(c * c).sum()]))[0] / x.n
    s = s[e > LEAST**2 * e[:1].max(initial=0)]
    if not len(s):
        return spark.createDataFrame([], schema)
    e, to = e[: len(s)], vectors[:, : len(s)] / np.sqrt(e[: len(s)])
    mean = x.summed(lambda c: (c @ to).sum(axis=0)) / x.n
    covariance = x.summed(lambda c: (c @ to - mean).T @ (c @ to - mean)).reshape(len(s), len(s)) / x.n
    error = float(np.abs(covariance - np.eye(len(s))).max())
    n, sums, dims, share = x.n, x.sums, x.dims, e / trace

    def run(batches: Rows) -> Rows:
        k = len(share)
        for part, x in blocks(batches, dims):
            off = x * n - sums
            values = (off / n) @ to
            own = deviations(off)
            m = part.num_rows
            ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            columns = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), own.take(pa.array(np.repeat(np.arange(m), k))), pa.array(values.reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def deviations(off: np.ndarray) -> pa.Array:
    """Exact sums of squares by row; null beyond a long."""
    if off.shape[1] * float(np.abs(off).max(initial=0)) ** 2 < 2**62:
        return pa.array((off * off).sum(axis=1))
    exact = [sum(int(c) ** 2 for c in row) for row in off]
    return pa.array([c if c < 2**63 else None for c in exact], pa.int64())
