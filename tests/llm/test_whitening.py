import numpy as np
import pytest
from pyspark.sql import functions as F

from mobtrace.llm import whitening as w
from mobtrace.llm.queries import QUERIES


def plain(vectors, wanted=8):
    """Whole covariance and its eigenvectors, from the contract."""
    d = max(map(len, vectors))
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in [*v, *[0.0] * (d - len(v))]] for v in vectors])
    n = len(x)
    off = x * n - x.sum(axis=0)
    c = off / n
    e, v = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:wanted]
    order = order[e[order] > 1e-9 * e.max()]
    return n, (off.astype(object) ** 2).sum(axis=1), c @ v[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def compare(spark, vectors, df=None):
    df = df if df is not None else spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    rows = w.whiten(df).collect()
    n, deviation, whitened, explained = plain([np.float32(v) for v in vectors])
    k = len(explained)
    assert len(rows) == n * k and {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error <= 1e-9
    got = np.zeros((n, k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id] and abs(r.explained - explained[r.component - 1]) <= 1e-9 * explained[r.component - 1]
    return got, whitened, explained


def test_equals_eigenvectors_of_the_covariance(spark):
    draw = np.random.default_rng(1)
    got, want, _ = compare(spark, draw.standard_normal((300, 24)) * np.linspace(0.1, 1, 24))
    signs = np.sign((got * want).sum(axis=0))
    assert np.allclose(got * signs, want, atol=1e-8)


def test_rounds_end_early_where_a_few_components_stand_out(spark):
    draw = np.random.default_rng(2)
    vectors = draw.standard_normal((200, 9)) * 2.0 ** -np.arange(9) @ np.linalg.qr(draw.standard_normal((60, 60)))[0][:9] * 50 + draw.standard_normal((200, 60)) * 1e-3
    rounds = []
    normal = w.Centred.normal
    with pytest.MonkeyPatch.context() as m:
        m.setattr(w.Centred, "normal", lambda self, q: rounds.append(1) or normal(self, q))
        got, want, _ = compare(spark, vectors)
    assert len(rounds) < 60
    assert np.allclose(got * np.sign((got * want).sum(axis=0)), want, atol=1e-7)


def test_equal_deviations_are_all_found(spark):
    """A ball in 3 dimensions of 5, and constant ones: any basis of the ball's space will do."""
    vectors = [v for s in (1.0, -1.0) for v in np.eye(5)[:3] * s]
    got, want, explained = compare(spark, vectors)
    assert got.shape[1] == 3 and np.allclose(explained, 1 / 3)
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-9)


def test_rows_that_take_no_part_short_ones_and_other_columns(spark):
    nan, inf = float("nan"), float("inf")
    bad = [None, [1.0, None, 2.0], [nan, 0.0, 0.0], [0.0, inf, 0.0], [0.0, -inf, 1.0]]
    good = [[0.5, -0.25, 1.0], [0.5, -0.25, 1.0], [0.1, 0.2], [], [1.5, 0.0, -0.125], [0.3, 0.9, 0.7]]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("a")).withColumn("n", F.lit(0)).withColumn("component", F.lit(None))
    got, want, _ = compare(spark, good, df)
    assert np.allclose(got * np.sign((got * want).sum(axis=0)), want, atol=1e-9)


def test_tables_without_deviation_give_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5]), (None, [0.5])], [(1, []), (2, [])]):
        assert w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_deviations_beyond_a_long():
    off = np.array([[3_000_000_000, 4], [4_000_000_000, 0], [1, 2]])
    assert w.deviations(off).to_pylist() == [9 * 10**18 + 16, None, 5]


def test_query_over_the_whole_table(spark, medium):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{medium}/embeddings.parquet").collect()}
    got = QUERIES["op13_embedding_whitening"](spark, medium).collect()
    n, deviation, whitened, explained = plain([np.float32(v) for v in rows.values()])
    assert len(got) == 8 * len(rows) and got[0].identity_error <= 1e-9
    at = {k: i for i, k in enumerate(rows)}
    found = np.zeros_like(whitened)
    for r in got:
        found[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[at[r.vec_id]] and abs(r.explained - explained[r.component - 1]) < 1e-9
    assert np.allclose(found * np.sign((found * whitened).sum(axis=0)), whitened, atol=1e-7)
