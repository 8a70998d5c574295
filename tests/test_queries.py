"""Every registered query with SQL gives the same rows as DuckDB; the others run and give rows."""

import math

import duckdb
import pytest

from mobtrace.fixtures import TABLES
from mobtrace.plans import registry

registry.load()
#: Tested in test_jobs.py; running them twice would be slow.
SLOW = {"M13_oversampled", "M14_coefficients", "M15_cross_validation", "M15_hold_out", "M21_predictions", "M9_topics", "M10_factor_topics", "M22_place_embeddings", "M8_variants", "C7_topics_of_category", "T5_topic_words"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return repr(v)


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query(spark, small, tables, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    assert len(set(columns)) == len(columns)
    if name not in registry.ORACLES:
        assert got
        return
    want = tables.execute(registry.ORACLES[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == columns
    assert sorted(([plain(r[names.index(c)]) for c in columns] for r in want.fetchall()), key=repr) == got


def test_venues_with_n_tips(spark, small, medium, tmp_path):
    """The query's n comes from the tips, so tables of any size give venues; a given n is honoured."""
    f = registry.QUERIES["A8_venues_with_n_tips"]
    assert [sorted(tuple(r) for r in f(spark, d).collect()) for d in (small, medium)] == [[(v, n) for v in range(40)] for n in (5, 25)]
    times = {1: 3, 2: 2, 3: 4, 7: 2, 9: 3, 39: 40}
    tips = [(v + 40 * i, ("de", "en", None)[i % 3], "a") for v, n in times.items() for i in range(n)]
    schema = "doc_id long, lang string, text string"
    for name, rows, least in (("odd", tips, {(2, 2), (7, 2)}), ("null", [*tips, (None, "de", None)], {(None, 1)}), ("none", [], set())):
        d = str(tmp_path / name)
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
        want = con.execute(registry.ORACLES["A8_venues_with_n_tips"]).fetchall()
        assert {tuple(r) for r in f(spark, d).collect()} == set(want) == least
    for n in (1, 2, 3, 4, 40):
        assert {tuple(r) for r in f(spark, str(tmp_path / "odd"), n).collect()} == {(v, k) for v, k in times.items() if k == n}


def test_tag_vectors_bit_by_bit(spark, tmp_path):
    """Small negative numbers become a zero with a sign, and products that are halves are rounded away from zero, as in SQL."""
    numbers = [-1e-7, 1e-7, -4.9e-7, 5.1e-7, -0.0, 0.0, 0.0078125, -0.0078125, 1.25, -3.5e-6, None, float("inf"), float("nan"), *((k + 0.5) / 1e6 for k in range(1, 400_000, 997))]
    d = str(tmp_path / "ties")
    spark.createDataFrame([(1, numbers, 2), (3, [], 1), (4, None, 0), (6, [0.5], None)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{d}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["M4_tag_vectors"]).fetchall()
    got = registry.QUERIES["M4_tag_vectors"](spark, d).select("pi_id", "word_id", "vector").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
