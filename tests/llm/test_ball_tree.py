import numpy as np
from pyspark.sql import functions as F

from mobtrace.llm import ball_tree


def test_oracle(spark, medium, against_sql):
    against_sql(spark, "op8_exact_topk", medium)


def brute(rows, queries, k):
    whole = {i: np.floor(256 * np.array(v, float)) for i, v in rows}
    out = []
    for q in queries:
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_many_shards(spark, medium):
    """Cells, shards within cells and blocks give what all pairs give, and vectors apart are not compared."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{medium}/embeddings.parquet").collect()]
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    want = brute(rows, [i for i, _ in rows if i % 50 == 0], 5)
    for shard, block, sample in ((40, 3, 10_000), (100, 1, 60)):
        got = ball_tree.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard, block_queries=block, sample=sample).collect()
        assert sorted(map(tuple, got)) == want


def test_equal_rows(spark):
    """Three rows in four are equal: their cell has shards of bounded size."""
    df = spark.range(4000).selectExpr("id vec_id", "if(id % 4 > 0, array(1D, 2D, 3D), array(id / 4000, id % 7, -1D)) embedding")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = ball_tree.top_k(df, F.col("vec_id") % 500 == 0, shard_rows=200, block_queries=2).collect()
    assert sorted(map(tuple, got)) == brute(rows, range(0, 4000, 500), 5)
    placed = ball_tree.placed(df.selectExpr("vec_id", "embedding vector", "true asks", "vec_id place"), 1000, 200, 4000)
    assert placed.groupBy("cell").count().agg(F.max("count")).first()[0] >= 3000


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    given = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, []), (8, [1.0]), (None, [0.5, 0.5]), (9, [-1.0, -0.01])]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in given], "vec_id long, embedding array<double>, shard string, rank int")
    for rows in (1, 3, 100):
        got = sorted(tuple(r) for r in ball_tree.top_k(df, F.col("vec_id").isin(0, 3, 8), shard_rows=rows, block_queries=1).collect())
        v = lambda x: [int(np.floor(256 * y)) for y in x]
        score = lambda a, b: sum(x * y for x, y in zip(v(a), v(b), strict=True))
        q = [1.0, 0.5]
        assert got == [(0, 1, 1, score(q, [0.5, 0.5])), (0, 2, 2, score(q, [0.5, 0.5])), (0, 3, None, score(q, [0.5, 0.5])), (0, 4, 9, score(q, [-1.0, -0.01]))]
    assert ball_tree.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_tree_prunes():
    rng = np.random.default_rng(5)
    vectors = np.floor(256 * np.concatenate([rng.normal(c, 0.01, (500, 8)) for c in rng.normal(0, 2, (10, 8))]))
    tree, ids = ball_tree.BallTree(vectors), np.arange(5000)
    for q in vectors[::500]:
        bound = tree.bounds(q[None])[0]
        scores = vectors @ q
        assert (bound[0] >= scores.max()) and len(tree.centre) > 50
        got = ball_tree.search(tree, vectors, ids, q, -1, bound, 5, -np.inf)
        want = sorted(((-int(s), i) for i, s in enumerate(scores)))[:5]
        assert got == [(-s, i) for s, i in want]
