import re
from collections import defaultdict

import numpy as np
import pandas as pd

from mobtrace.llm import packing


def brute(rows, capacity):
    """Best fit by trying every open bin."""
    key = lambda r: (-r["rest"], *((r[c] is None, r[c] if r[c] is not None else 0) for c in ("doc_id", "cluster", "source", "tie")))
    for r in rows:
        full, rest = divmod(r["length"], capacity)
        r["rest"] = -1 if full and not rest else rest
    bins, out = [], []
    for r in sorted(rows, key=key):
        if r["rest"] < 0:
            continue
        fits = [(capacity - b["used"], i) for i, b in enumerate(bins) if capacity - b["used"] >= r["rest"] and (r["source"] is None or r["source"] not in b["sources"]) and (r["cluster"] is None or r["cluster"] not in b["clusters"])]
        if not fits:
            bins.append({"used": 0, "sources": set(), "clusters": set()})
            fits = [(capacity, len(bins) - 1)]
        i = min(fits)[1]
        out.append((r["doc_id"], r["rest"], i, bins[i]["used"]))
        bins[i]["used"] += r["rest"]
        bins[i]["sources"].add(r["source"])
        bins[i]["clusters"].add(r["cluster"])
    return out


def test_against_all_bins():
    rng = np.random.default_rng(4)
    for n, sources, clusters in ((300, 5, 40), (500, 150, 400), (200, 1, 3)):
        rows = [{"doc_id": int(i), "length": int(rng.integers(0, 90)) if i % 9 else int(rng.integers(0, 400)), "source": f"s{rng.integers(sources)}" if i % 11 else None, "cluster": f"c{rng.integers(clusters)}" if i % 7 else None, "tie": int(i)} for i in range(n)]
        got = packing.pack_shard(pd.DataFrame(rows), 100)
        shared = got[(got.length < 100) | ~got.duplicated("bin", keep=False) & (got.piece < 0)]
        want = {(d, s): (b, p) for d, s, b, p in brute(rows, 100)}
        have = {(r.doc_id, r.length): (r.bin, r.start) for r in shared.itertuples()}
        assert have == want


def checked(rows, texts, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.shard, r.bin].append(r)
    for own in bins.values():
        own.sort(key=lambda r: (r.start, r.length))
        place = 0
        for r in own:
            assert r.start == place
            place += r.length
        assert place <= capacity and all(r.residual == capacity - place for r in own)
        for field in (0, 1):
            values = [texts[r.doc_id][field] for r in own if texts[r.doc_id][field] is not None]
            assert len(values) == len(set(values))
    total = defaultdict(int)
    for r in rows:
        total[r.doc_id] += r.length
    assert total == {d: len(t[2].encode()) for d, t in texts.items()}


def test_whole_table(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    texts = {r.doc_id: (r.source, re.sub(r"\s+", " ", (r.text or "").lower()), r.text or "") for r in docs.collect()}
    rows = packing.pack_texts(docs, shard_rows=300).collect()
    checked(rows, texts, packing.CAPACITY)
    assert len({r.shard for r in rows}) > 1
    checked(packing.pack_texts(docs.orderBy("n_chars").repartition(3), shard_rows=300).collect(), texts, packing.CAPACITY)


def test_equal_rows(spark):
    """Equal rows without id are dealt evenly."""
    df = spark.range(20_000).selectExpr("cast(null as long) doc_id", "'same words' text", "if(id % 4 = 0, concat('s', id), null) source")
    sizes = [r["count"] for r in packing.pack_texts(df, shard_rows=4096).groupBy("shard").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 20_000 and max(sizes) < 1.1 * min(sizes)


def test_edge_cases(spark):
    given = [(1, None, "a"), (2, "", "a"), (3, "x" * 20_000, None), (4, "x" * 8192, "b"), (5, "same", "c"), (5, "same", "c"), (None, "y", "d"), (6, "SAME ", "e")]
    df = spark.createDataFrame([(*r, 9) for r in given], "doc_id long, text string, source string, bin int")
    rows = packing.pack_texts(df).collect()
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in rows) == [(0, 0, 1), (1, 0, 0), (2, 0, 0), (3, 0, 8192), (3, 1, 8192), (3, 2, 3616), (4, 0, 8192), (5, 0, 4), (5, 0, 4), (6, 0, 5)]
    same = [r.bin for r in rows if r.doc_id == 5]
    assert len(set(same)) == 2
    assert packing.pack_texts(df.limit(0)).count() == 0
