from collections import defaultdict

import corpus_pipeline
from mobtrace.llm import langid, odd_sketch, pii
from mobtrace.llm.storage import kept
from test_odd_sketch import brute
from test_packing import checked
from test_pii import brute as spans

import re


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, None, "s", 0), (-2, "12 !!", "en", "s", 5), (None, docs.first().text, "en", None, 1)], docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "personal_data", "packing"]

    first = kept(stages["language"](spark, docs, small), "t")
    model = langid.train(docs.filter(~langid.held_out(docs.doc_id)))
    given = docs.collect()
    named, scores = model.predict([r.text for r in given])
    want = [tuple(r) for r, n, s in zip(given, named, scores, strict=True) if n != "und" and s >= 0.25 + 0.75 * corpus_pipeline.LEAST]
    rows = first.collect()
    assert first.columns == docs.columns and sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert len(want) == len(given) - 2

    second = kept(stages["near_duplicates"](spark, first, small), "t")
    groups = brute([r.doc_id for r in rows], [r.text for r in rows], odd_sketch.USUAL)
    kept_ids = {d for d, _, _, k in groups if k}
    got = second.collect()
    assert second.columns == docs.columns and sorted(r.doc_id for r in got) == sorted(kept_ids)
    assert len(got) < len(rows) and {tuple(r) for r in got} <= {tuple(r) for r in rows}

    third = kept(stages["personal_data"](spark, second, small), "t")
    texts = {r.doc_id: r for r in got}
    out = third.collect()
    changed = 0
    for r in out:
        old = texts[r.doc_id]
        found = spans(old.text)
        if found:
            assert r.text == pii.masked(old.text, found) and r.n_chars == len(r.text)
            changed += 1
        else:
            assert tuple(r) == tuple(old)
    assert third.columns == docs.columns and len(out) == len(got) and changed

    packed = stages["packing"](spark, third, small).collect()
    checked(packed, {r.doc_id: (r.source, re.sub(r"\s+", " ", r.text.lower()), r.text) for r in out}, 8192)


def test_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string"
    rows = [(None, "a b c d e f", "en", "s", 1, "x"), (None, "a b c d e f", "en", "s", 1, "x"), (3, "A b c d e f", "en", "s", 1, "x"), (4, None, None, None, None, None), (4, " ", None, None, None, None), (5, "z y", "en", None, None, "y"), (5, "z y", "en", None, None, "y")]
    df = spark.createDataFrame(rows, schema)
    got = odd_sketch.deduplicated(df).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(3, "A b c d e f"), (4, ""), (4, " "), (5, "z y")]
    docs = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, ""), "t")
    assert docs.count() == 0


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small).collect()
    sizes = defaultdict(int)
    for r in out:
        sizes[r.shard, r.bin] += r.length
    assert out and max(sizes.values()) <= 8192
