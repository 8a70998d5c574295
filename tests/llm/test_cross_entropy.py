import math
import re
from collections import Counter

import pytest

from mobtrace.llm import cross_entropy as ce
from mobtrace.llm.queries import QUERIES
from mobtrace.llm.words import LOWER


def brute(rows, targets, size):
    """Plain counts; ties of the vocabulary's last place are broken as the operator does, by key."""
    split = lambda t: re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    words = Counter(w for _, t in rows for w in split(t))
    key = lambda w: int(ce.word_keys(w.encode().translate(LOWER)).view("int64")[0])
    known = {w for w, _ in sorted(words.items(), key=lambda x: (-x[1], key(x[0])))[: size - 1]}
    def counts(texts):
        pairs = Counter()
        for t in texts:
            w = [None] + [x if x in known else None for x in split(t)]
            pairs.update(zip(w, w[1:]))
        first, second = Counter(), Counter()
        for (a, b), n in pairs.items():
            first[a] += n
            second[b] += n
        return pairs, first, second, sum(pairs.values())

    every, own = counts(t for _, t in rows), counts(t for i, t in rows if i in targets)
    out = {}
    for i, t in rows:
        mine = counts([t])
        w = [None] + [x if x in known else None for x in split(t)]
        n_target = own[3] - (mine[3] if i in targets else 0)
        losses = []
        for (p, f, s, total), less, r in ((own, i in targets, 1), (every, True, n_target / max(1, every[3] - mine[3]))):
            loss = 0
            for a, b in zip(w, w[1:]):
                pair, first, second = (r * (x[k] - (m[k] if less else 0)) for x, m, k in ((p, mine[0], (a, b)), (f, mine[1], a), (s, mine[2], b)))
                loss -= math.log((pair + ce.WEIGHT * (second + 1) / (n_target + size)) / (first + ce.WEIGHT))
            losses.append(loss / mine[3] if mine[3] else None)
        out[i] = (mine[3], *losses)
    return out


def same(got, want):
    for r in got:
        n, a, b = want[r.doc_id]
        assert r.n_words == n
        if n:
            assert r.ce_target == pytest.approx(a, abs=1e-4) and r.ce_background == pytest.approx(b, abs=1e-4)
            assert r.ce_difference == pytest.approx(a - b, abs=2e-4)
        else:
            assert r.ce_target is None and r.ce_background is None and r.ce_difference is None


def test_whole_table(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    target = spark.read.parquet(f"{medium}/labels.parquet").filter("quality = 1")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    targets = {r.doc_id for r in target.collect()}
    got = ce.score(docs, target, size=ce.VOCABULARY).collect()
    assert len(got) == len(rows)
    same(got, brute(rows, targets, ce.VOCABULARY))
    mean = lambda x: sum(x) / len(x)
    assert mean([r.ce_difference for r in got if r.doc_id in targets]) < mean([r.ce_difference for r in got if r.doc_id not in targets])


def test_edge_cases(spark):
    given = [(1, "a b a c"), (2, None), (3, " \n"), (4, "A b q r s t " * 20_000), (5, "zz"), (5, "zz")]
    df = spark.createDataFrame([(a, b, True) for a, b in given], "doc_id long, text string, target boolean")
    target = spark.createDataFrame([(1,), (1,), (None,), (99,)], "doc_id long")
    got = ce.score(df, target, size=4).collect()
    assert len(got) == 6
    same(got, brute(given, {1}, 4))
    none = ce.score(df, target.limit(0), size=4).collect()
    assert all(r.ce_target is None and r.ce_difference is None for r in none)
    assert ce.score(df.limit(0), target).count() == 0
    extra = spark.createDataFrame([(None, "a")], "doc_id long, text string")
    assert [r.doc_id for r in ce.score(extra, target, size=4).collect()] == [None]


def test_every_word(spark, medium):
    """The query keeps words beyond any fixed number, in chunks and buckets of any size."""
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    targets = {r.doc_id for r in spark.read.parquet(f"{medium}/labels.parquet").filter("quality = 1").collect()}
    words = {w for _, t in rows for w in re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))}
    assert len(words) > 10 * ce.VOCABULARY
    same(QUERIES["op7_lm_cross_entropy"](spark, medium).collect(), brute(rows, targets, len(words) + 1))


def test_matched(spark, medium):
    """A document is scored by models that haven't seen it: a text that occurs once gains nothing from being counted."""
    docs = spark.createDataFrame([(i, f"x{i} y{i} z{i} a b c") for i in range(40)] + [(100, "q r s t u v"), (101, "q r s t u v")], "doc_id long, text string")
    got = {r.doc_id: r for r in ce.score(docs, docs.filter("doc_id < 20"), size=None).collect()}
    assert got[100].ce_background < got[100].ce_target and got[100].ce_background == got[101].ce_background
    assert got[1].ce_background > got[100].ce_background and got[1].ce_target < got[30].ce_target + 1e-9


def test_chunks(spark, monkeypatch):
    given = [(i % 90, " ".join(f"w{i * j % 97}" for j in range(i % 40))) for i in range(200)] + [(None, "w1 w2")]
    df = spark.createDataFrame(given, "doc_id long, text string").coalesce(2)
    target = spark.createDataFrame([(i,) for i in range(0, 90, 3)], "doc_id long")
    whole = sorted(map(tuple, ce.score(df, target, size=None).collect()), key=repr)
    monkeypatch.setattr(ce, "_CHUNK", 100)
    monkeypatch.setattr(ce, "_BUCKET", 300)
    parts = sorted(map(tuple, ce.score(df, target, size=None).collect()), key=repr)
    assert len(whole) == len(parts) == 201
    for a, b in zip(whole, parts, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)
