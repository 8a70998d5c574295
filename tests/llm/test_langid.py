import zlib

import numpy as np
import pytest

from mobtrace.llm import langid
from mobtrace.llm.byte_bpe import default_vocabulary


@pytest.fixture(scope="module")
def known():
    return langid.pieces(default_vocabulary()[0])


def every_cut(word, ids, longest=33):
    if not word:
        yield []
    for n in range(1, min(len(word), longest) + 1):
        if word[:n] in ids:
            for rest in every_cut(word[n:], ids):
                yield [ids[word[:n]], *rest]


def test_sums_over_segmentations(known):
    ids = {t: i for i, t in enumerate(known.tokens)}
    rng = np.random.default_rng(2)
    p = rng.dirichlet(np.ones(len(ids)), 2).T
    batch = langid.read(["The éa th", None, "xyz 12 the"])
    ends = np.cumsum(batch.sizes)
    found = [bytes(batch.data[e - n : e]) for e, n in zip(ends, batch.sizes, strict=True)]
    assert sorted(found) == sorted([b" the", " éa".encode(), b" th", b" xyz"])
    assert [len(w) for w in found] == sorted(len(w) for w in found)
    assert [found[w] for w in batch.word] == [b" the", " éa".encode(), b" th", b" xyz", b" the"] and list(batch.text) == [0, 0, 0, 2, 2]
    logs = langid.forward(batch, known, p)
    counts = np.ones((4, 1))
    want = np.zeros(len(ids))
    for w, word in enumerate(found):
        cuts = list(every_cut(word, ids))
        for language in range(2):
            assert np.isclose(logs[w, language], np.log(sum(np.prod(p[c, language]) for c in cuts)))
        weights = [len(ids) ** -float(len(c)) for c in cuts]
        for c, x in zip(cuts, weights, strict=True):
            np.add.at(want, c, x / sum(weights))
    assert np.allclose(langid.expected(batch, known, counts)[:, 0], want)


def test_words_of_any_length(known, monkeypatch):
    """A word of very many bytes is scored and counted whole, however few positions are held at a time."""
    ids = {t: i for i, t in enumerate(known.tokens)}
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(len(ids)), 2).T
    batch = langid.read(["international" * 40 + " the " + "éb" * 150, "a"])
    logs, uses = langid.forward(batch, known, p), langid.expected(batch, known, np.ones((len(batch.sizes), 1)))
    ends = np.cumsum(batch.sizes)
    total = 0
    for w, (e, n) in enumerate(zip(ends, batch.sizes, strict=True)):
        word = bytes(batch.data[e - n : e])
        for language in range(2):
            alpha = np.full(n + 1, -np.inf)
            alpha[0] = 0
            for end in range(1, n + 1):
                terms = [alpha[end - k] + np.log(p[ids[word[end - k : end]], language]) for k in range(1, min(end, 33) + 1) if word[end - k : end] in ids]
                alpha[end] = np.logaddexp.reduce(terms)
            assert np.isclose(logs[w, language], alpha[-1])
        total += n
    sizes = np.array([len(t) for t in known.tokens])
    assert np.isclose((uses[:, 0] * sizes).sum(), total)  # the pieces of every cut cover the word
    monkeypatch.setattr(langid, "CELLS_AT_ONCE", 200)
    assert np.allclose(langid.forward(batch, known, p), logs) and np.allclose(langid.expected(batch, known, np.ones((len(batch.sizes), 1))), uses)


def test_whole_table(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.train_and_identify(docs).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in out]) > 0.97


def test_edge_cases(spark):
    given = [(1, "the house and the garden", "en"), (2, "das Haus und der Garten", "de"), (3, None, "en"), (4, "", "en"), (5, "12 ?! €", "de"), (6, "der " * 100_000, None), (7, "x" * 200_000, None), (None, "und das", "fr"), (1, "the house and the garden", "en"), (8, "½ ①", "en"), (9, "²³", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in given], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(df, langid.train(df.filter("doc_id < 5"))).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (8, "und"), (9, "und"), (1, "en"), (2, "de"), (6, "de"), (None, "de")} <= got
    nothing = langid.identify(df, langid.train(df.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)} and len(nothing) == 11
    assert langid.train_and_identify(df.limit(0)).count() == 0
