import pytest
from pyspark.sql import functions as F

from mobtrace.llm import token_counts as t
from mobtrace.llm.queries import QUERIES

SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0x200B, 0xFEFF]))


def library(texts):
    """As the file says, without any change to what the library reads from it."""
    from tokenizers import Tokenizer

    return [len(x) for x in Tokenizer.from_file(t.default_vocabulary()).encode_batch([x or "" for x in texts], add_special_tokens=False)]


def hard():
    import random

    draw = random.Random(5)
    marks = "̸̧̣́"
    alphabet = "abcdeXYZ éÀ'ſΣσς" + SPACES + marks + "0123456789½²٣" + "你好กำ한글ᄒ" + "<|endoftext|>.,-_#" + "😀"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 900))) for _ in range(120)]
    words = ["they've", "I'll", "<|endoftext|>", "<|startoftext|>x", "Ünïcode", "12:30", "naïvé", "...", "İstanbul"]
    texts += ["".join(draw.choice(words) + draw.choice([" ", "", "\n", " ", " ́"]) for _ in range(draw.randint(1, 300))) for _ in range(60)]
    return texts


def test_words_add_up():
    texts = [None, "", " ", "\n\n", *hard(), "a" * 3000, "<|endoftext|>" * 40, "a\x1cb", "1" * 500]
    assert t.WordCounter(t.default_vocabulary())([x or "" for x in texts]) == library(texts)


def test_a_memo_that_is_full_is_begun_anew(monkeypatch):
    monkeypatch.setattr(t, "WORDS_KEPT", 3)
    counter, texts = t.WordCounter(t.default_vocabulary()), ["one two three four", "five one " + "x" * 100, "two"]
    assert [counter([x])[0] for x in texts] == library(texts) and len(counter.known) <= 3


@pytest.mark.parametrize("piece, overlap", [(40, 8), (64, 64), (200, 16)])
def test_pieces_are_spliced_as_the_library_counts(spark, piece, overlap):
    """Short pieces, so that most texts have many and some overlaps must be widened."""
    texts = [*hard(), "y" * 700, "你好" * 400, "é" * 300, "z" * 150 + " " + "q" * 150, " " * 600, "7" * 300, "<|endoftext|>" * 60, "word " * 200, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in t.counted(df, piece=piece, overlap=overlap).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == library(texts)
    assert [got[i].n_bytes for i in range(len(texts))] == [len((x or "").encode()) for x in texts]
    assert max(r.n_pieces for r in got.values()) > 3
    assert got[len(texts) - 3].n_pieces > 1 and got[120 + 60].n_pieces == 1  # without a stable place, a text ends as one piece


def test_cuts_cover_the_text():
    for n in range(0, 100):
        spans = list(t.cuts("x" * n, 10, 4))
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b[0] - a[0] == 10 and a[1] - b[0] == 4 for a, b in zip(spans, spans[1:], strict=False))
    with pytest.raises(ValueError):
        t.counted(None, piece=10, overlap=11)


def test_other_columns_keys_and_empty_tables(spark):
    rows = [(1, "Two words", 5), (1, "Two words", 5), (None, "x", 6), (None, None, None)]
    df = spark.createDataFrame(rows, "key long, text string, row long").withColumn("n_tokens", F.lit("a")).withColumn("no", F.lit(1)).withColumn("doc_id", F.lit("b"))
    got = t.counted(df, key="key", limit=1).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.over_limit) for r in got) == [(0, 0, False), (0, 1, False), (1, 2, True), (1, 2, True)]
    assert t.counted(df.limit(0), key="key").count() == 0


def test_query_over_the_whole_table(spark, medium):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_token_counts"](spark, medium).collect()
    assert len(got) == len(texts) and dict(zip(texts, library(texts.values()), strict=True)) == {r.doc_id: r.n_tokens for r in got}
    assert all(r.over_limit == (r.n_tokens > 2048) and r.n_bytes == len((texts[r.doc_id] or "").encode()) for r in got)
