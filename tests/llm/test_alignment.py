import base64
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mobtrace.llm import alignment as al
from mobtrace.llm.queries import QUERIES

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(texts):
    """Straight from the contract, with whole texts given to both libraries."""
    a, b, bytes_a, bytes_b, _ = al.load(*al.default_vocabularies())
    rows, counts = [], Counter()
    for text in texts:
        row = [[], []]
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if b"".join(bytes_a[i] for i in x) == b"".join(bytes_b[i] for i in y) == (" " + text).encode():
                row = [x, y]
        ends = []
        for ids, table in zip(row, (bytes_a, bytes_b), strict=True):
            at, own = 0, []
            for i in ids:
                at += len(table[i])
                own.append(at)
            ends.append(own)
        groups, cut = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append([[i for i, e in zip(ids, own, strict=True) if cut < e <= end] for ids, own in zip(row, ends, strict=True)])
            cut = end
        links = Counter((i, j) for g in groups for i in g[0] for j in g[1])
        counts.update(links.keys())
        rows.append((row, groups, links))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for row, groups, links in rows:
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        best = sum(n for p, n in links.items() if counts[p] == most[p[0]])
        out.append((len(row[0]), len(row[1]), len(groups), sum(links.values()), best, sum(n * counts[p] for p, n in links.items()), digest))
    return out, counts, most


def hard():
    draw = random.Random(3)
    alphabet = "abcdeXYZ  éÀ'ſΣ\t\n\r\x00\x1c  　" + "0123456789½" + "你好กำ한글" + "<|endoftext|><s></s>.,-_#▁" + "😀 ́"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(1, 200))) for _ in range(150)]
    return [*texts, None, "", " ", "  ", "▁", "a▁b", " a", "a ", "two  spaces", "x" * 3000, "ab" * 900, "你" * 500, "<|endoftext|> <s> </s> <unk>", "same text", "same text", "\x00", "tab\tand\nline"]


def test_no_piece_of_b_crosses_a_space():
    a, _, bytes_a, _, within = al.load(*al.default_vocabularies())
    assert not within
    assert a.encode("<|endoftext|>", add_special_tokens=False).ids != [50256] and bytes_a[50256] == b""


def test_ids_are_those_of_whole_texts():
    """A's against a second library with the same ranks too."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    a, b, bytes_a, bytes_b, _ = al.load(*al.default_vocabularies())
    s = al.Stretches(*al.default_vocabularies())
    texts = [t for t in hard() if t]
    for text, x, y in zip(texts, *s(texts), strict=True):
        whole_a, whole_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        fit = b"".join(bytes_a[i] for i in whole_a) == b"".join(bytes_b[i] for i in whole_b) == (" " + text).encode()
        assert list(al.as_lists([x])[0].as_py()) == (whole_a if fit else []) and list(al.as_lists([y])[0].as_py()) == (whole_b if fit else [])
        assert other.encode_ordinary(" " + text) == whole_a


@pytest.mark.parametrize("links, wide, chunk, chars", [(al.LINKS_AT_ONCE, al.WIDE_GROUP, al.CHUNK, al.CHARS_AT_ONCE), (7, 2, 40, 50), (1, 0, 1, 1)])
def test_numbers_equal_the_plain_ones(spark, monkeypatch, links, wide, chunk, chars):
    for name, value in (("LINKS_AT_ONCE", links), ("WIDE_GROUP", wide)):
        monkeypatch.setattr(al, name, value)
    texts = hard()
    want, counts, most = plain(texts)
    s = al.Stretches(*al.default_vocabularies())
    import pyarrow as pa

    sizes = [pa.array([len(x) for x in t], pa.int32()) for t in (s.bytes_a, s.bytes_b)]
    each, pairs = al.aligned(*s([t or "" for t in texts]), *sizes)
    got = list(zip(*(each[c].to_pylist() for c in (*al.NUMBERS, "groups_sha256")), strict=True))
    assert got == [(*w[:4], w[6]) for w in want]
    assert Counter(pairs["pair"].to_pylist()) == Counter({(a << al.BITS) | b: n for (a, b), n in counts.items()})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows, totals = al.align(df)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows.collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {(r.id_a, r.id_b): (r.total, r.best) for r in totals.collect()} == {p: (n, n == most[p[0]]) for p, n in counts.items()}


def test_chunks_may_be_small(spark, monkeypatch, small):
    """Parameters are read where tasks run, so they are given to the function's module there: a chunk for each few texts."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40).repartition(7, "doc_id")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, _, _ = plain(texts.values())
    rows, _ = al.align(docs)
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows.collect()} == dict(zip(texts, want, strict=True))


def test_other_columns_keys_and_empty_tables(spark):
    rows = [(1, "two words", 5), (1, "two words", 5), (None, "x", 6), (None, None, None)]
    df = spark.createDataFrame(rows, "key long, text string, pair long").withColumn("chunk", F.lit("a")).withColumn("n", F.lit(1)).withColumn("doc_id", F.lit("b"))
    got, _ = al.align(df, key="key")
    want, _, _ = plain([r[1] for r in rows])
    assert sorted((r.doc_id or 0, *(r[c] for c in COLUMNS)) for r in got.collect()) == sorted((r[0] or 0, *w) for r, w in zip(rows, want, strict=True))
    got, totals = al.align(df.limit(0), key="key")
    assert got.count() == 0 and totals.count() == 0


def test_query_over_the_whole_table(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    want, _, _ = plain(texts.values())
    got = QUERIES["op12_tokenizer_alignment"](spark, small).collect()
    assert len(got) == len(texts) and {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == dict(zip(texts, want, strict=True))
