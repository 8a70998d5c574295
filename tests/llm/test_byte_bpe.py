import base64
import hashlib

import numpy as np
import pytest

from mobtrace.llm import byte_bpe

ODD = [None, "", "  a  b\n\n  c", "日本語テキスト🙂🙂 é́", "\r\n\t x 's 'S ١٢٣ ½²", "a\x85b\xa0c  d", " \n \n", "x " * 50_000, "ab" * 50_000, "<|endoftext|>", "it's we'll  they're ", "ab" * 50_000]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(df, reference):
    texts = {}
    for r in df.select("doc_id", "text").collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    rows = byte_bpe.digests(df).collect()
    assert len(rows) == sum(map(len, texts.values()))
    for r in rows:
        want = []
        for t in texts[r.doc_id]:
            ids = reference.encode_ordinary(t)
            want.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in want


def test_whole_table(spark, medium, reference):
    check(spark.read.parquet(f"{medium}/documents.parquet"), reference)


def test_offsets_of_the_query(spark, medium):
    """The digest of the offsets is that of the library's own."""
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate(ODD, 1)], "doc_id long, text string"))
    want = {}
    for r in byte_bpe.encode(docs).collect():
        pairs = np.array([(o.start, o.end) for o in r.offsets], "<u4").reshape(-1, 2)
        want.setdefault(r.doc_id, set()).add((hashlib.sha256(pairs.tobytes()).hexdigest(), int((pairs[1:, 0] < pairs[:-1, 1]).sum())))
    rows = byte_bpe.digests(docs.withColumn("offsets", byte_bpe.F.lit("clash"))).collect()
    assert all((r.offsets_sha256, r.n_split) in want[r.doc_id] for r in rows)
    assert any(r.n_split for r in rows)


def test_edge_cases(spark, reference):
    df = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    check(df, reference)
    assert byte_bpe.digests(df.limit(0)).count() == 0


def test_offsets_and_decoding(spark):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(ODD)], "doc_id long, text string, ids string")
    out = byte_bpe.encode(df).withColumn("back", byte_bpe.decoded_text(byte_bpe.F.col("ids"))).collect()
    for r in out:
        t = r.text or ""
        assert r.back == t and len(r.ids) == len(r.offsets)
        covered = set()
        for o in r.offsets:
            covered.update(range(o.start, o.end))
        assert covered == set(range(len(t)))
    cut = spark.createDataFrame([(list(byte_bpe.encoded(["🙂"], *byte_bpe.default_vocabulary()))[0][0][:1],)], "ids array<int>")
    assert "�" in cut.select(byte_bpe.decoded_text(byte_bpe.F.col("ids"))).first()[0]
