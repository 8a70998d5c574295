"""Byte-level BPE encoding and decoding.

The merge list is recovered from a rank file (token bytes -> rank), then the
``tokenizers`` library encodes Arrow batches of texts. Every byte is mapped to
one printable character, as byte-level vocabularies do, so a token string is a
character string of the same length as its bytes; decoding reverses that table.

Edge cases: a null text is an empty text and has no tokens; a text may hold any
characters; a character whose bytes are split over several tokens gets the same
character offsets in all of them and is whole again after decoding.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text encoded at once; bounds what a worker holds besides its Arrow batch.
CHARS_AT_ONCE = 2_000_000
#: Distinct chunks whose ids a worker remembers between batches.
CHUNKS_KEPT = 400_000
#: A single space between two characters that aren't white space.
BETWEEN = re.compile(r" (?<=\S )(?=\S)")


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that splits texts."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def byte_table() -> dict[int, str]:
    """Byte -> character: printable Latin-1 bytes stay, the others move above 255 in order."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(stay)]
    return {b: chr(b) for b in stay} | {b: chr(256 + i) for i, b in enumerate(moved)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that are joined last when ``token`` is built from bytes."""
    parts = [token[i : i + 1] for i in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        best, at = own, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], own)
            if rank < best:
                best, at = rank, i
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@lru_cache(maxsize=2)
def load(path: str, pattern: str):
    """The tokenizer and, by id, the bytes of each token. Built once per Python worker."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    ranks, chars = read_ranks(path), byte_table()
    text = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and (pair := merge_of(token, ranks)):
            merges.append((text[pair[0]], text[pair[1]]))
    tokenizer = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, cache_capacity=0))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    back = {c: b for b, c in chars.items()}
    table: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = bytes(back[c] for c in text[token])
    return tokenizer, table


def decode(ids, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids])


def encoded(texts: list[str], path: str, pattern: str) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
    """Ids and offsets of each text, straight from the library."""
    tokenizer, _ = load(path, pattern)
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= CHARS_AT_ONCE):
            chars += len(texts[end])
            end += 1
        for x in tokenizer.encode_batch(texts[at:end], add_special_tokens=False):
            yield x.ids, x.offsets
        at = end


class ChunkEncoder:
    """Ids of texts as little-endian uint32, encoding each distinct chunk of a batch once.

    No match of a byte-level pattern crosses a single space that stands between two
    other characters than white space, so a text is the chain of its chunks.
    """

    def __init__(self, path: str, pattern: str):
        self.tokenizer, self.table = load(path, pattern)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CHUNKS_KEPT:  # chunks that no later batch holds go with the generation after next
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        split = [BETWEEN.split(t) for t in texts]
        for chunks in split:
            chunks[1:] = [" " + c for c in chunks[1:]]
        new = set()
        for chunks in split:
            new.update(chunks)
        new.difference_update(known)
        for c in new.intersection(older):
            known[c] = older[c]
        new = list(new.difference(known))
        long: dict[str, bytes] = {}
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            for c, x in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                ids = x.ids
                (known if len(c) <= 64 else long)[c] = struct.pack(f"<{len(ids)}I", *ids)
        if long:
            return [b"".join([long[c] if c in long else known[c] for c in chunks]) for chunks in split]
        return [b"".join([known[c] for c in chunks]) for chunks in split]

    def batches(self, texts: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= CHARS_AT_ONCE):
                chars += len(texts[end])
                end += 1
            yield from self(texts[at:end])
            at = end


def encode(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, offsets: bool = True) -> DataFrame:
    """Adds ``ids`` and, if asked for, ``offsets`` (start and end in code points of each token).

    Columns of these names that ``df`` already has are replaced.
    """
    path, pattern = _given(path, pattern)

    @F.pandas_udf("ids array<int>, offsets array<struct<start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(encoded(batch.fillna("").tolist(), path, pattern))
            yield pd.DataFrame({"ids": [i for i, _ in found], "offsets": [[{"start": a, "end": b} for a, b in o] for _, o in found]})

    out = df.drop("ids", "offsets").withColumn("__bpe", run(F.col(text)))
    return out.select("*", "__bpe.ids", *(["__bpe.offsets"] if offsets else [])).drop("__bpe")


def decoded_bytes(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """The bytes that ``ids`` stand for; ids out of the vocabulary are an error."""
    path, pattern = _given(path, pattern)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _, table = load(path, pattern)
        for batch in batches:
            yield pd.Series([None if x is None else decode(x, table) for x in batch])

    return run(ids)


def decoded_text(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Text of ``ids``; bytes that aren't a whole character become U+FFFD."""
    path, pattern = _given(path, pattern)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _, table = load(path, pattern)
        for batch in batches:
            yield pd.Series([None if x is None else decode(x, table).decode("utf-8", "replace") for x in batch], dtype="object")

    return run(ids)


def token_offsets(sizes: np.ndarray, data: bytes) -> np.ndarray:
    """(start, end) in code points of tokens of ``sizes`` bytes each, laid over the bytes that they make.

    A token that holds a part of a character covers the whole of it, as the library has it.
    """
    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(begins)])
    ends = np.cumsum(sizes)
    return np.stack([before[ends - sizes + 1] - 1, before[ends]], axis=1)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row: number of tokens, SHA-256 of the ids as little-endian uint32, SHA-256 of the decoded bytes.

    Besides ``offsets_sha256``, of the tokens' starts and ends in code points as little-endian
    uint32, and ``n_split``, how many tokens begin within a character. Encodes and decodes in
    one pass, so ids never leave the worker. Only the key and the text are read, so other
    columns, whatever their names, play no part.
    """
    path, pattern = _given(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(path, pattern)
        sizes = np.array([len(t) for t in encoder.table], np.int64)
        for batch in batches:
            n, ids_sha, back_sha, offsets_sha, split = [], [], [], [], []
            for ids in encoder.batches([x or "" for x in batch.column(1).to_pylist()]):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                numbers = np.frombuffer(ids, "<u4")
                back = decode(numbers.tolist(), encoder.table)
                back_sha.append(hashlib.sha256(back).hexdigest())
                offsets = token_offsets(sizes[numbers], back) if len(numbers) else np.zeros((0, 2), np.int64)
                offsets_sha.append(hashlib.sha256(offsets.astype("<u4").tobytes()).hexdigest())
                split.append(int((offsets[1:, 0] < offsets[:-1, 1]).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string()), pa.array(offsets_sha, pa.string()), pa.array(split, pa.int64())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "n_split"],
            )

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string, n_split long")


def _given(path: str | None, pattern: str | None) -> tuple[str, str]:
    own = default_vocabulary() if path is None or pattern is None else ("", "")
    return path or own[0], pattern or own[1]
