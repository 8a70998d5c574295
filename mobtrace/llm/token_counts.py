"""Token counts of whole texts by a word-level BPE tokenizer, huge texts by overlapping pieces.

A text of more than ``piece`` characters is cut into pieces that begin every ``piece``
characters and reach ``overlap`` characters into the next one. Spark deals the pieces out
over all tasks, the library encodes each with offsets, and neighbours are spliced where
both have a token that begins at the same *stable* place in their common stretch: the
left piece counts up to there, the right one from there on. Where two neighbours have no
such place the text is cut anew with an overlap (and pieces) four times as wide, until
they align or the text is one piece. Shorter texts are one piece from the start; of
these a worker encodes each distinct word once, words being what ASCII white space parts.

What is proven of stable places, for the vocabulary this is made for (NFC, white space to
one space, lower case for each character by itself; matches of contractions, letter runs,
single digits and runs of other characters; matches are encoded by themselves):

- *next to ASCII white space*: no match and no added token's string holds white space, so
  none crosses the place. A space, tab or line end composes with nothing and, being a
  starter, lets no mark pass it, so NFC is the same on both sides taken apart.
- *next to an ASCII digit*: a digit is a match of its own, none of the other alternatives
  and no added token's string holds one, and it composes with nothing either.

So tokens left of a stable place depend on the text left of it only, and those right of
it on the text right of it: a piece has the whole text's tokens between the first and the
last stable place in it, and both neighbours agree from the one they share.

Edge cases: a null text is an empty text and has no tokens; strings of added tokens in a
text are what the library makes of them; rows with equal or null keys count by
themselves; other columns, whatever their names, play no part; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mobtrace.llm.storage import kept

#: Characters of a piece and of the stretch that it shares with the next one; how much wider both get where neighbours don't align.
PIECE, OVERLAP, WIDER = 65_536, 512, 4
#: Tokens beyond which a text counts as too long.
LIMIT = 2048
#: Distinct words whose counts a worker remembers, characters of the longest such word, words encoded at once.
WORDS_KEPT, LONGEST_KEPT, WORDS_AT_ONCE = 1_000_000, 64, 10_000
#: Characters of pieces that are encoded at once.
CHARS_AT_ONCE = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def load(path: str):
    """The library's tokenizer, without truncation, padding and a memo of its own. Built once per Python worker."""
    from tokenizers import Tokenizer, models

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        given = json.load(file)["model"]
    if given["type"] == "BPE":
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in given.pop("merges")]
        settings = {k: v for k, v in given.items() if k != "type" and v is not None}
        tokenizer.model = models.BPE(**settings, merges=merges, cache_capacity=0)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordCounter:
    """Tokens of texts from those of their words, each distinct word of some texts encoded once."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        split = [t.encode().split() for t in texts]  # bytes are split at ASCII white space
        known = self.known
        new = set()
        for words in split:
            new.update(words)
        new = list(new.difference(known))
        long: dict[bytes, int] = {}
        for at in range(0, len(new), WORDS_AT_ONCE):
            some = new[at : at + WORDS_AT_ONCE]
            for w, x in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                (known if len(w) <= LONGEST_KEPT else long)[w] = len(x)
        if long:
            counts = [sum([long[w] if w in long else known[w] for w in words]) for words in split]
        else:
            counts = [sum(map(known.__getitem__, words)) for words in split]
        if len(known) > WORDS_KEPT:
            self.known = {}
        return counts


def stable(text: str, at: int) -> bool:
    """Whether tokens on the two sides of place ``at`` are proven not to depend on each other."""
    if at <= 0 or at >= len(text):
        return True
    return text[at - 1] in " \t\n\v\f\r" or text[at] in " \t\n\v\f\r" or "0" <= text[at - 1] <= "9" or "0" <= text[at] <= "9"


def cuts(text: str, piece: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of the overlapping pieces of a text."""
    start = 0
    while True:
        end = start + piece + overlap
        if end >= len(text):
            yield start, len(text)
            return
        yield start, end
        start += piece


def boundaries(text: str, offsets: list[tuple[int, int]], begin: int, end: int) -> tuple[list[int], list[int]]:
    """Stable places from ``begin`` to ``end`` where a token begins, and how many tokens stand before each."""
    starts = np.array([a for a, _ in offsets], np.int64)
    lo, hi = np.searchsorted(starts, [begin, end])
    places, before = [], []
    for i in range(lo, hi):
        at = int(starts[i])
        # a character that decomposes into several tokens gives them equal starts: the first of them counts
        if (not places or at != places[-1]) and (i == 0 or starts[i - 1] < at) and stable(text, at):
            places.append(at)
            before.append(i)
    return places, before


def _cut(piece: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                spans = list(cuts(text, piece, overlap))
                for at in range(0, len(spans), 16):
                    some = spans[at : at + 16]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * len(some), pa.int64()), pa.array(range(at, at + len(some)), pa.int32()), pa.array([e == len(text) for _, e in some]), pa.array([text[s:e] for s, e in some], pa.string())],
                        names=["row", "no", "last", "text"],
                    )

    return run


def _encode(path: str, piece: int, overlap: int):
    """Tokens of each piece, and its stable places in the stretches that it shares, counted from its own start and from the next one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            texts, at = batch.column(3).to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end]) <= CHARS_AT_ONCE):
                    chars += len(texts[end])
                    end += 1
                n, head, tail = [], [], []
                for text, x, last in zip(texts[at:end], tokenizer.encode_batch(texts[at:end], add_special_tokens=False), batch.column(2).slice(at, end - at).to_pylist(), strict=True):
                    offsets = x.offsets
                    n.append(len(offsets))
                    head.append(boundaries(text, offsets, 1, overlap))
                    tail.append(([], []) if last else boundaries(text, offsets, piece + 1, piece + overlap))
                lists = [pa.array(x, pa.list_(pa.int32())) for x in ([p for p, _ in head], [b for _, b in head], [[p - piece for p in p_] for p_, _ in tail], [b for _, b in tail])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, end - at) for i in range(3)), pa.array(n, pa.int64()), *lists], names=["row", "no", "last", "n", "head", "head_n", "tail", "tail_n"])
                at = end

    return run


def spliced(pieces: DataFrame) -> DataFrame:
    """row, n_tokens, n_pieces of every text whose pieces all align; n_tokens is null for the others.

    Up to its last piece, a piece adds what stands before the place it shares with the next
    one, less what the next one has before that place.
    """
    w = Window.partitionBy("row").orderBy("no")
    both = pieces.withColumn("next", F.lead("head").over(w)).withColumn("next_n", F.lead("head_n").over(w))
    both = both.withColumn("at", F.when(~F.col("last"), F.get(F.array_intersect("tail", "next"), F.lit(0))))
    own = F.get("tail_n", (F.array_position("tail", F.col("at")) - 1).cast("int"))
    theirs = F.get("next_n", (F.array_position("next", F.col("at")) - 1).cast("int"))
    both = both.withColumn("part", F.when(F.col("last"), F.col("n")).otherwise(own - theirs))
    return both.groupBy("row").agg(F.when(F.count("part") == F.count("*"), F.sum("part")).alias("n_tokens"), F.count("*").alias("n_pieces"))


def resynchronised(huge: DataFrame, path: str, piece: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """row, n_tokens, n_pieces for the texts of ``huge`` (row, text; written, so that reading it again gives the same rows)."""
    left, done = huge, None
    while True:
        cut = left.select("row", "text").mapInArrow(_cut(piece, overlap), "row long, no int, last boolean, text string")
        found = cut.repartition(F.col("row"), F.col("no")).mapInArrow(_encode(path, piece, overlap), "row long, no int, last boolean, n long, head array<int>, head_n array<int>, tail array<int>, tail_n array<int>")
        counts = kept(spliced(found), "spliced")
        good = counts.filter("n_tokens is not null")
        done = good if done is None else done.union(good)
        failed = counts.filter("n_tokens is null").select("row")
        if failed.isEmpty():
            return done
        left = huge.join(failed, "row", "left_semi")
        piece, overlap = max(piece, overlap * WIDER), overlap * WIDER


def counted(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, piece: int = PIECE, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """Per row: ``doc_id`` (the key), n_bytes of the text in UTF-8, n_tokens, whether these are more than ``limit``, n_pieces."""
    if not 1 < overlap <= piece:
        raise ValueError("an overlap must be shorter than a piece")
    path = path or default_vocabulary()
    kind = dict(df.dtypes)[key]
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordCounter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counter(part.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.octet_length("text").cast("long").alias("n_bytes")
    short = docs.filter(F.length("text") <= piece + overlap).select("doc_id", "text", size).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    huge = kept(docs.filter(F.length("text") > piece + overlap).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", size), "huge")
    long = huge.drop("text").join(resynchronised(huge, path, piece, overlap), "row").select("doc_id", "n_bytes", "n_tokens", "n_pieces")
    every = short.withColumn("n_pieces", F.lit(1).cast("long")).union(long)
    return every.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_pieces")
