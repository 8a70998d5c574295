"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary is that of a public byte-level tokenizer and is never trained; each
language has probabilities of its pieces. A word's probability is the sum over all ways
to cut it into pieces, which a forward pass over its bytes computes; a text's is the
product over its words. Piece counts are expected counts: a forward and a backward pass
over every training word, under equal piece probabilities, weigh each piece by how many
of the segmentations use it, and Spark sums the counts over all training rows.

Each word is scored once for a batch of rows, however often it occurs. The passes slide
over the bytes and hold as many positions as the longest piece has, so a word of any
length is whole. A model is as large as vocabulary times languages.

Words are runs of ASCII letters in lower case and of characters beyond ASCII, with the
space before them. Edge cases: null text, and text without a letter (a character of
Unicode's category L), is ``und`` with score 0, as is everything where no row could be
learned from; rows without ``doc_id`` count as held out; rows without a language aren't
learned from; repeated rows count each; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobtrace.llm import words
from mobtrace.llm.byte_bpe import default_vocabulary, read_ranks
from mobtrace.llm.storage import kept
from mobtrace.llm.words import U, mix

#: Weight of the distribution over all languages in each language's own.
SHARED = 200.0
_SCALE = 30.0
_ASCII = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_SPACE = np.arange(256) == 32
_TEXT_AT_ONCE = 2_000_000
#: Distinct words, their positions, and characters of text that a worker holds tables for at a time.
WORDS_AT_ONCE, CELLS_AT_ONCE, CHARS_AT_ONCE = 20_000, 2_000_000, 8_000_000
#: Positions after which a pass is scaled anew.
_ANEW = 16


class Pieces:
    """Pieces and their beginnings by their keys, for those pieces that a word can hold."""

    def __init__(self, path: str):
        self.tokens = [token for _, token in sorted((rank, token) for token, rank in read_ranks(path).items())]
        usable = [i for i, t in enumerate(self.tokens) if t and (t[:1] == b" " or _ASCII[t[0]] != 32) and 32 not in t[1:].translate(_ASCII)]
        data = np.frombuffer(b"".join(self.tokens[i] for i in usable), np.uint8)
        sizes = np.array([len(self.tokens[i]) for i in usable])
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        ends = np.arange(len(data)) + 1
        ids = np.full(len(data), -1)
        ids[np.cumsum(sizes) - 1] = usable
        keys = span_keys(words.running(data), starts, ends)
        order = np.lexsort((-ids, keys))
        self.keys, first = np.unique(keys[order], return_index=True)
        self.ids = ids[order][first]
        self.longest = int(sizes.max())
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.keys >> U(44)).astype(np.int64)] = True

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys begin some piece, and the pieces that they are (-1: they only begin one)."""
        at = np.flatnonzero(self.some[(keys >> U(44)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        good = self.keys[spot] == keys[at]
        return at[good], self.ids[spot[good]]


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def span_keys(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * words.powers(len(sums))[1][starts] + (ends - starts).astype(U))


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of several spans, one after the other."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


@dataclass
class Batch:
    """Distinct words of some texts (keys, bytes, sizes; short ones first), and each word's place among them with its text."""

    keys: np.ndarray
    data: np.ndarray
    sizes: np.ndarray
    word: np.ndarray
    text: np.ndarray


def portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about CHARS_AT_ONCE characters."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHARS_AT_ONCE):
            chars += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def read(texts: list[str | None]) -> Batch:
    keys, owner, own_keys, own_data, own_sizes = [], [], [], [], []
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end] or "") <= _TEXT_AT_ONCE):
            chars += len(texts[end] or "")
            end += 1
        parts = [b" " + (t or "").lower().encode("utf-8", "surrogatepass").translate(_ASCII) for t in texts[at:end]]
        data = np.frombuffer(b"".join(parts), np.uint8)
        starts, ends = words.bounds(data, _SPACE)
        starts = starts - 1  # the space before a word belongs to it
        k = span_keys(words.running(data), starts, ends)
        first = np.cumsum([0] + [len(p) for p in parts[:-1]])
        keys.append(k)
        owner.append(at + np.searchsorted(first, starts, side="right") - 1)
        u, spot = np.unique(k, return_index=True)
        own_keys.append(u)
        own_sizes.append((ends - starts)[spot])
        own_data.append(_gather(data, starts[spot], own_sizes[-1]))
        at = end
    none = np.zeros(0, np.int64)
    all_keys = np.concatenate(own_keys) if own_keys else np.zeros(0, U)
    sizes = np.concatenate(own_sizes) if own_sizes else none
    data = np.concatenate(own_data) if own_data else np.zeros(0, np.uint8)
    u, spot = np.unique(all_keys, return_index=True)
    starts = (np.cumsum(sizes) - sizes)[spot]
    # by size, so that some words at a time need about as many steps
    order = np.argsort(sizes[spot], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    word = place[np.searchsorted(u, np.concatenate(keys))] if keys else none
    spot, starts = spot[order], starts[order]
    return Batch(u[order], _gather(data, starts, sizes[spot]), sizes[spot], word, np.concatenate(owner) if owner else none)


@dataclass
class Window:
    """Pieces in words by where they begin: for each (start, size) the words and the ids."""

    starts: list[int]
    of_start: list[list[tuple[int, slice]]]
    row: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    size: np.ndarray


def parts(batch: Batch, lanes: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of words, by count (for ``lanes`` numbers each) and by positions; a longer word is a run of its own."""
    at, most = 0, max(1, min(WORDS_AT_ONCE, 2 * CELLS_AT_ONCE // lanes))
    while at < len(batch.sizes):
        own = batch.sizes[at : at + most]
        n = max(1, int(np.searchsorted(np.arange(1, len(own) + 1) * (own + 1), CELLS_AT_ONCE, side="right")))
        yield at, at + n
        at += n


def windows(part: Batch, known: Pieces, back: bool = False) -> Iterator[Window]:
    """The pieces of all words, some positions at a time; the last first if asked."""
    n = int(part.sizes.max(initial=0))
    step = max(64, CELLS_AT_ONCE // max(1, len(part.sizes)))
    begin = np.cumsum(part.sizes) - part.sizes
    sums = words.running(part.data)
    bounds = [(lo, min(n, lo + step)) for lo in range(0, n, step)]
    for lo, hi in reversed(bounds) if back else bounds:
        rows = np.flatnonzero(part.sizes > lo)
        count = np.minimum(part.sizes[rows], hi) - lo
        row = np.repeat(rows, count)
        start = lo + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at, room = begin[row] + start, part.sizes[row] - start
        live, found = np.arange(len(row)), []
        for size in range(1, known.longest + 1):
            live = live[room[live] >= size]
            if not len(live):
                break
            some, ids = known.find(span_keys(sums, at[live], at[live] + size))
            live = live[some]
            whole = ids >= 0
            own = live[whole]
            found.append((start[own], np.full(len(own), size), row[own], ids[whole]))
        start, size, row, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start * (known.longest + 1) + size, kind="stable")
        start, size, row, ids = start[order], size[order], row[order], ids[order]
        group = np.flatnonzero(np.diff(start * (known.longest + 1) + size, prepend=-1))
        of: dict[int, list[tuple[int, slice]]] = {}
        for a, b in zip(group.tolist(), [*group[1:].tolist(), len(row)], strict=True):
            of.setdefault(int(start[a]), []).append((int(size[a]), slice(a, b)))
        keys = sorted(of, reverse=back)
        yield Window(keys, [of[k] for k in keys], row, ids, start, size)


def _forward(part: Batch, known: Pieces, seen: list[Window] | None, p: np.ndarray, every: np.ndarray | None = None) -> np.ndarray:
    """Log of the scaled sums of whole words in each language; with ``every`` those of all positions go there (one language)."""
    n, width = int(part.sizes.max()), known.longest + 1
    ring = np.zeros((width, len(part.sizes), p.shape[1]))
    ring[0] = 1
    log, out = np.zeros(ring.shape[1:]), np.zeros(ring.shape[1:])
    weight = _SCALE ** np.arange(width)

    def reach(at: int) -> np.ndarray:
        now = ring[at % width]
        done, live = np.searchsorted(part.sizes, [at, at + 1])
        if done < live:
            out[done:live] = np.log(now[done:live]) + log[done:live]
        if every is not None:
            every[at, done:] = (np.log(now[done:]) + log[done:])[:, 0]
        if at % _ANEW == 0 and at and live < len(part.sizes):
            log[live:] += np.log(now[live:])
            ring[:, live:] /= now[live:].copy()
        return now

    for window in seen or windows(part, known):
        for start, groups in zip(window.starts, window.of_start, strict=True):
            now = reach(start)
            for size, own in groups:
                rows = window.row[own]
                ring[(start + size) % width][rows] += now[rows] * (p[window.ids[own]] * weight[size])
            now[:] = 0
    reach(n)
    return out


def forward(batch: Batch, known: Pieces, p: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language; p is (piece, language)."""
    out = np.zeros((len(batch.sizes), p.shape[1]))
    for a, b in parts(batch, (known.longest + 1) * p.shape[1]):
        part = _part(batch, a, b)
        out[a:b] = _forward(part, known, None, p) - part.sizes[:, None] * np.log(_SCALE)
    return out


def _part(batch: Batch, a: int, b: int) -> Batch:
    ends = np.cumsum(batch.sizes)
    sizes = batch.sizes[a:b]
    start = int(ends[a] - batch.sizes[a])
    return Batch(batch.keys[a:b], batch.data[start : start + int(sizes.sum())], sizes, batch.word, batch.text)


def expected(batch: Batch, known: Pieces, counts: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in each language (piece, language), under equal piece probabilities.

    counts is (word, language): how often the words occur.
    """
    out = np.zeros((len(known.tokens), counts.shape[1]))
    p, width = 1 / len(known.tokens), known.longest + 1
    weight = p * _SCALE ** np.arange(width)
    for a, b in parts(batch, width):
        part, own = _part(batch, a, b), counts[a:b]
        n, rows = int(part.sizes.max()), len(part.sizes)
        # the pieces of words of usual length are found once, those of very long ones again for each pass
        seen = list(windows(part, known)) if n <= max(64, CELLS_AT_ONCE // rows) else None
        alpha = np.zeros((n + 1, rows))
        total = _forward(part, known, seen, np.full((len(known.tokens), 1), p), alpha)[:, 0]
        beta, ring, log = np.zeros((n + 1, rows)), np.zeros((width, rows)), np.zeros(rows)
        for window in reversed(seen) if seen else windows(part, known, back=True):
            turns = zip(window.starts, window.of_start, strict=True)
            for start, groups in reversed(list(turns)) if seen else turns:
                ends = slice(*np.searchsorted(part.sizes, [start + 1, start + 2]))  # words that end behind this byte
                ring[(start + 1) % width][ends] = 1
                now = ring[start % width]
                now[:] = 0
                for size, spot in groups:
                    r = window.row[spot]
                    now[r] += ring[(start + size) % width][r] * weight[size]
                live = int(np.searchsorted(part.sizes, start + 1))
                beta[start, live:] = np.log(now[live:]) + log[live:]
                if start % _ANEW == 0:
                    log[live:] += np.log(now[live:])
                    ring[:, live:] /= now[live:].copy()
            end = window.start + window.size
            share = np.exp(alpha[window.start, window.row] + np.log(weight)[window.size] + beta[end, window.row] - total[window.row])
            for language in range(counts.shape[1]):
                use = share * own[window.row, language]
                out[:, language] += np.bincount(window.ids, weights=use, minlength=len(out))
    return out


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    p: np.ndarray
    path: str

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        named, scores = [], []
        for a, b in portions(texts):
            some = self._predict(texts[a:b])
            named += some[0]
            scores += some[1]
        return named, scores

    def _predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        named, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return named, scores
        batch = read(texts)
        logs = forward(batch, pieces(self.path), self.p)
        total = np.stack([np.bincount(batch.text, weights=logs[batch.word, i], minlength=len(texts)) for i in range(len(self.languages))], axis=1)
        n = np.maximum(1, np.bincount(batch.text, minlength=len(texts)))
        total = total + self.prior
        best = total.argmax(axis=1)
        sure = 1 / np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(n)[:, None]).sum(axis=1)
        for i, t in enumerate(texts):
            if t and any(map(str.isalpha, t)):
                named[i], scores[i] = self.languages[best[i]], float(sure[i])
        return named, scores


def train(docs: DataFrame, text: str = "text", lang: str = "lang", path: str | None = None) -> Model:
    """Learns from every row of ``docs`` that has a text and a language."""
    path = path or default_vocabulary()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        for b in batches:
            langs = pd.Series(b.column(1).to_pylist(), dtype="object")
            codes, names = pd.factorize(langs)
            found, texts = np.zeros((len(known.tokens), len(names))), b.column(0)
            for start, end in portions(texts.to_pylist()):
                batch = read(texts[start:end].to_pylist())
                own = codes[start:end][batch.text]
                counts = np.bincount(batch.word * len(names) + own, minlength=len(batch.sizes) * len(names)).reshape(-1, len(names))
                found += expected(batch, known, counts)
            piece, language = np.nonzero(found)
            # whole millionths add up to the same in any order; piece -1 counts rows
            values = np.rint(found[piece, language] * 1e6).astype(np.int64)
            piece = np.concatenate([piece, np.full(len(names), -1)])
            values = np.concatenate([values, np.bincount(codes, minlength=len(names))])
            language = np.concatenate([language, np.arange(len(names))])
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in language], pa.string()), pa.array(piece, pa.int32()), pa.array(values, pa.int64())], names=["lang", "piece", "n"])

    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, F.col(lang).cast("string"))
    sums = kept(rows.mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")), "pieces")
    got = sums.toPandas()  # a number for each piece and language at most
    languages = sorted(got.lang.unique())
    known = pieces(path)
    counts, prior = np.zeros((len(known.tokens), len(languages))), np.zeros(len(languages))
    code = got.lang.map({x: i for i, x in enumerate(languages)}).to_numpy("int64")
    piece, n = got.piece.to_numpy("int64"), got.n.to_numpy("float64")
    counts[piece[piece >= 0], code[piece >= 0]] = n[piece >= 0] / 1e6
    prior[code[piece < 0]] = np.log(n[piece < 0])
    everywhere = (counts.sum(axis=1) + 1) / (counts.sum() + len(counts))
    p = (counts + SHARED * everywhere[:, None]) / (counts.sum(axis=0) + SHARED)
    return Model(languages, prior - np.log(max(1.0, np.exp(prior).sum())), p.astype(np.float32), path)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, held_out, lang_pred and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named, scores = model.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(key), held_out(F.col(key)).alias("held_out"), F.col(text))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[key]}, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known well enough.

    ``least`` says how far the score must be from an even guess among the learned languages
    (0) towards certainty (1).
    """
    even = 1 / max(1, len(model.languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named, scores = model.predict(b.column(b.schema.get_field_index(text)).to_pylist())
            yield b.filter(pa.array([n != "und" and s >= even + least * (1 - even) for n, s in zip(named, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train_and_identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out, and predicts all."""
    return identify(docs, train(docs.filter(~held_out(F.col("doc_id")))))
