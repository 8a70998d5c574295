"""Alignment of two tokenizers over the same bytes, and how strongly their tokens belong together.

Each text, with a space before it, is encoded by a byte-level BPE (A) and by a piece
vocabulary with byte fallback (B). Byte offsets where a token of either ends cut the text into
groups; every token of A in a group is linked with every token of B in it. A pair of ids
counts as often as there are texts that hold it linked; a link is *best* where no other
pair of its A id counts more.

The work on some texts at a time is done in Arrow tables: the lists of ids are flattened,
parent indices tell each token's text, cumulative sums of token lengths less their value
at the text's start give end offsets, a hash join on the ends of all texts finds the common ones,
and grouped counts give each text's links by pair. A task collects texts into *chunks*
of bounded size: the chunk's distinct pairs with their partial counts, and for each text
the places of its pairs among these. Spark sums the partial counts by pair, the highest
count of each A id goes to all tasks (the vocabulary of A bounds it), and each chunk gets
the sums of its own pairs back; so what moves are distinct pairs of chunks, not links.

Texts are encoded by the libraries, each distinct stretch between single spaces once: no
match of A's pattern crosses a single space between two other characters than white
space, and a test of B's vocabulary shows that none of its pieces does.

Edge cases: a text that is null or empty, or that A's or B's tokens don't give back byte for
byte, has no tokens and only zeros, with an empty string for its groups; special
tokens' strings are plain text; a group of any size is linked in blocks; rows with equal
or null keys count by themselves; other columns, whatever their names, play no part;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobtrace.llm.byte_bpe import BETWEEN, byte_table
from mobtrace.llm.cross_entropy import packed, unpacked
from mobtrace.llm.storage import kept

#: Characters of text that are aligned at once, links that are written out at once, a group's links beyond which equal ids are put together first.
CHARS_AT_ONCE, LINKS_AT_ONCE, WIDE_GROUP = 3_000_000, 4_000_000, 4096
#: Pairs of texts in a chunk, and its texts.
CHUNK, CHUNK_DOCS = 8_000_000, 200_000
#: Stretches that a worker remembers, characters of the longest such stretch.
STRETCHES_KEPT, LONGEST_KEPT = 600_000, 64
#: A pair is one number: the id of A above this many bits, the id of B in them. A text's number in a slice stands above TEXT bits.
BITS, TEXT = 18, 36


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str):
    """Both tokenizers and the bytes of their tokens by id. Built once per Python worker."""
    import sentencepiece
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    back = {c: n for n, c in byte_table().items()}
    bytes_a = [b""] * a.get_vocab_size(with_added_tokens=True)
    for token, i in a.get_vocab(with_added_tokens=False).items():
        bytes_a[i] = bytes(back[c] for c in token)
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    within = any(re.search("[^▁]▁", p) for p in pieces)
    return a, b, bytes_a, bytes_b, within


class Stretches:
    """Ids of texts under both tokenizers as little-endian uint32, and whether they give the text's bytes back."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b, self.bytes_a, self.bytes_b, self.whole = load(path_a, path_b)
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    def encode(self, stretches: list[str]) -> Iterator[tuple[bytes, bytes, bool]]:
        """Each stretch begins with the space that B puts before a text by itself."""
        for at in range(0, len(stretches), 10_000):
            some = stretches[at : at + 10_000]
            of_b = self.b.encode([s[1:] for s in some], num_threads=1)
            for s, x, y in zip(some, self.a.encode_batch_fast(some, add_special_tokens=False), of_b, strict=True):
                ids, data = x.ids, s.encode()
                same = b"".join([self.bytes_a[i] for i in ids]) == data == b"".join([self.bytes_b[i] for i in y])
                yield np.array(ids, "<u4").tobytes(), np.array(y, "<u4").tobytes(), same

    def __call__(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        split = []
        for t in texts:
            if not t:
                split.append([])
            elif self.whole:
                split.append([" " + t])
            else:
                parts = BETWEEN.split(" " + t)
                parts[1:] = [" " + p for p in parts[1:]]
                split.append(parts)
        known, new = self.known, set()
        for parts in split:
            new.update(parts)
        new = list(new.difference(known))
        long: dict[str, tuple[bytes, bytes, bool]] = {}
        for s, found in zip(new, self.encode(new), strict=True):
            (known if len(s) <= LONGEST_KEPT else long)[s] = found
        ids_a, ids_b = [], []
        for parts in split:
            found = [long[s] if s in long else known[s] for s in parts] if long else [known[s] for s in parts]
            fit = all([x[2] for x in found])
            ids_a.append(b"".join([x[0] for x in found]) if fit else b"")
            ids_b.append(b"".join([x[1] for x in found]) if fit else b"")
        if len(known) > STRETCHES_KEPT:
            self.known = {}
        return ids_a, ids_b


def as_lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def token_ends(ids: pa.ListArray, sizes: pa.Array) -> pa.Table:
    """text, end and id of every token, end being its end offset in bytes within the text."""
    flat, text = pc.list_flatten(ids), pc.cast(pc.list_parent_indices(ids), pa.int64())
    total = pc.cumulative_sum(pc.take(sizes, flat))
    # the running sum before a text's first token is the segment's base
    before = pa.concat_arrays([pa.array([0], pa.int64()), pc.cast(total, pa.int64())])
    return pa.table([text, pc.subtract(total, pc.take(pc.take(before, pc.cast(ids.offsets, pa.int64())), text)), flat], ["text", "end", "id"])


def end_keys(tokens: pa.Table) -> pa.Array:
    """One number for each token's text and end, in the tokens' order."""
    return pc.add(pc.shift_left(tokens["text"], TEXT), pc.cast(tokens["end"], pa.int64())).combine_chunks()


def common_ends(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Keys of the ends of tokens of both, in order."""
    both = pa.table([a], ["key"]).join(pa.table([b], ["key"]), "key", join_type="inner", use_threads=False)
    return np.sort(both["key"].to_numpy())


def _put_together(group: np.ndarray, ids: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens by group with how often each stands there: one row for equal ids in wide groups, else one for each token."""
    there = wide[group]
    if not there.any():
        return group, ids, np.ones(len(ids), np.int64)
    few, n = np.unique((group[there].astype(np.int64) << 32) | ids[there], return_counts=True)
    group = np.concatenate([group[~there], few >> 32])
    ids, n = np.concatenate([ids[~there], few & 0xFFFFFFFF]), np.concatenate([np.ones((~there).sum(), np.int64), n])
    order = np.argsort(group, kind="stable")
    return group[order], ids[order], n[order]


def pair_counts(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, text: np.ndarray) -> pa.Table:
    """text, pair and n, how many links of the pair the text has, from tokens in order with their groups; ``text`` is each group's."""
    na, nb = np.bincount(group_a, minlength=len(text)), np.bincount(group_b, minlength=len(text))
    wide = na * nb > WIDE_GROUP
    group_a, ids_a, times_a = _put_together(group_a, ids_a, wide)
    group_b, ids_b, times_b = _put_together(group_b, ids_b, wide)
    nb = np.bincount(group_b, minlength=len(text))
    first, partners = (np.cumsum(nb) - nb)[group_a], nb[group_a]
    sums, parts, at = np.concatenate([[0], np.cumsum(partners)]), [], 0
    while at < len(group_a):
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + LINKS_AT_ONCE, "right")) - 1)
        of = np.repeat(np.arange(at, end), partners[at:end])
        to = first[of] + np.arange(len(of)) - (sums[of] - sums[at])
        keys = (text[group_a[of]] << TEXT) | (ids_a[of].astype(np.int64) << BITS) | ids_b[to]
        parts.append(_counted(pa.table([keys, times_a[of] * times_b[to]], ["key", "n"])))
        at = end
    if not parts:
        return pa.table([pa.array([], pa.int64())] * 3, ["text", "pair", "n"])
    links = (parts[0] if len(parts) == 1 else _counted(pa.concat_tables(parts))).sort_by("key")
    keys = links["key"].to_numpy()
    return pa.table([keys >> TEXT, keys & ((1 << TEXT) - 1), links["n"]], ["text", "pair", "n"])


def _counted(links: pa.Table) -> pa.Table:
    return links.group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"])


@lru_cache(maxsize=2)
def written(n_a: int, n_b: int) -> pa.Array:
    """Every id in decimal with what may follow it: of A a comma or a bar, of B a comma, a semicolon or nothing."""
    return pa.array([b"%d%s" % (i, after) for n, ends in ((n_a, (b",", b"|")), (n_b, (b",", b";", b""))) for after in ends for i in range(n)], pa.large_binary())


def group_digests(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, text: np.ndarray, texts: int, sizes: tuple[int, int]) -> list[str]:
    """SHA-256 of each text's groups written as ids of A by commas, a bar, ids of B, groups by semicolons."""
    na, nb = np.bincount(group_a, minlength=len(text)), np.bincount(group_b, minlength=len(text))
    ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
    which = np.empty(len(ids_a) + len(ids_b), np.int64)
    after = np.zeros(len(ids_a), np.int64)
    after[ends_a - 1] = 1
    which[np.arange(len(ids_a)) + (ends_b - nb)[group_a]] = ids_a + after * sizes[0]
    after = np.zeros(len(ids_b), np.int64)
    after[ends_b - 1] = 1
    last = np.searchsorted(text, np.arange(texts), "right") - 1  # a text's last group, where it has one
    some = np.bincount(text, minlength=texts) > 0
    after[ends_b[last[some]] - 1] = 2
    which[np.arange(len(ids_b)) + ends_a[group_b]] = ids_b + after * sizes[1] + 2 * sizes[0]
    said = pc.take(written(*sizes), pa.array(which))
    bytes_of = memoryview(said.buffers()[2] or b"")
    cuts = np.frombuffer(said.buffers()[1], np.int64)[: len(which) + 1] if len(which) else np.zeros(1, np.int64)
    tokens = np.concatenate([[0], np.cumsum(_summed(text, na + nb, texts))])
    return [hashlib.sha256(bytes_of[cuts[lo] : cuts[hi]]).hexdigest() if hi > lo else "" for lo, hi in zip(tokens, tokens[1:], strict=False)]


def aligned(ids_a: list[bytes], ids_b: list[bytes], sizes_a: pa.Array, sizes_b: pa.Array) -> tuple[dict[str, object], pa.Table]:
    """Numbers of each text, and its links by pair."""
    lists_a, lists_b = as_lists(ids_a), as_lists(ids_b)
    a, b = token_ends(lists_a, sizes_a), token_ends(lists_b, sizes_b)
    keys_a, keys_b = end_keys(a), end_keys(b)
    ends = common_ends(keys_a, keys_b)
    text = ends >> TEXT
    group_a, group_b = (np.searchsorted(ends, x.to_numpy()) for x in (keys_a, keys_b))
    of_a, of_b = a["id"].to_numpy(), b["id"].to_numpy()
    links = np.bincount(group_a, minlength=len(text)) * np.bincount(group_b, minlength=len(text))
    n = len(ids_a)
    each = {
        "n_a": pc.list_value_length(lists_a), "n_b": pc.list_value_length(lists_b),
        "n_groups": pa.array(np.bincount(text, minlength=n)), "n_links": pa.array(_summed(text, links, n)),
        "groups_sha256": pa.array(group_digests(group_a, of_a, group_b, of_b, text, n, (len(sizes_a), len(sizes_b))), pa.string()),
    }
    return each, pair_counts(group_a, of_a, group_b, of_b, text)


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def chunks(docs: DataFrame, key: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """Texts by chunks: their keys and numbers, the chunk's distinct pairs and in how many of its texts each is, and each text's pairs as places among these."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stretches = Stretches(path_a, path_b)
        sizes_a, sizes_b = (pa.array([len(x) for x in t], pa.int32()) for t in (stretches.bytes_a, stretches.bytes_b))
        chunk, held, n, docs_held = TaskContext.get().partitionId() << 32, [], 0, 0

        def row() -> pa.RecordBatch:
            keys = pa.concat_arrays([k for k, _, _ in held])
            columns = {c: pa.concat_arrays([pc.cast(e[c], pa.int64()) for _, e, _ in held]) for c in NUMBERS}
            columns["groups_sha256"] = pa.concat_arrays([e["groups_sha256"] for _, e, _ in held])
            lens = np.concatenate([np.bincount(p["text"].to_numpy(), minlength=len(k)) for k, _, p in held]).astype(np.uint32)
            pairs = np.concatenate([p["pair"].to_numpy() for _, _, p in held])
            times = np.concatenate([p["n"].to_numpy() for _, _, p in held])
            # in a text each pair stands once, so counting a pair's rows counts its texts
            own = pa.table([pairs], ["pair"]).group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"]).sort_by("pair")
            distinct = own["pair"].to_numpy()
            places = np.searchsorted(distinct, pairs)
            steps = np.diff(places, prepend=0)
            starts = (np.cumsum(lens, dtype=np.int64) - lens)[lens > 0]
            steps[starts] = places[starts]
            blobs = [packed(lens), packed(steps.astype(np.uint32)), packed(times.astype(np.int64)), packed(np.diff(distinct, prepend=0)), packed(own["n"].to_numpy().astype(np.uint32))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), x) for x in (keys, *columns.values())]
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *lists, *(pa.array([x], pa.binary()) for x in blobs)], names=["chunk", "ids", *columns, "lens", "steps", "times", "pairs", "n"])

        for batch in batches:
            at, size = 0, pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            while at < batch.num_rows:
                end = max(at + 1, at + int(np.searchsorted(np.cumsum(size[at:]), CHARS_AT_ONCE, "right")))
                ids_a, ids_b = stretches(batch.column(1).slice(at, end - at).to_pylist())
                each, pairs = aligned(ids_a, ids_b, sizes_a, sizes_b)
                held.append((batch.column(0).slice(at, end - at), each, pairs))
                n, docs_held, at = n + len(pairs), docs_held + end - at, end
                if n >= CHUNK or docs_held >= CHUNK_DOCS:
                    yield row()
                    chunk, held, n, docs_held = chunk + 1, [], 0, 0
        if held:
            yield row()

    lists = ", ".join(f"{c} array<long>" for c in NUMBERS)
    return docs.select(key, text).mapInArrow(run, f"chunk long, ids array<{kind}>, {lists}, groups_sha256 array<string>, lens binary, steps binary, times binary, pairs binary, n binary")


def chunk_pairs(encoded: DataFrame) -> DataFrame:
    """chunk, place, pair, n: a row for each distinct pair of a chunk, with its partial count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, n in zip(*batch.columns, strict=True):
                pairs, n = np.cumsum(unpacked(pairs.as_py(), np.int64)), unpacked(n.as_py(), np.uint32)
                for at in range(0, len(pairs), 100_000):
                    some = pairs[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()] * len(some), pa.int64()), pa.array(np.arange(at, at + len(some)), pa.int32()), pa.array(some), pa.array(n[at : at + len(some)].astype(np.int64))], names=["chunk", "place", "pair", "n"])

    return encoded.select("chunk", "pairs", "n").mapInArrow(run, "chunk long, place int, pair long, n long")


def pair_totals(partial: DataFrame) -> DataFrame:
    """pair, total (texts that hold it), best (no pair of the same A id has more)."""
    totals = kept(partial.groupBy("pair").agg(F.sum("n").alias("total")), "pairs")
    top = totals.groupBy(F.shiftright("pair", BITS).alias("of")).agg(F.max("total").alias("most"))
    joined = totals.join(F.broadcast(top), F.shiftright("pair", BITS) == F.col("of"))  # at most a row for each id of A
    return joined.select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def align(df: DataFrame, key: str = "doc_id", text: str = "text", path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Per row the numbers of its alignment, and the table of id pairs (id_a, id_b, total, best)."""
    own = default_vocabularies()
    kind = dict(df.dtypes)[key]
    encoded = kept(chunks(df, key, text, path_a or own[0], path_b or own[1]), "aligned")
    partial = chunk_pairs(encoded)
    totals = kept(pair_totals(partial), "pair-totals")
    sums = partial.select("chunk", "place", "pair").join(totals, "pair").select("chunk", "place", (F.col("total") * 2 + F.col("best").cast("long")).alias("total"))

    def run(chunk: pa.Table, own: pa.Table) -> pa.Table:
        ids = chunk["ids"].combine_chunks().flatten()
        lens, steps, times = (unpacked(chunk[c][0].as_py(), k) for c, k in (("lens", np.uint32), ("steps", np.uint32), ("times", np.int64)))
        total = np.zeros(len(own), np.int64)
        total[own["place"].to_numpy()] = own["total"].to_numpy()
        of = np.repeat(np.arange(len(lens)), lens)
        places = np.cumsum(steps, dtype=np.int64)
        starts = np.cumsum(lens, dtype=np.int64) - lens
        if len(places):  # a text's first step is its first place
            base = np.where(starts > 0, places[np.maximum(starts, 1) - 1], 0)
            places = places - base[of]
        found = total[places]
        columns = [chunk[c].combine_chunks().flatten() for c in NUMBERS]
        sums = [pa.array(_summed(of, x, len(lens))) for x in (times * (found & 1), times * (found >> 1))]
        return pa.table([ids, *columns, *sums, chunk["groups_sha256"].combine_chunks().flatten()], ["doc_id", *NUMBERS, "n_best", "count_sum", "groups_sha256"])

    numbers = ", ".join(f"{c} long" for c in (*NUMBERS, "n_best", "count_sum"))
    rows = encoded.drop("pairs", "n").groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(run, f"doc_id {kind}, {numbers}, groups_sha256 string")
    return rows, totals.select(F.shiftright("pair", BITS).alias("id_a"), (F.col("pair") % (1 << BITS)).alias("id_b"), "total", "best")
