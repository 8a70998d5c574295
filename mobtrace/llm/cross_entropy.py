"""Cross-entropy difference of documents under a target and a background model.

Both are bigram models of the same form over one vocabulary: every word of the corpus, or
with ``size`` the commonest ones, all others being one unknown word. The target model
counts the target rows, the background model the whole corpus. They are matched in all
else: background counts are scaled to the number of words of the target, so that smoothing
weighs the same in both, and neither model has seen the document that it scores (its own
counts are taken off). With counts n, scaled by r, a word's probability after another is
``(r n(v w) + WEIGHT * u(w)) / (r n(v) + WEIGHT)``, where ``u(w) = (r n(w) + 1) / (N + V)``,
N is the target's words and V the vocabulary. A document's score is the mean over its words
of what the target model loses less what the background loses (in nats); the lower, the
more the text resembles the target.

Counts cover every row and stay in Spark. Texts become chunks of word numbers, kept as a
table. A chunk sends its counts of words and bigrams, packed, to buckets of their keys; a
bucket sums them over all chunks and sends each chunk the sums of what it sent; with these
the chunk's documents are scored. What a chunk or a bucket holds is bounded, their numbers
grow with the input, and no table of counts comes to the driver or to every task.

Words are runs of characters other than white space, ASCII letters in lower case. Edge
cases: null or blank text has no words and null losses; without target rows all
losses are null; rows without ``doc_id`` are background and repeated rows count
each; ties in frequency are broken by the word's key; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobtrace.llm.storage import kept
from mobtrace.llm.words import LOWER, U, mix, word_keys

#: Words of a limited vocabulary, the unknown word included; words that the unigram share of a bigram's probability counts for.
VOCABULARY, WEIGHT = 2048, 5.0
_WORDS_AT_ONCE = 1_000_000
#: Words of a chunk (and its documents), words of the corpus for each bucket.
_CHUNK, _CHUNK_DOCS, _BUCKET = 2_000_000, 100_000, 4_000_000


def keys_of(text: str | None) -> np.ndarray:
    return word_keys((text or "").encode("utf-8", "surrogatepass").translate(LOWER)).view(np.int64)


def _groups(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """Word keys of some texts at a time."""
    keys, n = [], 0
    for text in texts:
        keys.append(keys_of(text.as_py()))
        n += len(keys[-1])
        if n >= _WORDS_AT_ONCE:
            yield keys
            keys, n = [], 0
    if keys:
        yield keys


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """How often each word key occurs, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in _groups(batch.column(0)):
                word, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def chunks(docs: DataFrame, key: str, text: str, vocabulary: np.ndarray | None) -> DataFrame:
    """Documents by chunks: their ids, numbers of words, the chunk's distinct word keys, and the words as places in these."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, ids, keys, n = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            own = pa.concat_arrays(ids)
            words, place = np.unique(np.concatenate(keys).view(U), return_inverse=True)
            lens = np.array([len(k) for k in keys], np.uint32)
            blobs = [pa.array([packed(x)], pa.binary()) for x in (lens, words, place.astype(np.uint32))]
            columns = [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([n], pa.int64()), *blobs]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "n_words", "lens", "words", "places"])

        for batch in batches:
            for i in range(batch.num_rows):
                k = keys_of(batch.column(1)[i].as_py())
                if vocabulary is not None:
                    k = known(k, vocabulary)
                ids.append(batch.column(0).slice(i, 1))
                keys.append(k)
                n += len(k)
                if n >= _CHUNK or len(keys) >= _CHUNK_DOCS:
                    yield row()
                    chunk, ids, keys, n = chunk + 1, [], [], 0
        if keys:
            yield row()

    return docs.select(key, text).mapInArrow(run, f"chunk long, ids array<{kind}>, n_words long, lens binary, words binary, places binary")


def known(keys: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The keys, 0 for words that are not in the sorted vocabulary."""
    if not len(vocabulary):
        return np.zeros_like(keys)
    at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
    return np.where(vocabulary[at] == keys, keys, 0)


def items(lens: np.ndarray, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted keys of a chunk's bigrams, first words and second words, and for each word of the chunk the places of its three.

    A text begins after the unknown word. The last two bits of a key tell its kind.
    """
    every = np.append(words, U(0))
    before = np.empty(len(places), np.int64)
    before[1:] = places[:-1]
    before[(np.cumsum(lens, dtype=np.int64) - lens)[lens > 0]] = len(words)
    pairs, pair = np.unique(before * len(every) + places, return_inverse=True)
    first, second = np.divmod(pairs, len(every))
    bare = U(0xFFFFFFFFFFFFFFFC)
    found = [mix(mix(every[first]) + every[second] * U(0x9E3779B97F4A7C15)) & bare, mix(every ^ U(0x5851F42D4C957F2D)) & bare | U(1), mix(words ^ U(0x2545F4914F6CDD1D)) & bare | U(2)]
    keys, at = np.unique(np.concatenate(found), return_inverse=True)
    a, b = len(pairs), len(pairs) + len(every)
    return keys, [at[:a][pair], at[a:b][before], at[b:][places]]


def counted(encoded: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, and the keys, counts and counts in target rows of what the chunk has in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, lens, words, places, targets = (x[i].as_py() for x in batch.columns)
                lens = unpacked(lens, np.uint32)
                keys, at = items(lens, unpacked(words, U), unpacked(places, np.uint32))
                own = np.zeros(len(lens), bool)
                own[targets or []] = True
                own = np.repeat(own, lens)
                n, t = (sum(np.bincount(x, minlength=len(keys)) for x in part) for part in (at, [x[own] for x in at]))
                bucket = ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
                cuts, rows = np.searchsorted(bucket, np.arange(buckets + 1)), []
                for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    if hi > lo:
                        steps = np.diff(keys[lo:hi], prepend=U(0))
                        rows.append((b, chunk, packed(steps), packed(n[lo:hi].astype(np.uint32)), packed(t[lo:hi].astype(np.uint32))))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.int64()] * 2 + [pa.binary()] * 3, strict=True)], names=["bucket", "chunk", "steps", "n", "t"])

    return encoded.select("chunk", "lens", "words", "places", "targets").mapInArrow(run, "bucket long, chunk long, steps binary, n binary, t binary")


def summed(counts: DataFrame) -> DataFrame:
    """The same rows with the counts over all chunks, and the number of distinct second words of the bucket."""

    def run(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(unpacked(x.as_py(), U), dtype=U) for x in group["steps"]]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        cuts, sums = np.cumsum([len(k) for k in keys])[:-1], []
        for c in ("n", "t"):
            given = np.concatenate([unpacked(x.as_py(), np.uint32) for x in group[c]])
            total = np.bincount(at, given, len(every)).astype(np.uint64)
            sums.append(pa.array([packed(x) for x in np.split(total[at], cuts)], pa.binary()))
        seen = np.bincount(at[np.concatenate([unpacked(x.as_py(), np.uint32) for x in group["n"]]) > 0], minlength=len(every)) > 0
        distinct = int(((every & U(3) == 2) & seen).sum())
        return pa.table([group["bucket"], group["chunk"], *sums, pa.array([distinct] * len(group), pa.int64())], ["bucket", "chunk", "n", "t", "distinct"])

    return counts.groupBy("bucket").applyInArrow(run, "bucket long, chunk long, n binary, t binary, distinct long")


def score(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", size: int | None = None) -> DataFrame:
    """doc_id, n_words, target and background cross-entropy and their difference for every row.

    ``target`` has the ids of the target rows. ``size`` limits the vocabulary (to VOCABULARY words, say); None keeps every word.
    """
    ids = target.select(F.col(key).alias("__of")).filter("__of is not null").distinct()
    vocabulary = None
    if size is not None:
        top = word_counts(docs, text).orderBy(F.desc("n"), "word").limit(size - 1).collect()
        vocabulary = np.sort(np.array([r.word for r in top], np.int64))
    encoded = kept(chunks(docs, key, text, vocabulary), "chunks")
    total = encoded.agg(F.sum("n_words")).first()[0] or 0
    # only ids move to find the target rows
    own = encoded.select("chunk", F.posexplode("ids").alias("pos", "id")).join(ids, F.col("id") == F.col("__of"))
    own = own.groupBy("chunk").agg(F.collect_list("pos").alias("targets"))
    marked = encoded.filter("n_words > 0").join(own, "chunk", "left")
    sums = kept(summed(counted(marked, max(1, -(-total // _BUCKET)))), "sums")
    if size is None:
        size = 1 + (sums.groupBy("bucket").agg(F.max("distinct").alias("n")).agg(F.sum("n")).first()[0] or 0)
    marked = encoded.join(own, "chunk", "left")
    return scored(marked, sums, total, _target_words(encoded, own), size, dict(docs.dtypes)[key])


def _target_words(encoded: DataFrame, own: DataFrame) -> int:
    """Words of all target rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(unpacked(lens.as_py(), np.uint32)[at.as_py()].sum()) for lens, at in zip(*batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])

    return encoded.select("chunk", "lens").join(own, "chunk").select("lens", "targets").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def within(of_word: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """For each word, how often its item occurs in its own document."""
    _, at, count = np.unique(of_word * n + place, return_inverse=True, return_counts=True)
    return count[at]


def scored(marked: DataFrame, sums: DataFrame, total: int, total_target: int, size: int, kind: str) -> DataFrame:
    """Each document's losses from its chunk and what the buckets sent to it."""

    def run(chunk: pa.Table, own: pa.Table) -> pa.Table:
        ids = chunk["ids"].combine_chunks().flatten()
        lens, words, places = (unpacked(chunk[c][0].as_py(), k) for c, k in (("lens", np.uint32), ("words", U), ("places", np.uint32)))
        columns, none = [], lens == 0
        if total_target and len(places):
            keys, at = items(lens, words, places)
            own = own.sort_by("bucket")
            of_word = np.repeat(np.arange(len(lens)), lens)
            target = np.zeros(len(lens), bool)
            target[chunk["targets"][0].as_py() or []] = True
            n_target = total_target - np.where(target, lens, 0).astype(np.int64)
            scale = n_target / np.maximum(total - lens.astype(np.int64), 1)
            mine = [within(of_word, x, len(keys)) for x in at]
            for c, less, r in (("t", target[of_word], np.ones(len(of_word))), ("n", True, scale[of_word])):
                sent = np.concatenate([unpacked(x.as_py(), np.uint64) for x in own[c]]).astype(np.int64)
                pair, first, second = ((sent[x] - np.where(less, m, 0)) * r for x, m in zip(at, mine, strict=True))
                single = (second + 1) / (n_target[of_word] + size)
                loss = -np.log((pair + WEIGHT * single) / (first + WEIGHT))
                columns.append(pa.array(np.bincount(of_word, loss, len(lens)) / np.maximum(lens, 1), pa.float64(), mask=none))
        else:
            columns = [pa.nulls(len(lens), pa.float64())] * 2
        return pa.table([ids, pa.array(lens.astype(np.int64)), *columns], ["doc_id", "n_words", "ce_target", "ce_background"])

    both = marked.drop("n_words").groupBy("chunk").cogroup(sums.drop("distinct").groupBy("chunk"))
    found = both.applyInArrow(run, f"doc_id {kind}, n_words long, ce_target double, ce_background double")
    return found.withColumn("ce_difference", F.col("ce_target") - F.col("ce_background"))
