"""Near-duplicate documents by MinHash bands, odd sketches and full shingle sets.

Documents with equal shingle sets form one node. A node's MinHash values give its
band keys, which propose candidates, and an odd sketch: a bitmap in which every
value flips one bit, so the bits in which two sketches differ estimate how many
values differ, and most precisely so at high similarity. A second bitmap folds the
whole set in the same way; the bits in which two of them differ never exceed the number
of shingles that only one document has. Candidates that pass both are confirmed
on the full sets.

No bucket is expanded into pairs: some member leads it and is compared with the others,
confirmed links merge nodes into components. A leader leaves its bucket once it was
compared. Members that are still in different components after some rounds are compared
where they share one of their rarest shingles: an exact prefix filter, in which texts
that have a common part and fall just short of the threshold don't meet.

Edge cases: a null, empty or blank text has an empty set and stays alone; fewer words
than a shingle has make one shingle of the whole sequence; rows without ``doc_id``
take part and get the smallest id of their component, or null if it has none; repeated
rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobtrace.llm.graph import components
from mobtrace.llm.storage import free_name, kept
from mobtrace.llm.words import U, constants, joined, mix, shingles


@dataclass(frozen=True)
class Plan:
    """Shingle length, similarity as ``num / den``, bands of ``rows`` values each, bits of a sketch.

    At similarity s a pair has no common band with probability ``(1 - s**rows)**bands``:
    4e-8 at 0.85 with 36 bands of 6, 1e-7 at 0.80 with 40 bands of 5.
    """

    words: int = 3
    num: int = 85
    den: int = 100
    bands: int = 36
    rows: int = 6
    bits: int = 512
    set_bits: int = 2048
    leaders: int = 3

    @property
    def values(self) -> int:
        return self.bands * self.rows

    def differing(self, similarity: float) -> float:
        """Bits in which two sketches differ on average."""
        return self.bits / 2 * (1 - (1 - 2 / self.bits) ** (2 * self.values * (1 - similarity)))

    def similarity(self, differing: float) -> float:
        """The estimate from the number of differing bits."""
        x = min(differing, self.bits / 2 - 1)
        return 1 + self.bits / (4 * self.values) * math.log(1 - 2 * x / self.bits)

    @property
    def most_differing(self) -> int:
        """A pair at the threshold differs in more bits with a probability below 1e-8 (six deviations)."""
        s = self.num / self.den
        m = 2 * self.values * (1 - s)
        slope = math.exp(-2 * m / self.bits)
        sampled = 4 * self.values * s * (1 - s) * slope**2
        folded = self.bits / 4 * (1 - math.exp(-4 * m / self.bits))
        return math.ceil(self.differing(s) + 6 * math.sqrt(sampled + folded))


#: Five words and a similarity of 0.8, for stages that no contract fixes.
USUAL = Plan(words=5, num=80, den=100, bands=40, rows=5)


def min_hashes(keys: np.ndarray, n: int) -> np.ndarray:
    turn, factor = constants(n, 23), constants(n, 29) | U(1)
    low = np.full(n, U(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(keys), 2048):
        part = keys[at : at + 2048]
        for k in range(0, n, 64):
            np.minimum(low[k : k + 64], ((part[:, None] ^ turn[k : k + 64]) * factor[k : k + 64]).min(axis=0), out=low[k : k + 64])
    return low


def parity(spots: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap in which every value of ``spots`` flips the bit that it falls on."""
    odd = np.bincount((spots % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signature(keys: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys, odd sketch of the MinHash values and odd sketch of the whole set."""
    low = min_hashes(keys, plan.values)
    order = constants(plan.rows, 31) | U(1)
    bands = mix((low.reshape(plan.bands, plan.rows) * order).sum(axis=1, dtype=U) + constants(plan.bands, 37))
    return bands.view(np.int64), parity(mix(low + constants(plan.values, 41)), plan.bits), parity(mix(keys + U(43)), plan.set_bits)


def signatures(docs: DataFrame, plan: Plan, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, md5, sets, bands, sketches, folded = [], [], [], [], [], []
            for t in batch.column(1).to_pylist():
                keys = shingles(t, plan.words)
                n.append(len(keys))
                md5.append(None if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest())
                sets.append(hashlib.blake2b(keys.tobytes(), digest_size=16).digest() if len(keys) else None)
                b, s, f = signature(keys, plan) if len(keys) else (None, None, None)
                bands.append(b)
                sketches.append(s)
                folded.append(f)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(md5, pa.binary()), pa.array(sets, pa.binary()), pa.array(bands, longs), pa.array(sketches, longs), pa.array(folded, longs)],
                names=["doc_id", "n_shingles", "md5", "set", "bands", "sketch", "folded"],
            )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"doc_id {kind}, n_shingles long, md5 binary, set binary, bands array<long>, sketch array<long>, folded array<long>")


def differing(a: Column, b: Column, bits: int) -> Column:
    """Bits in which two bitmaps differ."""
    total = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, bits // 64):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


def near(plan: Plan) -> Column:
    """Whether nodes a and b may reach the threshold, from their set sizes and bitmaps.

    At the threshold ``most`` shingles at most are in one set only. The whole-set bitmaps
    differ in no more bits than that, and, where sets are so large that many shingles
    share a bit, in no more than the usual number by six deviations.
    """
    m, n_a, n_b = float(plan.set_bits), F.col("n_a"), F.col("n_b")
    most = (n_a + n_b) * F.lit((plan.den - plan.num) / (plan.den + plan.num)) + 1e-9
    usual = m / 2 * (1 - F.exp(-2 * most / m)) + 6 * F.sqrt(m / 4 * (1 - F.exp(-4 * most / m)))
    sizes = plan.den * F.least(n_a, n_b) >= plan.num * F.greatest(n_a, n_b)
    sketches = differing(F.col("sketch_a"), F.col("sketch_b"), plan.bits) <= plan.most_differing
    return sizes & sketches & (differing(F.col("folded_a"), F.col("folded_b"), plan.set_bits) <= F.least(most, usual))


def confirmed(pairs: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """(a, b, linked): whether the full sets of a and b reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, U)
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for i in range(len(a)):
                if a[i] != last:
                    last, own = a[i], shingles(batch.column(2)[i].as_py(), plan.words)
                other = shingles(batch.column(3)[i].as_py(), plan.words)
                both = len(np.intersect1d(own, other, assume_unique=True))
                linked.append(plan.den * both >= plan.num * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    of_b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    of_a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    return pairs.select("a", "b").join(of_b, "b").join(of_a, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


def prefixes(members: DataFrame, texts: DataFrame, plan: Plan) -> DataFrame:
    """(id, label, n, prefix) of members (id, label): the set size and the rarest shingles.

    ``prefix`` holds (pos, x.n, x.key) of those shingles that other members have too. Sets are
    ordered by rarity among the members and then by key. Two sets at the threshold share a key
    in the first ``n - ceil(num * n / den) + 1`` places (Chaudhuri, Ganti and Kaushik 2006).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys = shingles(text.as_py(), plan.words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int64)), pa.array(keys)], names=["id", "key"])

    sets = texts.join(members, "id", "left_semi").select("id", "text").mapInArrow(run, "id long, key long")
    sets = kept(sets, "sets")
    often = kept(sets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    ranked = sets.join(often, "key", "left").groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "key"))).alias("keys"))
    n = F.size("keys")
    first = F.slice("keys", F.lit(1), n - F.ceil(plan.num * n / F.lit(plan.den) - 1e-9).cast("int") + 1)
    placed = F.transform(first, lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    ranked = ranked.select("id", n.alias("n"), F.filter(placed, lambda p: p["x"]["n"] > 1).alias("prefix"))
    return kept(members.join(ranked, "id"), "prefixes")


def sharing_rare(rare: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """Pairs (a, b) in different components that may reach the threshold, with the bits in which their sketches differ.

    The smaller set of a pair shares a key in its first ``n - ceil(2 * num * n / (den + num)) + 1``
    places already (Xiao and others 2008), so a key is a meeting place only where it is that rare.
    A key at places i and j leaves at most ``1 + min(n_a - i, n_b - j)`` common ones from there on.
    """
    both = F.lit(plan.den + plan.num)
    sides = []
    for x in "ab":
        own = nodes.select("id", *[F.col(c).alias(f"{t}_{x}") for c, t in (("n_shingles", "n"), ("sketch", "sketch"), ("folded", "folded"))])
        side = rare
        if x == "a":
            few = F.col("n") - F.ceil(2 * plan.num * F.col("n") / both - 1e-9) + 1
            side = side.withColumn("prefix", F.filter("prefix", lambda p: p["pos"] < few))
        side = side.filter(F.size("prefix") > 0).join(own, "id").select("*", F.explode("prefix").alias("p"))
        sides.append(side.select(F.col("p.x.key").alias(f"key_{x}"), F.col("p.pos").alias(f"pos_{x}"), F.col("id").alias(x), F.col("label").alias(f"of_{x}"), f"n_{x}", f"sketch_{x}", f"folded_{x}"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    left = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    enough = both * left >= plan.num * (F.col("n_a") + F.col("n_b"))
    meet = (F.col("key_a") == F.col("key_b")) & smaller & (F.col("of_a") != F.col("of_b")) & enough & near(plan)
    bits = differing(F.col("sketch_a"), F.col("sketch_b"), plan.bits)
    return sides[0].join(sides[1], meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), bits.alias("bits")).distinct()


class Linking:
    """Pairs that were compared so far, and the components that their links make."""

    def __init__(self, nodes: DataFrame, texts: DataFrame, plan: Plan):
        self.nodes, self.texts, self.plan = nodes, texts, plan
        self.compared = self.labels = None

    def labelled(self, rows: DataFrame, node: str, label: str) -> DataFrame:
        if self.labels is None:
            return rows.withColumn(label, F.col(node))
        of = self.labels.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
        rows = rows.join(of, F.col(node) == F.col("__node"), "left")
        return rows.withColumn(label, F.coalesce("__label", node)).drop("__node", "__label")

    def sketched(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that may reach the threshold, with the bits in which their sketches differ."""
        for x in "ab":
            own = self.nodes.select(F.col("id").alias(x), *[F.col(c).alias(f"{n}_{x}") for c, n in (("n_shingles", "n"), ("sketch", "sketch"), ("folded", "folded"))])
            pairs = pairs.join(own, x)
        bits = differing(F.col("sketch_a"), F.col("sketch_b"), self.plan.bits)
        return pairs.filter(near(self.plan)).select("a", "b", bits.alias("bits"))

    def add(self, pairs: DataFrame) -> None:
        """Confirms each node's nearest candidate first, then those pairs that are still in different components."""
        for turn in range(2):
            if self.compared is not None:
                pairs = pairs.join(self.compared.select("a", "b"), ["a", "b"], "left_anti")
            pairs = self.labelled(self.labelled(pairs, "a", "of_a"), "b", "of_b")
            pairs = kept(pairs.filter("of_a <> of_b").select("a", "b", "bits"), "pairs")
            if pairs.isEmpty():
                return
            first = pairs.groupBy("b").agg(F.min(F.struct("bits", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
            now = kept(confirmed(pairs if turn else first, self.texts, self.plan), "compared")
            self.compared = now if self.compared is None else self.compared.unionByName(now)
            self.merge(now.filter("linked").select("a", "b"))

    def merge(self, links: DataFrame) -> None:
        """Joins the components that new links connect. Only links between components are walked, each in one round."""
        between = self.labelled(self.labelled(links, "a", "of_a"), "b", "of_b").filter("of_a <> of_b")
        between = kept(between.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct(), "between")
        if between.isEmpty():
            return
        ends = links.select(F.col("a").alias("node")).union(links.select("b"))
        if self.labels is not None:
            ends = ends.union(self.labels.select("node"))
        own = self.labelled(ends.distinct(), "node", "own")
        found = components(between).select(F.col("node").alias("__of"), F.col("label").alias("__to"))
        joined = own.join(found, F.col("own") == F.col("__of"), "left")
        self.labels = kept(joined.select("node", F.coalesce("__to", "own").alias("label")), "labels")


def grouped(docs: DataFrame, plan: Plan, key: str, text: str) -> DataFrame:
    """doc_id, md5 of the text, n_shingles, component_id, and label: a number of the component, null for empty sets."""
    signed = kept(signatures(docs, plan, key, text), "signed")
    first = F.struct("doc_id", "md5", "n_shingles", "bands", "sketch", "folded")
    nodes = signed.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("least_doc"), F.min(first).alias("x"))
    nodes = kept(nodes.select(F.monotonically_increasing_id().alias("id"), "set", "least_doc", "x.*"), "nodes")

    buckets = nodes.select("id", F.explode("bands").alias("band"))
    # sums by band are written before they meet rows of the same band, so that joins on hot bands can be split
    shared = kept(buckets.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band"), "shared")
    rows = kept(buckets.join(shared, "band"), "members")
    wanted = nodes.join(rows.select("id").distinct(), "id").select("id", F.col("doc_id").alias("rep_id"), F.col("md5").alias("rep_md5"))
    source = docs.select(F.col(key).alias("doc_id"), F.unhex(F.md5(F.col(text))).alias("md5"), F.col(text).alias("text"))
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("md5") == F.col("rep_md5")))
    texts = kept(texts.select("id", "text").dropDuplicates(["id"]), "texts")
    linking = Linking(nodes, texts, plan)
    for turn in range(plan.leaders):
        # each band and turn orders the members in its own way, so that others lead
        mask = F.xxhash64("band", F.lit(turn)).bitwiseAND(F.lit(2**62 - 1))
        lead = rows.groupBy("band").agg(F.min(F.col("id").bitwiseXOR(mask)).alias("least"))
        lead = kept(lead.select("band", F.col("least").bitwiseXOR(mask).alias("lead")), "leaders")
        pairs = rows.select("band", "id").join(lead, "band").filter("id <> lead")
        pairs = pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
        linking.add(linking.sketched(pairs))
        # a leader was compared with all of its bucket
        rows = rows.select("band", "id").join(lead, "band").filter("id <> lead").select("band", "id")
        rows = kept(linking.labelled(rows, "id", "label"), "rows")
        apart = rows.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("band")
        apart = kept(apart, "apart")
        rows = kept(rows.join(apart, "band", "left_semi"), "rows")
        if rows.isEmpty():
            break
    else:
        members = kept(linking.labelled(rows.select("id").distinct(), "id", "label"), "members")
        linking.add(sharing_rare(prefixes(members, texts, plan), nodes, plan))

    of = linking.labelled(nodes.select("set", "least_doc", "id"), "id", "label")
    of = kept(of, "of")
    least = kept(of.groupBy("label").agg(F.min("least_doc").alias("component_id")), "least")
    of = of.join(least, "label").select("set", "component_id", "label")
    linked = signed.filter("set is not null").join(of, "set").select("doc_id", "md5", "n_shingles", "component_id", "label")
    alone = signed.filter("set is null").select("doc_id", "md5", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that can be reached), kept (it is the row's own)."""
    rows = grouped(docs, plan, key, text)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, plan: Plan = USUAL, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; rows without words all stay."""
    md5, name = F.md5(F.col(text)), lambda i, m: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("")), m)
    rows = grouped(docs, plan, key, text).withColumn("name", name(F.col("doc_id"), F.lower(F.hex("md5"))))
    first = rows.filter("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "name")).alias("x"))
    own, of = free_name(docs, "name"), free_name(docs, "stays")
    stay = kept(first.select(F.col("x.name").alias(of)).distinct(), "stay")
    worded = docs.withColumn(own, name(F.col(key), md5)).join(stay, F.col(own) == F.col(of))
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return worded.dropDuplicates([own]).select(*docs.columns).unionByName(docs.filter(blank))
