"""Personal data by fixed forms, and by patterns bootstrapped from them.

The base forms (e-mail address, IP address, payment card, phone number) are found in
every text and are the seeds. What stands to the left of a seed is a lexical pattern: the
last two words within ``REACH`` characters, or the last one if it is glued to the seed, with
the marks behind them. Other tokens that look like identifiers and stand in the same
context are its unseen instances. Spark scores the graph of patterns and instances in
rounds: a pattern is worth the summed scores of the distinct instances of a kind that it
extracts, as a share of these and of the instances that can't be of that kind; an instance
is worth as much as its accepted patterns make likely, and instances that were accepted
support further patterns. A pattern is accepted from ``SUPPORT`` points and a share of
``PRECISION``, and stays; rounds end when none is added. Instances must also look like the
pattern's kind. Base spans always stay.

Candidates are the tokens with digits or @, of any length, between white space, quotes,
brackets, slashes and the like. Numbers go on over single spaces as far as they look like
a kind; no kind that has spaces is longer than ``WIDEST`` characters.

Edge cases: a null text is empty and has no spans; very long tokens and digit runs are
read in linear time; rows without ``doc_id`` and repeated rows are rows of their own, but
repeated values count once in a pattern's score; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobtrace.llm.storage import free_name, kept

KINDS = ("email", "ip", "card", "phone")
SUPPORT, PRECISION = 5, 0.8
#: Characters before an instance in which its pattern lies, and of a number with spaces at most.
REACH, WIDEST = 200, 44
#: Accepted patterns that a redaction hands to its tasks as a dictionary; beyond it joins.
PATTERNS_SENT = 50_000

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_BETWEEN = frozenset("\"'<>[]{}|,;=&?#!*`/\\")
_STOP = re.compile(r"""[\s"'<>\[\]{}|,;=&?#!*`/\\]""")
_WORD = re.compile(r"\w+")
_NUMBER = re.compile(r"[+(]*[0-9][0-9().-]*")
_FITS = {
    "email": re.compile(r"[^@\s]+@[^@\s]+"),
    "ip": re.compile(r"[0-9A-Fa-f]{1,4}(?:[.:]{1,2}[0-9A-Fa-f]{1,4}){3,7}"),
    "card": re.compile(r"(?:[0-9][ -]?){12,19}"),
    "phone": re.compile(r"[(]?[0-9](?:[ ().-]{0,2}[0-9]){6,14}"),
}


def luhn(digits: str) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(int(d) if i % 2 == 0 else twice[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    place = free = 0
    while m := _DOMAIN.search(text, place):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            place = free = m.end()
        else:
            place = m.start() + 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed forms, by start and then by kind; code points, end exclusive."""
    found = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(_small(p) for p in m.group().split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and m.end() - m.start() <= 37:
            digits = re.sub("[ -]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), m.end(), 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def context(text: str, start: int) -> str:
    """The lexical pattern before ``start``, in lower case; ^ stands for the text's beginning."""
    glued = start > 0 and not text[start - 1].isspace()
    near = text[max(0, start - REACH) : start].lower()
    words = list(_WORD.finditer(near))[-1 if glued else -2 :]
    pattern = " ".join((near[words[0].start() :] if words else "^" + near).split())
    return pattern if glued or not words else pattern + " "


def candidates(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, list[str]]]:
    """Tokens with digits or @ that touch no base span, and the kinds that each could be."""
    place = at = 0
    while m := _MARK.search(text, place):
        start, stop = m.start(), _STOP.search(text, m.end())
        while start > place and not text[start - 1].isspace() and text[start - 1] not in _BETWEEN:
            start -= 1
        start = max(start, text.rfind(":", start, m.start()) + 1)
        ends = [stop.start() if stop else len(text)]
        part = start  # numbers go on over single spaces
        while ends[-1] < len(text) and text[ends[-1]] == " " and _NUMBER.fullmatch(text, part, ends[-1]):
            part = ends[-1] + 1
            stop = _STOP.search(text, part)
            further = stop.start() if stop else len(text)
            if further - start > WIDEST or not _NUMBER.match(text, part, further):
                break
            ends.append(further)
        for end in reversed(ends):
            first, last = start, end
            while last > first and text[last - 1] in ")].,;:!?":
                last -= 1
            while first < last and text[first] in "([{" and not (text[first] == "(" and ")" in text[first:last]):
                first += 1
            fits = [k for k in (KINDS if end == ends[0] else KINDS[2:]) if _FITS[k].fullmatch(text, first, last)]
            if fits:
                break
        while at < len(base) and base[at][1] <= first:
            at += 1
        free, near = last > first, at
        while free and near < len(base) and base[near][0] < last:
            free = base[near][1] <= first
            near += 1
        if free:
            yield first, last, fits
        place = max(end, m.end())


def _value(text: str, start: int, end: int) -> int:
    return int.from_bytes(hashlib.blake2b(text[start:end].lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


SPAN = "struct<start:int,end:int,kind:string>"
SEEN = "struct<start:int,end:int,context:string,value:long,seed:string,fits:array<string>>"


def read_texts(docs: DataFrame, key: str, text: str, keep_text: bool = False) -> DataFrame:
    """One row per document: its base spans, and every seed and candidate with its context."""
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    seen_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("context", pa.string()), ("value", pa.int64()), ("seed", pa.string()), ("fits", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, seen = [], []
            for i in range(batch.num_rows):
                t = batch.column(1)[i].as_py() or ""
                base = base_spans(t)
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in base])
                both = [(a, b, k, [k]) for a, b, k in base] + [(a, b, None, fits) for a, b, fits in candidates(t, base)]
                seen.append([{"start": a, "end": b, "context": context(t, a), "value": _value(t, a, b), "seed": k, "fits": f} for a, b, k, f in both])
            columns = [batch.column(0), pa.array(spans, span_type), pa.array(seen, seen_type)]
            names = ["doc_id", "base", "seen"]
            if keep_text:
                columns.append(batch.column(1))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {dict(docs.dtypes)[key]}, base array<{SPAN}>, seen array<{SEEN}>" + (", text string" if keep_text else "")
    return docs.select(key, text).mapInArrow(run, schema)


def patterns(read: DataFrame, support: float = SUPPORT, precision: float = PRECISION) -> DataFrame:
    """Accepted (context, kind, worth), scored over the graph of contexts and values until no context is added."""
    seen = read.select(F.explode("seen").alias("x")).select("x.context", "x.value", "x.seed", "x.fits")
    edges = seen.groupBy("context", "value").agg(F.max("seed").alias("seed"), F.max("fits").alias("fits"))
    edges = kept(edges, "pii-pairs")
    # sums are written before they meet rows of the same key, so that joins on hot contexts can be split
    often = kept(edges.groupBy("context").agg(F.count("*").alias("size")).filter(F.col("size") >= support), "pii-often")
    edges = kept(edges.join(often, "context"), "pii-edges")
    seeds = edges.filter("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    fitting = edges.select("context", F.explode("fits").alias("kind")).groupBy("context", "kind").agg(F.count("*").alias("fit"))
    scores, good = kept(seeds, "pii-scores"), None
    while True:
        worth = edges.select("context", "size", "value").join(scores, "value").groupBy("context", "size", "kind").agg(F.sum("score").alias("points"))
        against = F.col("size") - F.col("fit")
        worth = worth.join(fitting, ["context", "kind"]).withColumn("worth", F.round(F.col("points") / (F.col("points") + against), 9))
        more = worth.filter((F.col("points") >= support) & (F.col("worth") >= precision)).select("context", "kind", "worth")
        if good is not None:
            more = more.join(good.select("context", "kind"), ["context", "kind"], "left_anti")
        more = kept(more, "pii-patterns")
        if more.isEmpty():
            return more if good is None else good
        good = more if good is None else kept(good.unionByName(more), "pii-patterns")
        new = edges.filter("seed is null").join(good, "context").filter(F.array_contains("fits", F.col("kind")))
        new = new.groupBy("value", "kind").agg((1 - F.product(1 - F.col("worth"))).alias("score"))
        scores = kept(seeds.unionByName(new.join(seeds.select("value"), "value", "left_anti")), "pii-scores")


def _texts(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _ordered(spans: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def with_found(read: DataFrame, good: DataFrame) -> DataFrame:
    """``read`` (with its row numbers) and the column ``spans``: base spans and those that patterns find."""
    seen = read.select("row", F.explode("seen").alias("x")).filter("x.seed is null and size(x.fits) > 0").select("row", "x.*")
    kind = F.expr("array_position(array('email', 'ip', 'card', 'phone'), kind)")
    hits = seen.join(good, "context").filter(F.array_contains("fits", F.col("kind")))
    best = hits.groupBy("row", "start", "end").agg(F.min_by("kind", F.struct(-F.col("worth"), kind)).alias("kind"))
    found = best.groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("found"))
    out = read.join(found, "row", "left")
    return out.withColumn("spans", _ordered(F.concat("base", F.coalesce("found", F.array().cast(f"array<{SPAN}>"))))).drop("found")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, base and spans (arrays of start, end, kind) of every row."""
    read = read_texts(docs, key, text, keep_text).withColumn("row", F.monotonically_increasing_id())
    read = kept(read, "pii-read")
    return with_found(read, patterns(read)).drop("row", "seen")


def digests(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, SHA-256 of their list, and the list of all spans."""
    found = find(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_texts(F.col("base")), 256).alias("base_sha256"), _texts(F.col("spans")).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span becomes its kind in brackets; of overlapping spans one mask, of the first, covers all."""
    parts, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def _mask_with(good: dict[tuple[str, str], float]) -> Callable:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for t in batch:
                if t is None:
                    out.append(None)
                    continue
                base = base_spans(t)
                more = []
                if good:
                    for a, b, fits in candidates(t, base):
                        c = context(t, a)
                        kinds = [(-good[c, k], KINDS.index(k)) for k in fits if (c, k) in good]
                        if kinds:
                            more.append((a, b, KINDS[min(kinds)[1]]))
                out.append(masked(t, base + more) if base or more else t)
            yield pd.Series(out)

    return run


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` masked; the columns stay.

    Accepted patterns go to the tasks as a dictionary only if they are PATTERNS_SENT at
    most; more are joined to the contexts, which moves the texts of rows that have some.
    """
    none = free_name(docs, "key")
    read = kept(read_texts(docs.withColumn(none, F.lit(0)), none, text), "pii-read")
    good = patterns(read)
    some = good.limit(PATTERNS_SENT + 1).collect()
    if len(some) <= PATTERNS_SENT:
        sent = {(r.context, r.kind): r.worth for r in some}

        mask = F.pandas_udf(_mask_with(sent), "string")
        return docs.withColumn(text, mask(F.col(text))).select(*docs.columns)
    row, found = free_name(docs, "row"), free_name(docs, "spans")
    rows = kept(docs.withColumn(row, F.monotonically_increasing_id()), "pii-rows")
    again = read_texts(rows, row, text).withColumnRenamed("doc_id", "row")
    spans = with_found(again, good).filter("size(spans) > 0").select(F.col("row").alias(row), F.col("spans").alias(found))

    @F.pandas_udf("string")
    def cover(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return texts.combine(lists, lambda t, s: masked(t, [(x["start"], x["end"], x["kind"]) for x in s]) if t is not None and s is not None else t)

    return rows.join(spans, row, "left").withColumn(text, cover(F.col(text), F.col(found))).select(*docs.columns)
