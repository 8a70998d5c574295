"""WARC archives: a writer of response and revisit records, and a reader that salvages.

The writer's archives are WARC files with a gzip member for each record, so that damage
takes the record it meets only; Spark writes them to the shared folder, in files that are
bounded by bytes (a larger record has a file of its own). The reader takes whole archive
files, plain or of gzip members that hold one or more records; a task holds one file, and
what one of its members inflates to. It trusts a record only if its version line, headers, length, end mark and digests hold;
after a failed check it searches for the next gzip member or version line, recovers the
records from there on, and logs the bytes between as a quarantined gap. Of a broken
member it keeps the records before the damage, and goes on at the next member.

A payload may quote records. One whose length and end mark hold but whose digest fails is a
gap as a whole, and so is the rest of a broken member from the first record on whose end
isn't sound, so what these quote is not taken for records. If in a plain file, or in a member that is whole, the length, the end
mark or the headers are damaged, or a plain file is cut off within a block, nothing
tells where the record ends: the search then goes into it, and a sound record that it quotes comes out
although the archive has no such record. Its range lies behind a gap; who must rule such ones out
leaves out what follows a gap within one file or member. A damaged length that happens to
lead to another record's end mark hides what lies between.

Edge cases: a null payload is empty; equal payloads, empty ones too, make one group whose
largest page_id is the response; rows of that same id are all responses; rows without id
revisit the group's response, or are responses if no row of it has one; repeated rows
are records each; other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mobtrace.llm.storage import fresh_path, kept

VERSION = b"WARC/1.1"
END = "\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_START = re.compile(rb"WARC/1\.[01]\r\n|" + re.escape(MEMBER))
_MEMBER = re.compile(re.escape(MEMBER))
_LINE = re.compile(rb"WARC/1\.[01]\r\n")

RECORD = "record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload_sha1 string, target_uri string, payload binary"
FOUND = f"path string, start long, end long, gap string, {RECORD}"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: each 5 hex digits are 4 digits of 5 bits."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def four(value: Column) -> Column:
        return F.concat(*[F.substring(F.lit(digits), F.shiftright(value, 15 - 5 * i).bitwiseAND(31) + 1, F.lit(1)) for i in range(4)])

    def all_of(sha: Column) -> Column:
        value = lambda g: F.conv(F.substring(sha, g * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.array_join(F.transform(F.transform(F.sequence(F.lit(0), F.lit(7)), value), four), "")

    return F.transform(F.array(F.sha1(payload)), all_of)[0]


def plan_records(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """page_id, url, text, digest, n_bytes, record_type, refers_to."""
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    uri = F.col(url).cast("string") if url in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), uri.alias("url"), text.alias("text"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("text", "UTF-8"))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    # only payloads that occur again are looked up, in a table written before: where it is small it is sent, else the join can be split
    again = rows.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    first = kept(again.select(F.col("digest").alias("of"), F.col("n_bytes").alias("of_bytes"), "first"), "repeated")
    rows = rows.join(first, (F.col("digest") == F.col("of")) & (F.col("n_bytes") == F.col("of_bytes")), "left").drop("of", "of_bytes")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(revisit, "revisit").otherwise("response")
    return rows.withColumn("record_type", kind).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def write(records: DataFrame, path: str, piece: int = 8_000_000, pieces_per_file: int = 4) -> None:
    """One WARC record per row, a gzip member each; a revisit has headers only and names the response it repeats.

    Members are written in pieces of about ``piece`` bytes, and a file has ``pieces_per_file``.
    """
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    clean = F.coalesce(F.regexp_replace("url", r"[\r\n]", " "), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("text")))
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION.decode()),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), clean),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), base32_sha1(F.encode(block, "UTF-8"))),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {SAME_PAYLOAD}\r\nWARC-Refers-To: "), name(F.col("refers_to")))),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, size = [], 0
        for batch in batches:
            for x in batch.column(0):
                members.append(gzip.compress(x.as_py().encode("utf-8", "surrogatepass") + END.encode(), 6, mtime=0))
                size += len(members[-1])
                if size > piece:
                    yield pa.RecordBatch.from_arrays([pa.array([joined(members)], pa.binary())], names=["value"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([joined(members)], pa.binary())], names=["value"])

    lines = records.select(F.concat(head, F.lit(END), block).alias("value")).mapInArrow(run, "value binary")
    # the text writer takes any bytes; the line end is the last byte of each piece
    lines.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", pieces_per_file).text(path)


def joined(members: list[bytes]) -> bytes:
    """Gzip members but for the last byte, which is 0: the top byte of the last one's size, or after 16 MB that of an empty member."""
    data = b"".join(members)
    return (data if data[-1] == 0 else data + gzip.compress(b"", mtime=0))[:-1]


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _id(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


class Damaged(ValueError):
    """A record that fails a check although its end is known: by its length and end mark, or, beyond the data, by its length alone."""

    def __init__(self, why: str, end: int):
        super().__init__(why)
        self.end = end


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record whose version line is at ``at``, and where it ends. ValueError says which check failed, Damaged besides where the record ends."""
    m = _LINE.match(data, at)
    if not m:
        raise ValueError("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise ValueError("headers don't end")
    fields: dict[str, str] = {}
    for line in data[m.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ValueError("bad header line")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = fields.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise ValueError("bad length")
    start, end = stop + 4, stop + 4 + int(length)
    if end + 4 > len(data):
        raise Damaged("no end mark after the block", end + 4)
    if data[end : end + 4] != END.encode():
        raise ValueError("no end mark after the block")
    block = data[start:end]
    own = fields.get("warc-block-digest", "").removeprefix("sha1:")
    if own and own != _sha1(block):
        raise Damaged("block digest differs", end + 4)
    kind, payload = fields.get("warc-type", ""), None
    if kind == "response":
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4 :] if cut >= 0 else block
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    sha1 = None if payload is None else _sha1(payload)
    if sha1 and digest and digest != sha1:
        raise Damaged("payload digest differs", end + 4)
    found = {
        "record_type": kind, "page_id": _id(fields.get("warc-record-id")), "refers_to": _id(fields.get("warc-refers-to")),
        "payload_bytes": None if payload is None else len(payload), "payload_digest": digest or sha1, "payload_sha1": sha1,
        "target_uri": fields.get("warc-target-uri"), "payload": payload,
    }
    return found, end + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """What the gzip member at ``at`` holds, where it ends, and why it is broken, if it is."""
    member, parts, place = zlib.decompressobj(31), [], at
    try:
        while not member.eof and place < len(data):
            before = member.copy()
            parts.append(member.decompress(data[place : place + 65_536]))
            place += 65_536
    except zlib.error:
        with contextlib.suppress(zlib.error):  # byte by byte up to the damage
            for i in range(place, len(data)):
                parts.append(before.decompress(data[i : i + 1]))
        return b"".join(parts), at, "bad gzip member"
    if not member.eof:
        return b"".join(parts), at, "gzip member doesn't end"
    return b"".join(parts), min(place, len(data)) - len(member.unused_data), None


def _sound(data: bytes, at: int) -> bool:
    """Whether at ``at`` begins a record that passes its checks, or a member that is whole or holds such a record."""
    try:
        if data.startswith(MEMBER, at):
            inner, _, broken = _inflate(data, at)
            return not broken or any(gap is None for _, _, gap, _ in salvage(inner, True))
        parse_record(data, at)
        return True
    except ValueError:
        return False


def _next(data: bytes, at: int, start: re.Pattern = _START) -> int:
    """The next place after ``at`` where a sound record or member begins, or the end."""
    while m := start.search(data, at + 1):
        at = m.start()
        if _sound(data, at):
            return at
    return len(data)


def salvage(data: bytes, cut_off: bool = False) -> Iterator[tuple[int, int, str | None, dict]]:
    """(start, end, None, record) of every sound record and (start, end, reason, {}) of every gap, in order.

    What lies in a gzip member has the range of the member. ``cut_off`` says that the data are known to end early.
    """
    at = 0
    while at < len(data):
        if data.startswith(MEMBER, at):
            inner, end, broken = _inflate(data, at)
            end = _next(data, at, _MEMBER) if broken else end
            for start, stop, gap, record in salvage(inner, broken is not None):
                if gap is None or not broken or stop < len(inner):
                    yield at, end, gap, record
            if broken:
                yield at, end, broken, {}
            at = end
            continue
        try:
            record, end = parse_record(data, at)
            yield at, end, None, record
        except ValueError as error:
            end = getattr(error, "end", len(data) + 1)
            if end > len(data):
                end = len(data) if cut_off else _next(data, at)
            yield at, end, str(error), {}
        at = end


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record and gap of the archives at ``path``: file, byte range, ``gap`` (why, else null) and the record's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FOUND.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in FOUND.split(", ")])
        for batch in batches:
            for i in range(batch.num_rows):
                where, data, rows, size = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), [], 0
                for start, end, gap, record in salvage(data):
                    row = dict.fromkeys(names) | record | {"path": where, "start": start, "end": end, "gap": gap}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 5000 or size > 16_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, FOUND)


def quarantined(found: DataFrame) -> DataFrame:
    """The log of gaps: file, first and last byte, which check failed."""
    return found.filter("gap is not null").select("path", "start", "end", F.col("gap").alias("reason"))


def pages(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records that were read.

    A revisit has no payload of its own: its size is that of the response it refers to.
    """
    sound = found.filter("gap is null").select("page_id", "payload_bytes", F.coalesce("payload_sha1", "payload_digest").alias("payload_digest"), "record_type", "refers_to")
    sound = kept(sound, "records")  # archives are read once; sizes are written before they meet revisits, as one response may have very many
    own = sound.filter("record_type = 'response'")
    again = sound.filter("record_type = 'revisit'")
    asked = again.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    sizes = own.join(asked, ["page_id", "payload_digest"], "left_semi").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("size"))
    sizes = kept(sizes.select(F.col("page_id").alias("of"), F.col("payload_digest").alias("same"), "size"), "sizes")
    again = again.join(sizes, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("same")), "left")
    return own.unionByName(again.select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))


def round_trip(table: DataFrame) -> DataFrame:
    """Writes every page as a record, reads the archives back, and returns what they hold."""
    path = fresh_path(table.sparkSession, "warc")
    write(plan_records(table), path)
    return pages(read(table.sparkSession, path, payloads=False))
