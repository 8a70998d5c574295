"""Interleaved documents: HTML to an ordered sequence of text and media, payloads by digest.

``sequences`` parses HTML into one array per document of structs in reading order: text
parts, and media references with their caption and the digest they name. ``resolved``
joins the references to a table of stored media by digest; what is joined is small (a
description of the medium, or where it lies), so equal media shared by very many
documents are read once and never copied. Positions and captions stay with their part.

``text_media`` stores texts as media: bytes, padded with 255 to rows of 576 samples, as
the pixels of a binary PGM image whose file begins with a fixed-form header. Each has a
preview, an image of one row with the means of its columns, and a page that refers to both.
What the references resolve to is worked out once for each digest and written before it
meets them, so that the join on a digest that very many pages share can be split.

Edge cases: null or empty HTML has an empty sequence; null text is empty and stores one
row of padding; a reference without a digest or with an unknown one stays in its place
with null media; equal media are stored once in a batch of rows and count as one;
repeated rows and rows without an id are documents of their own; other columns are
ignored; an empty table gives no rows.

Of HTML: a figure's captions, before or behind its media, are put to all its media when the
figure ends; a figure without media keeps their text as text; figures and captions that
aren't closed end with what holds them or the page. A picture, video, audio or object is one
medium: its own reference, else the first that is offered within (a picture's image before
its sources). References are ``src``, ``data``, ``data-src`` or the first of ``srcset``;
posters aren't read. What stands in script, style, template or noscript is neither text nor
media: the last repeats for plain readers what others load. Text is never dropped elsewhere.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobtrace.llm.storage import kept

ROW = 576
PART = "struct<position:int,kind:string,text:string,digest:binary,caption:string>"
_DIGEST = re.compile(r"sha256:([0-9a-f]{64})")
_MEDIA = {"img", "embed"}
_HOLDERS = {"picture", "video", "audio", "object"}
_HIDDEN = {"script", "style", "template", "noscript"}
_BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "figcaption", "table", "blockquote", "header", "footer", "nav", "body", "title"}


def reference(given: dict[str, str | None]) -> str | None:
    """Where a medium lies by its attributes: its source, what a page loads later, or the first of several sizes."""
    for name in ("src", "data", "data-src"):
        if given.get(name):
            return given[name]
    for name in ("srcset", "data-srcset"):
        if (given.get(name) or "").strip(" ,"):
            return given[name].strip(" ,").split()[0].rstrip(",")
    return None


class _Figure:
    """What is open in a figure: places of its media, its captions with the place where each began."""

    def __init__(self) -> None:
        self.media: list[int] = []
        self.captions: list[tuple[int, list[str]]] = []
        self.in_caption = False


class _Holder:
    """An element that offers one medium in several ways: whether one was taken, else the first that was offered."""

    def __init__(self, tag: str) -> None:
        self.tag, self.taken, self.offered = tag, False, None


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figures: list[_Figure] = []
        self.holders: list[_Holder] = []

    def text_ends(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.parts.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def medium(self, where: str, given: dict[str, str | None]) -> None:
        self.text_ends()
        m = _DIGEST.search(where)
        self.parts.append({"kind": "media", "text": where, "digest": m and bytes.fromhex(m[1]), "caption": given.get("alt") or given.get("title")})
        if self.figures:
            self.figures[-1].media.append(len(self.parts) - 1)

    def offered(self, tag: str, given: dict[str, str | None], opens: bool = False) -> None:
        """A medium, or one way of several in which a holder offers one: what it names as it ``opens``, a picture's image, else the first."""
        where, holder = reference(given), self.holders[-1] if self.holders else None
        if holder is None or opens:
            if where:
                self.medium(where, given)
                if holder:
                    holder.taken = True
        elif holder.tag == "picture" and tag == "source":
            holder.offered = holder.offered or where
        elif not holder.taken and (where or holder.offered):
            self.medium(where or holder.offered, given)
            holder.taken = True

    def holder_ends(self) -> None:
        holder = self.holders.pop()
        if holder.offered and not holder.taken:
            self.medium(holder.offered, {})

    def figure_ends(self) -> None:
        self.text_ends()
        figure = self.figures.pop()
        texts = [(at, text) for at, said in figure.captions if (text := " ".join("".join(said).split()))]
        if figure.media:
            for i in figure.media:
                self.parts[i]["caption"] = " ".join(t for _, t in texts) or self.parts[i]["caption"]
        else:  # text without a medium stays text, where it stood
            for at, text in reversed(texts):
                self.parts.insert(at, {"kind": "text", "text": text, "digest": None, "caption": None})
        if self.figures and figure.media:
            self.figures[-1].media += figure.media

    def caption(self) -> list[str] | None:
        return self.figures[-1].captions[-1][1] if self.figures and self.figures[-1].in_caption else None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        elif self.hidden:
            return
        elif tag in _HOLDERS:
            within = bool(self.holders)
            if not within:
                self.holders.append(_Holder(tag))
                if tag != "picture":
                    self.offered(tag, dict(attrs), True)
            else:  # a holder within another is one more way to offer its medium
                self.offered(tag, dict(attrs))
                self.holders.append(self.holders[-1])
        elif tag in _MEDIA or tag == "source":
            self.offered(tag, dict(attrs))
        elif tag == "figure":
            self.text_ends()
            self.figures.append(_Figure())
        elif tag == "figcaption" and self.figures:
            self.text_ends()
            self.figures[-1].captions.append((len(self.parts), []))
            self.figures[-1].in_caption = True
        elif tag in _BLOCKS:
            self.break_words()

    def break_words(self) -> None:
        said = self.caption()
        if said is None:
            self.text_ends()
        else:
            said.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag in _HOLDERS:
            if any(h.tag == tag for h in self.holders):
                self.holder_ends()
        elif tag == "figcaption" and self.figures:
            self.figures[-1].in_caption = False
        elif tag == "figure":
            if self.figures:
                self.figure_ends()
        elif tag in _BLOCKS:
            self.break_words()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            said = self.caption()
            (self.words if said is None else said).append(data)

    def all_ends(self) -> None:
        while self.holders:
            self.holder_ends()
        while self.figures:
            self.figure_ends()
        self.text_ends()


def parse(page: str | None) -> list[dict]:
    """Parts of a page in reading order: position, kind, text (the reference, for media), digest, caption."""
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader.all_ends()
    return [{"position": i} | part for i, part in enumerate(reader.parts)]


def sequences(pages: DataFrame, key: str, page: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The key, the columns to carry and ``parts``, the ordered sequence of each row."""
    part = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.binary()), ("caption", pa.string())]))
    names = [key, *carry, "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [parse(batch.column(0)[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(parts, part)], names=names)

    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (key, *carry)), f"parts array<{PART}>"])
    return pages.select(page, key, *carry).mapInArrow(run, schema)


def resolved(rows: DataFrame, media: DataFrame) -> DataFrame:
    """``rows`` (with ``row``, a number that no two share, and ``parts``) with ``media`` in every part, in the same order.

    ``media`` has ``digest``, each once, and any columns that describe the medium.
    """
    described = media.select("digest", F.struct(*[c for c in media.columns if c != "digest"]).alias("media"))
    refs = rows.select("row", F.explode("parts").alias("part")).filter("part.digest is not null")
    refs = refs.select("row", "part.position", "part.digest").join(described, "digest")
    got = refs.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("position", "media"))).alias("got"))
    fill = F.transform("parts", lambda p: p.withField("media", F.element_at("got", p["position"])))
    return rows.join(got, "row", "left").withColumn("parts", fill).drop("got")


def pgm(payload: bytes) -> bytes:
    """A binary PGM image of 8-bit samples, ROW to a line."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def samples(image: bytes) -> bytes:
    """The samples of an image that ``pgm`` made."""
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", image)
    if not m or len(image) - m.end() != int(m[1]) * int(m[2]):
        raise ValueError("not a whole PGM image of 8-bit samples")
    return image[m.end() :]


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    size = max(ROW, -(-len(data) // ROW) * ROW)
    return data.ljust(size, b"\xff"), len(data)


def preview(payload: bytes) -> bytes:
    """An image of one row: the mean of each column of samples, rounded down."""
    return pgm(np.frombuffer(payload, np.uint8).reshape(-1, ROW).mean(axis=0).astype(np.uint8).tobytes())


def feature(payload: bytes) -> str:
    """Lines, then counts of samples by their upper three bits, then the sum of steps between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x >> 5, minlength=8)
    steps = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    return f"{len(x) // ROW}:{'.'.join(map(str, counts))}:{steps}"


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pages, media): a page for each text that refers to its medium and preview by digest, and the stored media.

    The media table is written to the shared folder: digest and content of each image.
    """
    schema = pa.schema([("digest", pa.binary()), ("content", pa.binary())])

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, None] = {}
            digests, contents, size = [], [], 0
            for t in batch.column(0):
                payload = padded(t.as_py())[0]
                for image in (pgm(payload), preview(payload)):
                    digest = hashlib.sha256(image).digest()
                    if digest in seen:
                        continue
                    seen[digest] = None
                    digests.append(digest)
                    contents.append(image)
                    size += len(image)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(contents, pa.binary())], schema=schema)
                    digests, contents, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(contents, pa.binary())], schema=schema)

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, pages = [], []
            for t in batch.column(1):
                payload, n = padded(t.as_py())
                whole, small = (hashlib.sha256(x).hexdigest() for x in (pgm(payload), preview(payload)))
                sizes.append(n)
                pages.append(
                    f"<h1>Text of {n} bytes</h1><figure><img src='sha256:{whole}'><figcaption>{len(payload) // ROW} rows of <i>{ROW}</i> samples</figcaption></figure>"
                    f"<p>Preview:<img src='sha256:{small}' alt='mean of {len(payload) // ROW} rows'></p>"
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(pages, pa.string())], names=["doc_id", "n_bytes", "page"])

    media = kept(docs.select(text).mapInArrow(images, "digest binary, content binary"), "media")
    pages = docs.select(key, text).mapInArrow(refer, f"doc_id {dict(docs.dtypes)[key]}, n_bytes long, page string")
    return pages, media


def described(media: DataFrame) -> DataFrame:
    """Reads every stored image back: its digest, size and features. A row for each digest."""
    fields = [("digest", pa.binary()), ("media_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.binary()), ("tail_crc32", pa.int64()), ("feature", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                image = x.as_py()
                payload = samples(image)
                rows.append((hashlib.sha256(image).digest(), len(image), len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-32:]), feature(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], schema=pa.schema(fields))

    found = media.select("digest", "content").mapInArrow(run, "digest binary, media_bytes long, payload_bytes long, payload_sha256 binary, tail_crc32 long, feature string")
    return found.groupBy("digest").agg(*[F.max(c).alias(c) for c, _ in fields[1:]])


def digests(docs: DataFrame) -> DataFrame:
    """Stores every text as a medium, reads a page that refers to it, and describes what the references resolve to.

    The first medium of the resolved sequence is the text's, the second its preview.
    """
    pages, media = text_media(docs)
    rows = kept(pages.withColumn("row", F.monotonically_increasing_id()), "pages")
    parts = sequences(rows, "row", "page", ("doc_id", "n_bytes"))
    # a reference's text is its digest again, and needn't move
    parts = parts.withColumn("parts", F.transform("parts", lambda p: p.withField("text", F.when(p["kind"] == "text", p["text"]))))
    own = F.filter("parts", lambda p: p["kind"] == "media")
    found = resolved(parts, kept(described(media), "described")).select("doc_id", "n_bytes", F.size("parts").alias("n_parts"), own[0].alias("part"), own[1].alias("small"))
    text = lambda digest: F.lower(F.hex(digest))
    return found.select(
        "doc_id", "n_bytes", "part.media.payload_bytes", text("part.media.payload_sha256").alias("payload_sha256"), "part.media.tail_crc32", "part.media.media_bytes", text("part.digest").alias("media_sha256"), "part.media.feature",
        "n_parts", "part.position", "part.caption", text("small.digest").alias("preview_sha256"), F.col("small.caption").alias("preview_caption"), F.col("small.media.feature").alias("preview_feature"),
    )
