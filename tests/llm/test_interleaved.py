import hashlib
import zlib

from pyspark.sql import functions as F

from mobtrace.llm import interleaved


def want(text):
    data = (text or "").encode()
    size = max(576, -(-len(data) // 576) * 576)
    payload = data + b"\xff" * (size - len(data))
    image = b"P5\n576 %d\n255\n" % (size // 576) + payload
    return len(data), size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest()


def check(df):
    given = sorted(((r.doc_id, *want(r.text)) for r in df.select("doc_id", "text").collect()), key=str)
    out = interleaved.digests(df).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in out), key=str)
    assert got == given
    for r in out:
        n = r.payload_bytes // 576
        assert (r.n_parts, r.position, r.caption, r.preview_caption) == (4, 1, f"{n} rows of 576 samples", f"mean of {n} rows")
        assert len(r.preview_sha256) == 64 and r.preview_feature.startswith("1:")
    assert all(r.feature for r in out) and len({(r.media_sha256, r.feature) for r in out}) == len({r.media_sha256 for r in out})


def test_whole_table(spark, medium):
    check(spark.read.parquet(f"{medium}/documents.parquet"))


def test_edge_cases(spark):
    given = [(1, None), (2, ""), (3, "x" * 576), (4, "é" * 288), (5, "x" * 577), (5, "x" * 577), (None, "<b>&'\"</b>"), (6, "y" * 3_000_000), (7, "<figcaption>")]
    df = spark.createDataFrame([(a, b, "q", 5) for a, b in given], "doc_id long, text string, media string, row int")
    check(df)
    assert interleaved.digests(df.limit(0)).count() == 0


PAGE = """<title>T</title><script>var x = "<p>no</p>";</script><p>One &amp; two<br>three</p>
<figure><img src="sha256:{a}" alt="old"><img src='http://h/sha256:{b}.png'><figcaption>Both <i>of</i> them</figcaption></figure>
<p>mid <img src="http://h/plain.jpg" alt="alone"> end</p><img><video src="sha256:{a}"></video>"""


def short(page):
    return [(p["kind"][0], p["text"], p["caption"]) for p in interleaved.parse(page)]


def test_captions_before_behind_and_open():
    assert short("<figure><figcaption>First <b>said</b></figcaption><img src=a alt=x></figure>z") == [("m", "a", "First said"), ("t", "z", None)]
    assert short("<figure><img src=a><figcaption>one<br>two</figcaption><img src=b><figcaption>three</figcaption></figure>") == [("m", "a", "one two three"), ("m", "b", "one two three")]
    assert short("p<figure><img src=a><figcaption>never closed</figure>q") == [("t", "p", None), ("m", "a", "never closed"), ("t", "q", None)]
    assert short("<figure><figcaption>open to the end <img src=a>") == [("m", "a", "open to the end")]
    assert short("p<figure><figcaption>no medium</figcaption>text</figure>q") == [("t", "p", None), ("t", "no medium", None), ("t", "text", None), ("t", "q", None)]
    assert short("<figure><img src=a alt=own><figcaption> </figcaption></figure>") == [("m", "a", "own")]
    assert short("<figcaption>outside</figcaption></figure><p>q") == [("t", "outside", None), ("t", "q", None)]
    assert short("<figure><figure><img src=a><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure>") == [("m", "a", "outer")]


def test_references_of_all_kinds():
    assert short("<img data-src=a><img srcset='b 1x, c 2x'><img src='' data-srcset='d.jpg, e 2x'><img alt=none>") == [("m", "a", None), ("m", "b", None), ("m", "d.jpg", None)]
    assert short("<picture><source srcset='a 1x'><source srcset=b><img src=c alt=x></picture>") == [("m", "c", "x")]
    assert short("<picture><source srcset='a 1x'><source srcset=b><img alt=x></picture>y") == [("m", "a", "x"), ("t", "y", None)]
    assert short("<picture><source srcset=a></picture>y<picture><source srcset=b>") == [("m", "a", None), ("t", "y", None), ("m", "b", None)]
    assert short("<video><source src=a><source src=b>old browsers</video><audio src=c><source src=d></audio>") == [("m", "a", None), ("t", "old browsers", None), ("m", "c", None)]
    assert short("<object data=a><object data=b><img src=c></object></object><embed src=d></object>e") == [("m", "a", None), ("m", "d", None), ("t", "e", None)]
    assert short("<object><img src=c></object><img src=d>") == [("m", "c", None), ("m", "d", None)]
    assert short("<img data-src=a><noscript><img src=a>no</noscript>b<noscript><figure></noscript>c") == [("m", "a", None), ("t", "bc", None)]


def test_sequences_and_resolution(spark):
    a, b = "a" * 64, "b" * 64
    pages = spark.createDataFrame([(0, 7, PAGE.format(a=a, b=b)), (1, 7, None), (2, None, "<p>open <b>only"), (3, 8, PAGE.format(a=b, b=a))], "row long, page_id long, html string")
    media = spark.createDataFrame([(bytes.fromhex(a), 11, "x")], "digest binary, size int, place string")
    parts = interleaved.sequences(pages, "row", "html")
    got = {r.row: r.parts for r in interleaved.resolved(parts, media).collect()}
    first = [(p.position, p.kind, p.text if p.kind == "text" else None, p.digest and p.digest.hex(), p.caption, p.media and p.media.size) for p in got[0]]
    assert first == [
        (0, "text", "T", None, None, None), (1, "text", "One & two", None, None, None), (2, "text", "three", None, None, None),
        (3, "media", None, a, "Both of them", 11), (4, "media", None, b, "Both of them", None), (5, "text", "mid", None, None, None),
        (6, "media", None, None, "alone", None), (7, "text", "end", None, None, None), (8, "media", None, a, None, 11),
    ]
    assert got[1] == [] and [p.text for p in got[2]] == ["open only"]
    assert [p.media and p.media.size for p in got[3]] == [None] * 4 + [11] + [None] * 4
    assert pages.filter(F.lit(False)).count() == 0


def test_pages_of_the_table(spark, small):
    """Every page's html gives its text in order; what it refers to keeps its place."""
    pages = spark.read.parquet(f"{small}/pages.parquet")
    parts = {r.page_id: r.parts for r in interleaved.sequences(pages, "page_id", "html").collect()}
    assert len(parts) == pages.count() and all([p.position for p in x] == list(range(len(x))) for x in parts.values())
    assert sum(p.kind == "text" for x in parts.values() for p in x) > len(parts)


def test_hot_digest(spark):
    """One digest that most references name: the join is split, and every reference is resolved."""
    rows = spark.range(40_000).selectExpr("id row", "array(struct(0 position, 'media' kind, 's' text, unhex(if(id % 4 > 0, repeat('a', 64), sha2(string(id), 256))) digest, string(id) caption)) parts")
    media = interleaved.kept(rows.selectExpr("parts[0].digest digest").distinct().selectExpr("digest", "length(digest) size"), "t")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = interleaved.resolved(interleaved.kept(rows.repartition(8), "t"), media)
        assert out.filter("parts[0].media.size = 32 and parts[0].caption = string(row)").count() == 40_000
        out = interleaved.resolved(interleaved.kept(rows.repartition(8), "t"), media)
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
