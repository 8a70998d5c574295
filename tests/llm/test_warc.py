import base64
import glob
import gzip
import hashlib

from mobtrace.llm import warc


def test_oracle(spark, medium, against_sql):
    against_sql(spark, "op9_warc_salvage", medium)


def test_edge_cases(spark):
    given = [(1, ""), (2, None), (3, "é\r\n\r\nWARC/1.1\r\n"), (4, "x" * 300_000), (5, "x" * 300_000), (5, "x" * 300_000), (None, "alone"), (None, "y"), (6, "y")]
    df = spark.createDataFrame([(a, b, f"http://h/{a}\nX: y", "z") for a, b in given], "page_id long, html string, url string, digest string")
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    x, y, e = "x" * 300_000, "y", ""
    third = given[2][1]
    want = [(1, 0, sha(e), "revisit", 2), (2, 0, sha(e), "response", None), (3, len(third.encode()), sha(third), "response", None), (4, 300_000, sha(x), "revisit", 5)]
    want += [(5, 300_000, sha(x), "response", None)] * 2 + [(None, 5, sha("alone"), "response", None), (None, 1, sha(y), "revisit", 6), (6, 1, sha(y), "response", None)]
    got = [tuple(r) for r in warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert warc.round_trip(df.limit(0)).count() == 0


def records(spark, tmp_path, n=30):
    df = spark.createDataFrame([(i, f"<p>page {i} é " + "word " * i) for i in range(n)], "page_id long, html string").coalesce(1)
    warc.write(warc.plan_records(df).coalesce(1).sortWithinPartitions("page_id"), str(tmp_path / "w"))
    return gzip.open(glob.glob(str(tmp_path / "w" / "part-*"))[0]).read()


def test_salvage(spark, tmp_path):
    data = records(spark, tmp_path)
    sound = list(warc.salvage(data))
    assert [r[3]["page_id"] for r in sound] == list(range(30)) and all(r[2] is None for r in sound)
    assert sound[0][0] == 0 and sound[-1][1] == len(data)
    at = {r[3]["page_id"]: r[:2] for r in sound}
    broken = bytearray(data)
    broken[at[3][1] - 10] ^= 1  # in a payload
    broken[at[7][0]] = ord("X")  # a version line
    where = data.find(b"Content-Length: ", at[8][0])
    broken[where + 16 : where + 17] = b"9"
    broken = bytes(broken[: at[20][0] + 40]) + b"junk" * 100 + data[at[22][0] :]
    got = list(warc.salvage(broken))
    assert [r[3]["page_id"] for r in got if r[2] is None] == [i for i in range(30) if i not in (3, 7, 8, 20, 21)]
    gaps = [r[:3] for r in got if r[2]]
    assert gaps[0][:2] == at[3] and gaps[0][2] == "block digest differs"
    assert gaps[1][:2] == (at[7][0], at[8][1]) and len(gaps) == 3
    assert sum(b - a for a, b, *_ in got) == len(broken)


def test_salvage_gzip(spark, tmp_path):
    data = records(spark, tmp_path)
    members = [gzip.compress(data[a:b]) for a, b, *_ in warc.salvage(data)]
    members[4] = members[4][:20] + b"\0\0" + members[4][22:]
    members[9] = members[9][:-12]
    path = tmp_path / "z"
    path.mkdir()
    (path / "a.warc.gz").write_bytes(b"".join(members))
    whole = gzip.compress(data)
    for cut in (len(whole) // 2, len(whole) - 8):
        got = list(warc.salvage(whole[:cut] + members[0]))
        ids = [r[3]["page_id"] for r in got if r[2] is None]
        assert ids == [*range(len(ids) - 1), 0] and len(ids) > 5 and [r[2] for r in got if r[2]]
    (path / "empty.warc").write_bytes(b"")
    found = warc.read(spark, str(path)).collect()
    assert [r.page_id for r in found if r.gap is None] == [i for i in range(30) if i not in (4, 9)]
    gaps = warc.quarantined(warc.read(spark, str(path))).collect()
    assert [(r.start, r.end) for r in gaps] == [(sum(map(len, members[:i])), sum(map(len, members[: i + 1]))) for i in (4, 9)]


def test_salvage_own_archive(spark, tmp_path):
    """A flipped byte in the writer's own file costs one record."""
    records(spark, tmp_path)
    data = open(glob.glob(str(tmp_path / "w" / "part-*"))[0], "rb").read()
    sound = list(warc.salvage(data))
    assert [r[3]["page_id"] for r in sound] == list(range(30)) and all(r[2] is None for r in sound)
    start, end = sound[4][:2]
    for at in (*range(start, end, 7), end - 14):
        broken = bytearray(data)
        broken[at] ^= 0xFF
        got = list(warc.salvage(bytes(broken)))
        ids = [r[3]["page_id"] for r in got if r[2] is None]
        assert [i for i in ids if i != 4] == [i for i in range(30) if i != 4]
        if len(ids) == 29:
            assert [r[:2] for r in got if r[2]] == [(start, end)]
    assert len(ids) == 29


def test_salvage_after_broken_member(spark, tmp_path):
    """A whole member counts as a place to resume even if its first record fails its digest."""
    data = records(spark, tmp_path)
    spans = [r[:2] for r in warc.salvage(data)]
    first = bytearray(data[: spans[9][1]])
    first[spans[0][1] - 6] ^= 1
    broken = gzip.compress(data[slice(*spans[20])])[:-12]
    got = list(warc.salvage(broken + gzip.compress(bytes(first))))
    assert [r[3]["page_id"] for r in got if r[2] is None] == list(range(1, 10))
    assert [r[2] for r in got if r[2]] == ["bad gzip member", "block digest differs"]


def quoting(spark, tmp_path):
    """Three records, the second with a sound record of page 99 in its payload; their bytes and ranges."""
    other = spark.createDataFrame([(99, "<p>quoted")], "page_id long, html string")
    warc.write(warc.plan_records(other), str(tmp_path / "q"))
    quote = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "q" / "part-*"))).decode()
    df = spark.createDataFrame([(1, "one"), (2, f"before {quote} behind " + "x" * 50), (3, "three")], "page_id long, html string").coalesce(1)
    warc.write(warc.plan_records(df).coalesce(1).sortWithinPartitions("page_id"), str(tmp_path / "w"))
    data = b"".join(gzip.open(f).read() for f in sorted(glob.glob(str(tmp_path / "w" / "part-*"))))
    spans = [r[:2] for r in warc.salvage(data)]
    assert len(spans) == 3
    return data, spans


def test_quoted_records_stay_quotes(spark, tmp_path):
    """A flipped byte behind, before or in the quote: plain, in members of a record each, in one member."""
    data, spans = quoting(spark, tmp_path)
    lo, hi = spans[1]
    begin = data.index(b"before ", lo)
    for at in (begin + 2, data.index(b"quoted", lo), hi - 20):
        broken = bytearray(data)
        broken[at] ^= 1
        broken = bytes(broken)
        for made, gap in ((broken, (lo, hi)), (b"".join(gzip.compress(broken[a:b]) for a, b in spans), None), (gzip.compress(broken), None)):
            got = list(warc.salvage(made))
            assert [r[3]["page_id"] for r in got if r[2] is None] == [1, 3]
            assert [r[2] for r in got if r[2]] == ["block digest differs"] and (gap is None or [r[:2] for r in got if r[2]] == [gap])


def test_quoted_records_in_broken_members(spark, tmp_path):
    """A member that is cut behind the quote, alone and with others: neither its rest nor its quote comes out."""
    data, spans = quoting(spark, tmp_path)
    members = [gzip.compress(data[a:b], 0) for a, b in spans]
    cut = members[1][: members[1].index(b" behind ") + 4]
    assert [r[3]["page_id"] for r in warc.salvage(members[0] + cut + members[2]) if r[2] is None] == [1, 3]
    whole = gzip.compress(data, 0)
    cut = whole[: whole.index(b" behind ") + 4]
    got = list(warc.salvage(cut + members[2]))
    assert [r[3]["page_id"] for r in got if r[2] is None] == [1, 3] and [r[2] for r in got if r[2]] == ["gzip member doesn't end"]


def test_a_damaged_length_still_lets_later_records_come(spark, tmp_path):
    """Where the end isn't known the search goes into the record, as the docstring says: the quote comes out behind the gap, and so does the next record."""
    data, spans = quoting(spark, tmp_path)
    where = data.index(b"Content-Length: ", spans[1][0]) + 16
    broken = data[:where] + b"9" + data[where + 1 :]
    assert [r[3]["page_id"] for r in warc.salvage(broken) if r[2] is None] == [1, 99, 3]


def test_large_member():
    record = b"x" * (1 << 24)
    data = warc.joined([gzip.compress(b"a"), gzip.compress(record)]) + b"\0"
    assert gzip.decompress(data) == b"a" + record and gzip.decompress(warc.joined([gzip.compress(b"y")]) + b"\0") == b"y"


def test_files_by_bytes(spark, tmp_path):
    """Files are cut by bytes, and each is a whole archive."""
    df = spark.range(400).selectExpr("id page_id", "repeat(sha2(string(id), 512), 40) html").coalesce(1)
    warc.write(warc.plan_records(df).coalesce(1), str(tmp_path / "w"), piece=20_000, pieces_per_file=2)
    files = glob.glob(str(tmp_path / "w" / "part-*"))
    sizes = [len(open(f, "rb").read()) for f in files]
    assert len(files) > 3 and max(sizes) < 60_000
    assert sorted(r.page_id for r in warc.read(spark, str(tmp_path / "w")).filter("gap is null").collect()) == list(range(400))
