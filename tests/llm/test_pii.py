import hashlib
import random
import re

from mobtrace.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for n, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15,
            }[kind]
            if ok():
                out.append((m.start(), n, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_base_forms():
    rng = random.Random(7)
    for alphabet in ("a1.@-+ ", "0123456789. -", "+1 ().-23456789", "aé@.b%_\n1"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert pii.base_spans(text) == brute(text), text
    assert [k for *_, k in pii.base_spans("4539578763621486 and 4539 5787 6362 1486")] == ["card", "card"]


def test_linear_time():
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "+1" * 500_000, "a@" * 500_000, "1 " * 500_000, "+1 (" * 250_000):
        base = pii.base_spans(text)
        list(pii.candidates(text, base))


def test_candidates():
    def found(text):
        return [(text[a:b], fits, pii.context(text, a)) for a, b, fits in pii.candidates(text, pii.base_spans(text))]

    long = '{"pad":"' + "x" * 1000 + '","phone":"(555) 010-9999","n":12}'
    assert found(long) == [("(555) 010-9999", ["phone"], 'phone":"'), ("12", [], 'n":')]
    assert found("a list: 0201234567 0301234567 0401234567")[0] == ("0201234567", ["phone"], "a list: ")
    assert [x[0] for x in found("a list: 0201234567 0301234567 0401234567")] == ["0201234567", "0301234567", "0401234567"]
    assert found("http://h.org/u/5550109999/x7")[0][:2] == ("5550109999", ["phone"])
    assert [x[2] for x in found("1 b")] == ["^"] and found("(1")[0][2] == "^("


def graph_brute(read, support, precision):
    """The rounds of scores over plain dictionaries."""
    edges = {}
    for r in read:
        for x in r.seen:
            e = edges.setdefault((x.context, x.value), [None, []])
            e[0] = max(filter(None, [e[0], x.seed]), default=None)
            e[1] = max(e[1], list(x.fits))
    size = {}
    for c, _ in edges:
        size[c] = size.get(c, 0) + 1
    edges = {k: v for k, v in edges.items() if size[k[0]] >= support}
    seeds = {(v, s): 1.0 for (_, v), (s, _) in edges.items() if s}
    seeded, scores, good = {v for v, _ in seeds}, seeds, {}
    while True:
        points, fit = {}, {}
        for (c, v), (_, fits) in edges.items():
            for k in pii.KINDS:
                points[c, k] = points.get((c, k), 0) + scores.get((v, k), 0)
                fit[c, k] = fit.get((c, k), 0) + (k in fits)
        worth = {x: p / (p + size[x[0]] - fit[x]) for x, p in points.items() if p >= support and fit[x]}
        more = {x: w for x, w in worth.items() if w >= precision and x not in good}
        if not more:
            return good
        good |= more
        left = {}
        for (c, v), (s, fits) in edges.items():
            for k in pii.KINDS:
                if not s and v not in seeded and (c, k) in good and k in fits:
                    left[v, k] = left.get((v, k), 1) * (1 - good[c, k])
        scores = seeds | {x: 1 - p for x, p in left.items()}


def test_graph(spark, medium):
    """Scores and accepted patterns are those of a plain computation; a chain of patterns is followed to its end."""
    value = lambda h, i: f"+1 555 0100 {i}" if h == 0 else str(5550100000 + h * 1000 + i)
    text = [(i, f"kind {c}{c} : {value(h + more, i)}") for h, c in enumerate("abcdefgh") for more in (0, 1) for i in range(100, 110)]
    docs = spark.createDataFrame(text, "doc_id long, text string").unionByName(spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text"))
    read = pii.kept(pii.read_texts(docs, "doc_id", "text"), "t")
    got = {(r.context, r.kind): r.worth for r in pii.patterns(read).collect()}
    want = graph_brute(read.collect(), pii.SUPPORT, pii.PRECISION)
    assert got.keys() == want.keys() and len(got) >= 8
    assert all(abs(got[x] - want[x]) < 1e-6 for x in got)


def test_whole_table(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    n = 0
    for r in pii.digests(docs).collect():
        base = brute(texts[r.doc_id] or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in base) for x in FORMS]
        assert not base or set(listed.split(",")) <= set(r.spans.split(","))
        n += len(base)
    assert n > 50


def rows(spark):
    seeds = [(i, f"Some words, please call: +1 (555) 555-01{i:02d} today") for i in range(8)]
    seeds += [(20 + i, f"the number x{i} +1 (555) 555-02{i:02d}") for i in range(8)]
    unseen = [(40, "é please call: (555) 010-9999, or please call: 12"), (41, "code: 555-010-8888"), (42, None), (43, ""), (44, "x" * 500_000 + " 1"), (44, "x" * 500_000 + " 1"), (None, "please call: 5550107777")]
    return spark.createDataFrame([(a, b, "en", 3, "y") for a, b in seeds + unseen], "doc_id long, text string, lang string, seen int, row string")


def test_bootstrapped(spark):
    got = {r.doc_id: r.spans for r in pii.digests(rows(spark)).collect()}
    assert len(got) == 22 and got[42] == got[43] == got[44] == got[41] == ""
    assert got[40] == "phone:15:29" and got[None] == "phone:13:23" and got[0].startswith("phone:25:")
    assert pii.digests(rows(spark).limit(0)).count() == 0


def test_redact(spark, monkeypatch):
    df = rows(spark)
    first = sorted(map(tuple, pii.redact(df).collect()), key=repr)
    texts = [r[1] for r in first]
    assert "é please call: [PHONE], or please call: 12" in texts and "please call: [PHONE]" in texts and "code: 555-010-8888" in texts
    monkeypatch.setattr(pii, "PATTERNS_SENT", 0)
    assert sorted(map(tuple, pii.redact(df).collect()), key=repr) == first
    assert pii.masked("ab12cd", [(0, 3, "ip"), (2, 4, "card")]) == "[IP]cd"[:4] + "cd"
