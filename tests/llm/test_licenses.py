from mobtrace.llm import licenses


def test_oracle(spark, medium, against_sql):
    rows = against_sql(spark, "op10_license_scan", medium)
    labels = {x for r in rows for x in r if x in ("mit", "gpl", "apache", "cc-by-nc")}
    assert labels == {"mit", "gpl", "apache", "cc-by-nc"}


def test_edge_cases(spark):
    given = [
        (1, None), (2, ""), (3, "--- !!"), (4, "MIT License mit license, The Apache-License\nGNU General\nPublic LICENSE"),
        (5, "licensed under cc by nc 4"), (6, "mit licenses"), (7, "x " * 200_000 + "mit license"), (None, "É MIT license"), (None, "É MIT license"),
        (8, "Permission is hereby granted to any person obtaining a copy of this software, free of charge, with associated files"),
    ]
    df = spark.createDataFrame([(a, b, "c", 2) for a, b in given], "doc_id long, text string, labels string, row int")
    got = sorted((tuple(r) for r in licenses.scan(df).collect()), key=str)
    want = [
        (1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0),
        (4, 11, 4, 0, 8, "apache,gpl,mit", "apache,gpl,mit", 1.0), (5, 6, 0, None, None, "", "cc-by-nc", 6 / 7), (6, 2, 0, None, None, "", "", 0.0),
        (7, 200_002, 1, 200_000, 200_000, "mit", "mit", 1.0), (None, 3, 1, 1, 1, "mit", "mit", 1.0), (None, 3, 1, 1, 1, "mit", "mit", 1.0),
        (8, 19, 0, None, None, "", "mit", 17 / 19),
    ]
    assert got == sorted(want, key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_wrapped_notices(spark):
    """Notices over several lines, within other text and with changes, and very many equal blocks."""
    notice = {label: text for label, text in licenses.TEMPLATES}  # the longest of each label comes last
    prose = "some words of prose that have no license at all and go on for quite a while " * 20
    wrap = lambda t: "\n# ".join(t[i : i + 60] for i in range(0, len(t), 60))
    lines = lambda t: " ".join("\n * " + w if i % 9 == 0 else w for i, w in enumerate(t.split()))
    changed = " ".join(w for i, w in enumerate(notice["bsd"].split()) if i % 12)
    given = [(1, prose + lines(notice["apache"]) + prose), (2, lines(changed)), (3, lines(notice["isc"]).upper()), (4, prose + wrap("x") + prose), (5, "Released under\nthe MIT\nLicense")]
    mit = notice["mit"].split()
    given += [(6, prose + lines(notice["zlib"])), (7, " ".join(mit[:40] + ["inserted words"] + mit[40:]) + prose)]
    given += [(10 + i, lines(notice["unlicense"])) for i in range(300)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 8)] == ["apache", "bsd", "isc", "", "mit", "zlib", "mit"]
    assert {got[10 + i].labels for i in range(300)} == {"unlicense"} and 0.8 <= got[2].score < 1
