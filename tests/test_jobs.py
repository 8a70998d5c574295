"""Jobs that SQL can't check, against plain versions and properties."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mobtrace.fixtures import view
from mobtrace.functions import geo
from mobtrace.operators import changes, interests, models, spatial, stays, trees
from mobtrace.plans import registry, sequences, streams
from mobtrace.sources import files


def plain_stays(points):
    """The rules of stay extraction, with whole distance matrices."""
    t, la, lo, st = (np.array(c) for c in zip(*points, strict=True))
    far = lambda i, j: float(stays.distances(la[i], lo[i], la[j], lo[j]))
    wide = lambda a, b: max((far(i, j) for i in range(a, b) for j in range(a, b)), default=0.0)
    out, i, n = [], 0, len(t)
    while n > 1 and i < n:
        j = next((k for k in range(i, n) if t[k] > t[i] + 180), n - 1)
        if i == j:
            break
        steps = [far(k, k + 1) for k in range(i, j - 1)]
        speeds = [far(k, k + 1) / (t[k + 1] - t[k]) for k in range(i, j) if t[k + 1] > t[k]]
        if wide(i, j) > 150 or (steps and np.mean(steps) > 112.5) or (speeds and np.mean(speeds) > 1.1):
            i += 1
            continue
        end = j
        while end < n - 1 and wide(i, end + 1) < 150:
            end += 1
        middle = min(range(i, end), key=lambda k: (sum(far(k, x) for x in range(i, end)), k))
        out.append((int(t[i]), int(t[end]), la[middle], lo[middle], int(st[i : end + 1].sum())))
        i = end + 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_stays_of_dense_traces(seed):
    rng = random.Random(seed)
    la, lo, points = 51.5, -0.1, []
    for k in range(250):
        pace = 0.00001 if (k // 40) % 2 else 0.0008
        la, lo = la + rng.uniform(-pace, pace * 1.5), lo + rng.uniform(-pace, pace)
        points.append((1_704_067_200 + 60 * k, la, lo, rng.randint(0, 9)))
    got = [s[:5] for s in stays.stays_of_day(*(np.array(c) for c in zip(*points, strict=True)))]
    assert got == plain_stays(points) and got
    for a, b in zip(got, got[1:]):
        assert a[1] < b[0]


def test_stays_of_short_days():
    assert stays.stays_of_day(*(np.array([x]) for x in (0, 1.0, 1.0, 1))) == []
    alone = stays.stays_of_day(np.array([0, 4000, 4060]), np.array([1.0, 1.01, 1.01]), np.array([1.0, 1.01, 1.01]), np.array([1, 2, 3]))
    assert alone[0][0] == 0 and alone[0][1] == 4000


def test_stream_equals_batch(spark, small):
    batch = sorted(map(str, sequences.stays(spark, small).select("user_id", "arrival", "departure", "lat", "lon", "nb_steps").collect()))
    for q in (streams.stays_of_stream, streams.reprocessed_days):
        assert sorted(map(str, q(spark, small).select("user_id", "arrival", "departure", "lat", "lon", "nb_steps").collect())) == batch


def test_assigned_places(spark, small):
    rows = sequences.assigned_places(spark, small).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.user_id, r.arrival)):
        by.setdefault(r.user_id, []).append(r)
    assert all(r.place_id for r in rows)
    again = 0
    for own in by.values():
        seen = {}
        for r in own:
            if r.place_id in seen:
                again += 1
                assert stays.distances(np.array(seen[r.place_id][0]), np.array(seen[r.place_id][1]), r.lat, r.lon) <= 300
            seen.setdefault(r.place_id, (r.lat, r.lon))
    assert again


def test_grid_join_equals_all_pairs(spark, small):
    v = spatial.projected(view(spark, small, "fx_venue")).select("venue_id", "mx", "my")
    p = v.filter("venue_id < 60").select(F.col("venue_id").alias("probe"), (F.col("mx") + 90).alias("px"), (F.col("my") - 40).alias("py"))
    joined = spatial.within(p, v, 1500.0)
    plan = joined._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    every = p.crossJoin(v).filter(geo.planar_distance(F.col("px"), F.col("py"), F.col("mx"), F.col("my")) <= 1500)
    assert sorted(map(tuple, joined.select("probe", "venue_id").collect())) == sorted(map(tuple, every.select("probe", "venue_id").collect()))


def test_polygons(spark):
    ell = "MULTIPOLYGON(((0 0,4 0,4 1,1 1,1 4,0 4,0 0)),((10 10,12 10,12 12,10 12,10 10)))"
    p = spark.createDataFrame([(ell,)], "wkt string").select(F.explode(files.polygons(F.col("wkt"))).alias("ring")).withColumn("id", F.monotonically_increasing_id())
    points = spark.createDataFrame([(0.5, 3.5), (3.5, 0.5), (2.0, 2.0), (11.0, 11.0), (5.0, 5.0)], "x double, y double")
    hits = spatial.containing(points, p, 1.5).select("x", "y").collect()
    assert sorted(map(tuple, hits)) == [(0.5, 3.5), (3.5, 0.5), (11.0, 11.0)]
    square = [{"x": x, "y": y} for x, y in ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))]
    ring = [{"x": x, "y": y} for x, y in ((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0))]
    assert spatial.clipped_area(ring, square) == pytest.approx(3.0)
    assert spatial.clipped_area([{"x": p["x"] + 9, "y": p["y"]} for p in ring], square) == 0


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", 5, ["x"]), (2, None, 7, []), (None, "n", 1, [])], "id long, name string, n long, tags array<string>")
    new = spark.createDataFrame([(1, None, 4, ["y"]), (3, "c", 1, ["z"]), (None, "m", 2, [])], "id long, name string, n long, tags array<string>")
    rules = {"name": "filled", "n": "greatest", "tags": "united"}
    once = changes.upsert(old, new, ["id"], rules)
    rows = sorted(map(tuple, once.collect()), key=str)
    assert rows == sorted([(1, "a", 5, ["x", "y"]), (2, None, 7, []), (3, "c", 1, ["z"]), (None, "m", 2, [])], key=str)
    assert sorted(map(tuple, changes.upsert(once, new, ["id"], rules).collect()), key=str) == rows


def test_erasure_leaves_no_row(spark):
    users = spark.createDataFrame([(1,), (1,), (9,)], "user_id long")
    t = spark.createDataFrame([(1, 1), (2, 1), (None, 2)], "owner long, x long")
    assert sorted(map(tuple, changes.erase({"t": t}, users, {"t": "owner"})["t"].collect()), key=str) == [(2, 1), (None, 2)]
    visits = spark.createDataFrame([(1, 10), (2, 11), (3, 11)], "visit_id long, place_id long")
    places = spark.createDataFrame([(10,), (11,), (12,)], "place_id long")
    gone = visits.filter("visit_id <= 2")
    assert sorted(r.place_id for r in changes.without_orphans(places, visits, gone).collect()) == [11, 12]


def alike(a, b, roots):
    """The rule of similar names over plain sets."""
    if interests.ratio(a, b) >= 0.75:
        return True
    x, y = ({w.strip("!.,") for w in n.lower().split()} for n in (a, b))
    left, right = x - y - set(interests.PREPOSITIONS), y - x - set(interests.PREPOSITIONS)
    return len(left) == len(right) == 1 and left | right <= set(roots)


NAMES = ["coffee house", "coffee houses", "tea", "teas", "opera", "operas", "school of music", "music school", "art museum", "art gallery", "museum", "gallery", "abc", "abd", "ab", "b", "Blue plate", "large plate", "old anvil", "cold anvil", "tin ring", "steel ring", "ring of tin", "steel", "tin", "zoo 3", "zoo", "xabcdefgh", "abcdefghx"]


def test_similar_pairs(spark):
    """Proposals lose no similar pair."""
    rng = random.Random(3)
    names = NAMES + ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 12))).strip() or "q" for _ in range(80)]
    roots = ["museum", "gallery", "tin", "steel"]
    df = spark.createDataFrame([(g, n) for g in (1, 2) for n in names[g - 1 :]], "g int, name string")
    for own in ([], roots):
        got = sorted((r.g, r.a, r.b) for r in interests.similar_pairs(df, ["g"], "name", own).collect())
        want = sorted({(g, a, b) for g in (1, 2) for a in names[g - 1 :] for b in names[g - 1 :] if a < b and alike(a, b, own)})
        assert got == want


def test_without_similar_and_merged(spark):
    roots = ["museum", "gallery", "tin", "steel", "ring", "anvil", "zoo", "plate"]
    df = spark.createDataFrame([("k", n, i % 4) for i, n in enumerate(NAMES)], "k string, name string, n long")
    got = {r.name for r in interests.without_similar(df, ["k"], "name", "n", roots).collect()}
    rooted = sorted(((-i % 4, n) for i, n in enumerate(NAMES) if set(n.lower().split()) & set(roots) and not any(c.isdigit() for c in n)), key=lambda x: x[1])
    order = sorted((n for n in NAMES if set(n.lower().split()) & set(roots) and not any(c.isdigit() for c in n)), key=lambda n: (-(NAMES.index(n) % 4), n))
    assert got == {n for i, n in enumerate(order) if not any(alike(*sorted((n, m)), roots) for m in order[:i])} and rooted
    assert interests.first_of_similar(["coffee house", "coffee houses", "tea", "teas", "opera"]) == [0, 0, 2, 2, 4]
    df = spark.createDataFrame([("k", "opera", ["a"]), ("k", "operas", ["b"]), ("k", "park", ["c"])], "k string, name string, sources array<string>")
    # the name of the source that comes first stays, whatever the alphabet says
    for first, kept in (("a", "opera"), ("b", "operas")):
        got = sorted(map(tuple, interests.merged_sources(df, ["k"], "name", "sources", ~F.array_contains("sources", first)).collect()))
        assert got == [("k", kept, ["a", "b"]), ("k", "park", ["c"])]


def test_interest_queries(spark, small):
    """C2 to C4, X7, X8 and J25 against plain versions over the whole small tables."""
    import difflib

    from mobtrace.plans import documents, joins
    from mobtrace.plans import interests as jobs

    part = spark.read.parquet(f"{small}/part.parquet").collect()
    kept = {}
    for r in part:
        name = f"{r.p_name} {r.p_partkey % 3}" if r.p_partkey % 9 == 0 else r.p_name
        kept.setdefault(r.p_brand, {}).setdefault(name, 0)
        kept[r.p_brand][name] += 1
    want = set()
    for brand, names in kept.items():
        order = sorted((n for n in names if set(n.split()) & set(jobs.ROOTS) and not any(c.isdigit() for c in n)), key=lambda n: (-names[n], n))
        want |= {(brand, n) for i, n in enumerate(order) if not any(alike(*sorted((n, m)), jobs.ROOTS) for m in order[:i])}
    assert {(r.p_brand, r.p_name) for r in jobs.without_similar_names(spark, small).collect()} == want
    merged = {}
    for r in sorted(part, key=lambda r: r.p_partkey):
        own = merged.setdefault((r.p_brand, r.p_size), {})
        first = next((n for n in own if n == r.p_name), None) or next((n for n in own if interests.ratio(r.p_name, n) >= 0.75), r.p_name)
        own.setdefault(first, set()).add(r.p_type)
    got = {(r.p_brand, r.p_size, r.p_name): set(r.sources) for r in jobs.merged_sources(spark, small).collect()}
    assert got == {(*k, n): s for k, own in merged.items() for n, s in own.items()}
    types = jobs.interests_of_types(spark, small).collect()
    assert types and not any(r.pi == "YES" for r in types) and {r.kind for r in types} == {"ACT", "SOC", "INT"}
    lead = {}
    for r in part:
        lead[r.p_brand] = min(lead.get(r.p_brand, r.p_name), r.p_name)
    ratios = {r.p_partkey: r.ratio for r in jobs.name_ratios(spark, small).collect()}
    assert all(ratios[r.p_partkey] == pytest.approx(difflib.SequenceMatcher(None, r.p_name, lead[r.p_brand]).ratio(), abs=1e-6) for r in part)
    sizes = {}
    for r in part:
        sizes.setdefault(r.p_size, set()).add(f"{r.p_name} of {r.p_type.lower()}")
    pairs = {(r.p_size, r.a, r.b) for r in documents.similar_names(spark, small).collect()}
    assert pairs == {(z, a, b) for z, names in sizes.items() for a in names for b in names if a < b and alike(a, b, ["ring", "bolt", "gear"])}
    linked = joins.linked_entities(spark, small).collect()
    assert any({"own category", "own kb"} & set(r.sources) == {"own kb"} for r in linked)
    venues = {r.venue_id: r for r in view(spark, small, "fx_venue").collect()}
    categories = {r.category_id: r.name.lower() for r in view(spark, small, "fx_category").collect()}
    by = {}
    for r in linked:
        by.setdefault(r.venue_id, []).append(r)
    for i, v in venues.items():
        near = {s for r in by[i] for s in r.sources}
        assert "own category" in near and ("parent category" in near) == (i // 2 in venues)
        assert any("own category" in r.sources and interests.ratio(r.name, categories[v.leaf_category]) >= 0.75 for r in by[i])
        if i % 2 == 0:
            assert "own kb" in near


def plain_places(rows):
    """Places of a user's stays (day, arrival, departure, lat, lon, venue) with lists of visits and plain loops."""
    places, visits, out, pending = {}, [], [], None
    for day, a, b, lat, lon, venue in rows:
        if pending and pending["day"] != day:
            visits.append(pending)
            pending = None
        start, end = a % 86400, min(a % 86400 + b - a, 86399)
        near = sorted((float(stays.distances(np.array(p[0]), np.array(p[1]), lat, lon)), n) for n, p in places.items() if any(v["place"] == n for v in visits))
        chosen, most = None, 0
        for _, n in [x for x in near if x[0] <= 250][:5]:
            total = 0
            for v in visits:
                if v["place"] == n:
                    begin, stop = v["a"] % 86400, min(v["a"] % 86400 + v["d"] - v["a"], 86399)
                    if stop + 3600 >= start and begin - 3600 <= end:
                        total += min(end, stop + 3600) - max(start, begin - 3600)
            if total > most:
                chosen, most = n, total
        if chosen is None:
            chosen = f"v{venue[0]}" if venue else f"p{a}"
            places.setdefault(chosen, venue[1:] if venue else (lat, lon))
        if pending and pending["place"] == chosen:
            pending["d"] = b
        else:
            if pending:
                visits.append(pending)
            pending = {"place": chosen, "a": a, "d": b, "day": day}
        out.append((chosen, most, pending["a"]))
    return out


@pytest.mark.parametrize("many", [3, 4096])
def test_fold_of_places(monkeypatch, many):
    """With places of few visits and of many."""
    monkeypatch.setattr(stays, "MANY", many)
    rng = random.Random(5)
    rows = []
    for day in range(60):
        times = sorted(rng.sample(range(86400), 12))
        for a, b in zip(times[::2], times[1::2], strict=True):
            at = 51.5 + rng.randrange(8) * 0.001, -0.1 + rng.randrange(8) * 0.001
            rows.append((day, day * 86400 + a, day * 86400 + b, *at, rng.choice([None, (1, 51.501, -0.099), (2, 51.504, -0.095)])))
    fold = stays.Fold()
    got = [fold.assign(*r) for r in rows]
    assert got == plain_places(rows)
    names = [g[0] for g in got]
    assert {n[0] for n in names} == {"v", "p"} and len(set(names)) < len(rows) / 2 and len({g[2] for g in got}) < len(rows)


def test_a_known_place_must_share_time(spark):
    """Twelve hours later the stay's place is the likeliest venue, not the known place nearby; and the likeliest isn't the nearest."""
    stay = spark.createDataFrame([(1, 0, 3600, 7200, 51.5, -0.1), (1, 0, 50400, 54000, 51.5, -0.1), (1, 1, 86400 + 50400, 86400 + 54000, 51.5, -0.1)], "user_id long, day_no long, arrival long, departure long, lat double, lon double")
    stay = stay.withColumns({c: F.lit(0).cast(k) for c, k in (("nb_steps", "long"), ("speed", "double"), ("step", "double"), ("n_points", "long"))})
    names = [c.split()[0] for c in stays.STAY.split(", ")]
    far = lambda m: 51.5 + m / 178_000  # noqa: E731  metres of the projection at this latitude
    # 0.1 * 1 + 1.5 / sqrt(110) > 1.5 / sqrt(100): the likeliest is farther
    venues = spark.createDataFrame([(7, far(100), -0.1, 0), (8, far(110), -0.1, 500), (9, far(400), -0.1, 900)], "venue_id long, lat double, lon double, nb_checkins long")
    first = stays.assign_places(stay.select(*names), venues.filter("venue_id = 9")).orderBy("arrival").collect()
    assert [r.place_id for r in first] == ["p3600", "p50400", "p50400"] and [r.overlap for r in first] == [0, 0, 3600]
    found = stays.assign_places(stay.select(*names), venues).orderBy("arrival").collect()
    # the first visit isn't known yet when the second stay asks, and goes on in it
    assert [(r.place_id, r.visit_arrival) for r in found] == [("v8", 3600), ("v8", 3600), ("v8", 136800)]


def test_assigned_places_of_the_table(spark, small):
    """Against the plain version, with venues from all pairs."""
    got = sequences.assigned_places(spark, small).collect()
    venues = view(spark, small, "fx_venue").collect()
    x, y = np.array([v.lon for v in venues]), np.array([v.lat for v in venues])
    metres = lambda la, lo: (6378137 * np.radians(lo), 6378137 * np.log(np.tan(np.pi / 4 + np.radians(la) / 2)))
    vx, vy = metres(y, x)
    by = {}
    for r in got:
        px, py = metres(r.lat, r.lon)
        away = np.hypot(vx - px, vy - py)
        some = [(v, d) for v, d in zip(venues, away, strict=True) if d <= 200]
        most = max((v.nb_checkins for v, _ in some), default=0)
        best = max(some, key=lambda s: (round((0.1 * s[0].nb_checkins / most if most else 0) + 1.5 / np.sqrt(s[1] or 1), 9), -s[0].venue_id), default=None)
        by.setdefault(r.user_id, []).append(((r.day_no, r.arrival, r.departure, r.lat, r.lon, best and (best[0].venue_id, best[0].lat, best[0].lon)), (r.place_id, r.overlap, r.visit_arrival)))
    assert len(by) > 5
    for rows in by.values():
        rows.sort(key=lambda r: r[0][1:3])
        assert plain_places([a for a, _ in rows]) == [b for _, b in rows]


def test_a_long_history_is_bounded():
    """Sixty thousand stays of one user over a few thousand places: what is held are these."""
    import tracemalloc

    fold, n = stays.Fold(), 60_000
    tracemalloc.start()
    for i in range(n):
        day, part = divmod(i, 20)
        fold.assign(day, day * 86400 + part * 4000, day * 86400 + part * 4000 + 900, 51.5 + (i * 7 % 40) * 0.01, -0.1, None)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 60e6 and sum(p.n for p in fold.known.places.values()) >= n - 1


def test_home_and_work(spark):
    day = lambda n: 1_704_067_200 + n * 86400
    rows = [(1, n, day(n), 7, day(n), day(n) + 8 * 3600, 0) for n in (0, 1, 2)] + [(1, n, day(n), 8, day(n) + 9 * 3600, day(n) + 10 * 3600, 0) for n in (0, 1, 2)]
    rows += [(2, n, day(n), 7, day(n), day(n) + 8 * 3600, 0) for n in (0, 2)] + [(3, n, day(n), 7, day(n), day(n) + 8 * 3600, None) for n in (0, 1, 2)]
    v = spark.createDataFrame(rows, "user_id long, day_no long, day_start long, place_id long, arrival long, departure long, utc_offset long")
    # the last visit goes on to the end of the day: place 8 has all working hours, and the evening
    assert [tuple(r) for r in stays.home_and_work(v, 3).collect()] == [(1, 7, [8])]


def test_variants(spark, small):
    """Thirty variants; a mean vector's best match has the greatest cosine of all."""
    from mobtrace.plans import interests as jobs

    rows = jobs.variants(spark, small).collect()
    assert len({(r.model_type, r.feature_type, r.phrase, r.avg) for r in rows}) == 30
    best = {}
    for r in rows:
        best.setdefault((r.model_type, r.feature_type, r.phrase, r.avg, r.venue_id), []).append((r["rank"], r.score, r.pi_id))
    assert all([x[0] for x in sorted(own)] == list(range(len(own))) and sorted(own) == sorted(own, key=lambda x: (-x[1], x[2])) for own in best.values())
    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    means = {r.pi_id: np.array(r.of_pi) for r in jobs.tag_means(spark, small).collect()}
    words = {}
    for r in jobs.name_words(spark, small).filter("source = 'name' and not phrase and venue_id < 9").withColumn("vec", F.expr(f"pmod(xxhash64(word, 1), {len(e)})")).collect():
        words.setdefault(r.venue_id, []).append(e[r.vec])
    for venue, vectors in words.items():
        mean = np.mean(vectors, axis=0)
        cos = sorted((-round(float(mean @ m / np.linalg.norm(mean) / np.linalg.norm(m)), 6), p) for p, m in means.items())
        got = sorted(best["cbow", "name", False, True, venue])
        assert [(x[2], pytest.approx(x[1], abs=2e-6)) for x in got][:1] == [(cos[0][1], -cos[0][0])]


def test_topic_queries(spark, small):
    from mobtrace.plans import models as jobs

    mix = jobs.topics(spark, small).collect()
    by = {}
    for r in mix:
        by.setdefault(r.category_id, []).append((r["rank"], -r.share))
    assert all(sorted(own) == sorted(own, key=lambda x: (x[1], x[0])) and -1.01 < sum(s for _, s in own) < 0 for own in by.values())
    t = jobs.topic_words(spark, small).collect()
    assert t and all(len(r.words) == 10 == len(set(r.words)) for r in t)
    listed = jobs.topics_of_category(spark, small).collect()
    assert {r.category_id for r in listed} == set(by) and all(r.words and r.tips for r in listed)
    f = jobs.factor_topics(spark, small).collect()
    assert f and all(r.weight >= 0 for r in f)
    v = jobs.place_embeddings(spark, small).collect()
    vectors = {r.pi_id: np.array(r.vector) for r in v}
    for r in v:
        cos = sorted((-float(vectors[r.pi_id] @ x / np.linalg.norm(vectors[r.pi_id]) / np.linalg.norm(x)), p) for p, x in vectors.items() if p != r.pi_id)
        assert len(r.vector) == 300 and -cos[0][0] - 1e-5 <= float(vectors[r.pi_id] @ vectors[r.nearest[0]] / np.linalg.norm(vectors[r.pi_id]) / np.linalg.norm(vectors[r.nearest[0]]))


def test_held_out_models(spark, small):
    from mobtrace.plans import models as jobs

    c = jobs.hold_out(spark, small).first()
    rows = jobs.matrix(spark, small).filter((F.col("venue_id") * 31 + F.col("pi_id") * 7) % 5 == 0).count()
    assert c.tp + c.fp + c.fn + c.tn == rows
    weights = {r.feature: r.weight for r in jobs.coefficients(spark, small).collect()}
    assert set(weights) == {*jobs.MODELS, "intercept"} and all(np.isfinite(w) for w in weights.values())


def test_saved_model(spark, small, tmp_path):
    """A model that is read again predicts what the trained one did; saving again replaces it."""
    from mobtrace.plans import models as jobs

    rows = jobs.matrix(spark, small)
    trained = models.train(rows, jobs.MODELS)
    path = str(tmp_path / "model")
    for _ in range(2):
        again = models.saved(trained, path)
    assert list(again.coefficients) == list(trained.coefficients) and again.intercept == trained.intercept
    a, b = (sorted(map(tuple, models.predicted(x, rows, jobs.MODELS).collect())) for x in (trained, again))
    assert a == b and len(a) == rows.count()


def test_nested_trees(spark):
    """Trees of any depth, nested or as edges; a cycle that hangs on nothing has no path."""
    from mobtrace.operators.trees import paths

    text = "[]"
    for i in reversed(range(20)):
        text = f'[{{"id":"c{i}","name":"n{i}","categories":{text}}}]'
    flat = files.flatten_categories(spark.createDataFrame([(text,), ("[]",), (None,)], "value string"))
    assert sorted((r.category_id, r.parent_id) for r in flat.collect()) == sorted((f"c{i}", f"c{i - 1}" if i else "") for i in range(20))
    edges = flat.unionByName(spark.createDataFrame([("x", "y", "a"), ("y", "x", "b")], "category_id string, parent_id string, name string"))
    assert sorted(len(r.ids) for r in paths(edges).collect()) == list(range(1, 21))


def test_model_jobs(spark, small):
    from mobtrace.plans import models as jobs

    rows = jobs.matrix(spark, small)
    more = models.oversampled(rows, jobs.MODELS, jobs.KEY)
    before, after = ({r.label: r["count"] for r in df.groupBy("label").count().collect()} for df in (rows, more))
    assert max(after.values()) == max(before.values()) and min(after.values()) >= min(before.values())
    fitted = models.train(more, jobs.MODELS)
    out = models.predicted(fitted, rows, jobs.MODELS)
    c = models.confusion(out).first()
    counted = [(int(r.label), int(r.prediction)) for r in out.collect()]
    assert (c.tp, c.fp, c.fn, c.tn) == tuple(counted.count(x) for x in ((1, 1), (0, 1), (1, 0), (0, 0)))
    p = jobs.predictions(spark, small).collect()
    assert all(0 <= r.score <= 1 for r in p) and {r.type for r in p} <= {"user", "predict"}
    t = jobs.topics(spark, small).collect()
    assert t and all(0 <= r.share <= 1 for r in t)


def test_oversampled_fully(spark):
    """At 20:1 both labels end as many, and neighbours are the same in one block and in many."""
    given = [(i, float(i * 37 % 101), float(i * 53 % 89), 0.0) for i in range(400)] + [(1000 + i, float(i * i % 23), float(i * 7 % 11), 1.0) for i in range(19)]
    df = spark.createDataFrame(given, "id long, a double, b double, label double")
    out = models.oversampled(df, ["a", "b"], ["id"])
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {0.0: 400, 1.0: 400}
    rare = {i: (a, b) for i, a, b, label in given if label}
    brute = {}
    for i, p in rare.items():
        others = sorted(((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2, q) for j, q in rare.items() if j != i)
        brute[i] = [list(q) for _, q in others[:5]]
    for block in (100, 3):
        got = models.nearest(df.filter("label = 1"), ["a", "b"], ["id"], len(rare), 5, block).collect()
        assert {r.id: r.near for r in got} == brute


def test_middle_in_blocks():
    draw = np.random.default_rng(3)
    lat, lon = 51 + draw.random(50) / 100, draw.random(50) / 100
    every = stays.distances(lat[:, None], lon[:, None], lat[None], lon[None])
    for at_once in (1, 120, 10_000):
        far, total = stays.middle_of(lat, lon, at_once)
        assert far == every.max() and np.allclose(total, every.sum(axis=1), rtol=1e-12)


def test_entry_without_llm(tmp_path):
    """In a copy without the corpus folders and the pipeline the entry still has all other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "mobtrace"), tmp_path / "mobtrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    told = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'pipeline' not in q and not any(n.startswith('op') for n in q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", told], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 150


def plain_cells(points, most, deepest, depth=0, cx=0, cy=0):
    """Cells split in four from the whole square on, point by point."""
    side = 2**depth
    own = [p for p in points if min(int(p[0] * side), side - 1) == cx and min(int(p[1] * side), side - 1) == cy]
    if not own:
        return []
    if len(own) < most or depth == deepest:
        return [(depth, cx, cy, len(own))]
    return [c for i in (0, 1) for j in (0, 1) for c in plain_cells(own, most, deepest, depth + 1, 2 * cx + i, 2 * cy + j)]


@pytest.mark.parametrize("most, deepest, parts", [(1, 30, 4), (3, 30, 7), (4, 6, 2), (50, 30, 3), (10_000, 30, 4)])
def test_adaptive_cells(spark, most, deepest, parts):
    rng = random.Random(most)
    points = [(rng.random(), rng.random()) for _ in range(300)] + [(0.3 + rng.random() / 1e5, 0.7) for _ in range(200)]
    points += [(0.25, 0.5)] * 60 + [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0)]
    df = spark.createDataFrame([*points, (None, 0.5), (0.5, None), (1.5, 0.5)], "x double, y double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = [tuple(r) for r in trees.adaptive_cells(df, F.col("x"), F.col("y"), most, deepest).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert sorted(got) == sorted(plain_cells(points, most, deepest))
    assert trees.adaptive_cells(df.limit(0), F.col("x"), F.col("y"), most).collect() == []


def test_adaptive_cells_of_venues(spark, small):
    points = [((r.lon + 180) / 360, (r.lat + 90) / 180) for r in view(spark, small, "fx_venue").collect()]
    assert sorted(map(tuple, sequences.adaptive_cells(spark, small).collect())) == sorted(plain_cells(points, 50, 30))


@pytest.mark.parametrize("long", [256, 6])
def test_proposals_are_complete(spark, long):
    """No pair of such a ratio is missed, of names of any letters and lengths; few that have a lower one are proposed."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefghij é😀1") for _ in range(n)) for n in (1, 2, 3, 5, 8, 13, 21, 40, 70, 300)]
    names = set(base)
    for b in base:
        for _ in range(12):
            chars = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 4))):
                at = rng.randrange(len(chars) + 1)
                chars[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "ab", "é"])
            names.add("".join(chars) or "q")
    df = spark.createDataFrame([("g", n) for n in names], "k string, a string")
    got = [(r.a, r.b) for r in interests.proposed_pairs(df, ["k"], long).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    want = {(a, b) for a in names for b in names if a < b and interests.ratio(a, b) >= interests.SAME}
    assert want <= set(got) and len(got) <= 10 * len(want)


def test_similar_pairs_of_odd_names(spark):
    """Nulls and empty names resemble none; repeated rows count once; an empty table gives none."""
    rows = [(1, None), (1, ""), (1, "opera"), (1, "operas"), (1, "opera"), (None, "opera"), (None, "operas")]
    df = spark.createDataFrame(rows, "key int, name string")
    assert [tuple(r) for r in interests.similar_pairs(df, ["key"], "name").collect()] == [(1, "opera", "operas")]
    assert interests.similar_pairs(df.limit(0), ["key"], "name").collect() == []


def test_neighbours_of_sequence_vectors(spark):
    """Words of places that are visited one after the other are nearest to each other, whatever the length of a history."""
    rng = random.Random(2)
    rows = []
    for user in range(60):
        names = "abcde" if user % 2 else "vwxyz"
        rows += [(user, k, [rng.choice(names), rng.choice(names)]) for k in range(60)]
    rows += [(1, 99, []), (2, 99, None), (3, 99, ["once"])]
    steps = spark.createDataFrame(rows, "user long, ts long, words array<string>")
    for stretch in (200, 7):
        found = models.sequence_vectors(steps, "user", ["ts"], "words", 12, rounds=8, stretch=stretch)
        v = {r.word: np.array(r.vector) / np.linalg.norm(r.vector) for r in found.collect()}
        assert set(v) == set("abcdevwxyz")
        for word in v:
            nearest = sorted((w for w in v if w != word), key=lambda w: -v[w] @ v[word])[:4]
            assert set(nearest) | {word} in (set("abcde"), set("vwxyz"))


def test_logs_of_files_and_folders(spark, tmp_path):
    """User and day come from a file's name or from that of the folder of its parts."""
    text = "|User|,|Timestamp|,|Session|,|Type|,|Args|\n|x|,|2024-03-01 10:00:00|,|s|,|t|,|{\"a\": 1}|\n|x|,|never|,|s|,|t|,|{}|\n"
    (tmp_path / "u1_2024-03-01_4_log.csv").write_text(text)
    (tmp_path / "name=u_2_2024-03-02_5_log.csv").mkdir()
    (tmp_path / "name=u_2_2024-03-02_5_log.csv" / "part-0.csv").write_text(text)
    got = sorted((r.user_id, r.day, r.session) for r in files.read_logs(spark, str(tmp_path)).collect())
    assert got == [("u1", "2024-03-01", "s"), ("u_2", "2024-03-02", "s")]


def test_topics_by_category(spark):
    """Models of two categories equal fits by themselves in plain loops; themes are told apart; tips without terms have an even mix."""
    rng = random.Random(5)
    themes = ["pizza pasta oven".split(), "opera stage choir".split()]
    rows = [(i, f"c{i % 2}", [rng.choice(themes[i // 2 % 2]) for _ in range(8)]) for i in range(80)] + [(90, "c0", ["alone"]), (91, "few", ["pizza"])]
    tips = spark.createDataFrame(rows, "tip_id long, category_id string, words array<string>")
    weights, mixes = models.topics(tips, k=2, least=30, rounds=4)
    weights = {(r.category_id, r.term): np.array(r.weights) for r in weights.collect()}
    mix = {r.tip_id: np.array(r.mix) for r in mixes.collect()}
    assert set(mix) == set(range(80)) | {90} and np.allclose(mix[90], 0.5)
    start = {r.term: np.array(r.w) for r in spark.createDataFrame([(t,) for _, t in weights], "term string").distinct().select("term", F.array(*[0.5 + F.pmod(F.xxhash64("term", F.lit(i), F.lit(1)), F.lit(1_000_000)) / 1_000_000 for i in range(2)]).alias("w")).collect()}
    for c in ("c0", "c1"):
        bags = {i: [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))] for i, k, w in rows if k == c}
        df = {t: sum(t in b for b in bags.values()) for b in bags.values() for t in b}
        lam = {t: start[t] for t, n in df.items() if 2 <= n <= 0.95 * len(bags)}
        assert {t for k, t in weights if k == c} == set(lam)
        for _ in range(4):
            total, new = sum(lam.values()), {t: np.full(2, 0.5) for t in lam}
            for b in bags.values():
                own = sorted(set(b) & set(lam))
                if own:
                    _, dealt = models.topic_mix(np.array([b.count(t) for t in own], dtype=float), np.stack([models.digamma(lam[t]) - models.digamma(total) for t in own]), 0.5)
                    for t, x in zip(own, dealt, strict=True):
                        new[t] = new[t] + x
            lam = new
        assert all(np.allclose(weights[c, t], x, rtol=1e-6) for t, x in lam.items())
        best = {i: int(mix[i].argmax()) for i, k, w in rows if k == c and i < 80}
        assert len({(i // 2 % 2, t) for i, t in best.items()}) == 2
    assert np.allclose(models.digamma(np.array([1.0, 0.1, 20.0])), [-0.5772156649, -10.4237549404, 2.9705239922], atol=1e-7)


def test_topics_are_packed(spark, monkeypatch):
    """Terms are counted by columns as one by one, whatever rows a tip comes in, and a round's rows are packs of tips, not terms of tips."""
    from mobtrace.sources import scratch

    texts = [["a", "b", "a", "b", None, "c"], [], None, ["c"], ["b", "a", "b"]]
    text, term, n, names = models.counted_grams(pa.array(texts, pa.list_(pa.string())))
    want = {}
    for i, w in enumerate(texts):
        for g in [x for x in w or [] if x] + [f"{a} {b}" for a, b in zip(w or [], (w or [])[1:]) if a and b]:
            want[i, g] = want.get((i, g), 0) + 1
    assert {(int(i), names[int(t)].as_py()): int(c) for i, t, c in zip(text, term, n, strict=True)} == want
    monkeypatch.setattr(models, "PACKED", 7)
    monkeypatch.setattr(models, "WORDS", 20)
    written = {}
    monkeypatch.setattr(models, "cut", lambda df, name: written.setdefault(name, scratch.cut(df, name)) if name == "bag" else scratch.cut(df, name))
    rng = random.Random(1)
    rows = [(i, "c", [rng.choice("pqrst") for _ in range(9)]) for i in range(60)]
    split = [(i, c, part) for i, c, w in rows for part in ([w] if i % 9 else [w[:4], w[4:]])]
    schema = "tip_id long, category_id string, words array<string>"
    weights, mixes = models.topics(spark.createDataFrame(split, schema), k=2, least=30, rounds=2)
    bag = written["bag"].select("part", F.explode("tips").alias("x")).collect()
    assert written["bag"].count() <= 9 and {r.x.tip_id for r in bag} == set(range(60)) == {r.tip_id for r in mixes.collect()}
    terms = {r.term for r in weights.collect()}
    held = {r.x.tip_id: sum(t.n for t in r.x.terms) for r in bag}
    of = lambda i: [p for k, _, p in split if k == i]
    assert held == {i: sum(g in terms for p in of(i) for g in [*p, *(f"{a} {b}" for a, b in zip(p, p[1:]))]) for i in range(60)}


def test_best_matches_in_blocks(spark):
    """Whatever the blocks, the best are those of all pairs by rounded cosine and id; no lambda works out a cosine; vectors without a direction come last, those that are null not at all."""
    draw = np.random.default_rng(3)
    v = {i: draw.integers(-2, 3, 4).astype(float).tolist() for i in range(60)} | {60: [0.0] * 4, 61: None}
    df = spark.createDataFrame(list(v.items()), "id long, v array<double>")
    asked = df.filter("id < 20").withColumnsRenamed({"id": "of", "v": "q"})
    unit = lambda x: np.array(x) / np.linalg.norm(x)
    fine = {i: unit(x) for i, x in v.items() if x and any(x)}
    want = {(a, b, s) for a in range(20) if a in fine for s, b in sorted((-round(float(fine[a] @ x), 6), b) for b, x in fine.items())[:5]}
    for block, pack in ((1000, 1000), (7, 3)):
        found = interests.best_matches(asked, "q", df, "id", "v", 5, block, pack)
        text = found._jdf.queryExecution().toString()
        assert "zip_with" not in text and "MapInArrow" in text
        assert {(r.of, r.id, -r.score) for r in found.collect() if r.of in fine} == want
    assert [r.id for r in interests.best_matches(asked.filter("of = 1"), "q", df, "id", "v", 99).collect() if r.score is None] == [i for i in v if v[i] and not any(v[i])]


def test_an_export_has_one_file_a_folder(spark, small):
    """A user's folder of a kind has one file, however many tasks its rows come from."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        registry.load()
        found = registry.QUERIES["S21_user_export"](spark, small).inputFiles()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert found and len(found) == len({f.rsplit("/", 1)[0] for f in found})


def test_sequence_vectors_in_several_tasks(spark, monkeypatch):
    """A round's words are shared out over tasks by their number; words of one theme stay nearest."""
    from pyspark.ml.feature import Word2Vec

    asked, fit = [], Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, *a, **b: (asked.append(self.getNumPartitions()), fit(self, *a, **b))[1])
    rng = random.Random(3)
    rows = [(u, t, [rng.choice(["abcde", "vwxyz"][u % 2])]) for u in range(60) for t in range(120)]
    steps = spark.createDataFrame(rows, "user_id long, ts long, words array<string>")
    v = {r.word: np.array(r.vector) for r in models.sequence_vectors(steps, "user_id", ["ts"], "words", 12, share=2000).collect()}
    assert asked == [3] and set(v) == set("abcdevwxyz")
    unit = {w: x / np.linalg.norm(x) for w, x in v.items()}
    for word in v:
        assert max((w for w in v if w != word), key=lambda w: unit[w] @ unit[word]) in ("abcde" if word in "abcde" else "vwxyz")


def test_factors_in_blocks_of_bounded_size(spark, monkeypatch):
    """The blocks of documents grow in number with the weights, not in size."""
    from pyspark.ml.recommendation import ALS

    asked, fit = [], ALS.fit
    monkeypatch.setattr(ALS, "fit", lambda self, *a, **b: (asked.append(self.getNumUserBlocks()), fit(self, *a, **b))[1])
    df = spark.range(300).select((F.col("id") % 30).cast("int").alias("doc"), F.floor(F.col("id") / 30).cast("int").alias("term"), F.lit(1.0).cast("float").alias("weight"))
    models.factor_topics(df, 2)
    found = models.factor_topics(df, 2, share=20)
    assert asked == [10, 15] and found.itemFactors.count() == 10
