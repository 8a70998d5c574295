"""Operators over rows against plain versions: neighbours in time, running sums, phrases, candidates by owner."""

import random
import time

from pyspark.sql import functions as F

from mobtrace.fixtures import view
from mobtrace.functions import scalars
from mobtrace.operators import changes, interests, overlaps, rows
from mobtrace.plans import interests as jobs
from mobtrace.plans import joins


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_in_time(spark):
    """Any width of the stretches gives the same, ties, nulls, repeated and lonely rows included."""
    draw = random.Random(2)
    known = sorted({(draw.choice([1, 2, 3, None]), draw.randrange(300)) for _ in range(60)}, key=str)
    asked = [(i, draw.choice([1, 2, 3, 4, None]), draw.choice([None, *range(-20, 320)])) for i in range(200)] + [(0, 1, 5)]
    q = spark.createDataFrame(asked, "id long, user_id long, t long")
    v = spark.createDataFrame([(*k, f"{k}") for k in known], "user_id long, t long, said string")

    def plain(user, at):
        own = [] if user is None or at is None else [t for u, t in known if u == user]
        return max((t for t in own if t <= at), default=None), min((t for t in own if t > at), default=None)

    for width in (1, 7, 50, 10_000):
        got = rows.around(q, v, "user_id", "t", width)
        assert "unboundedfollowing" not in plan(got).lower()
        got = [(r.id, r.user_id, r.t, r.before and r.before.t, r.after and r.after.t) for r in got.collect()]
        assert sorted(got, key=str) == sorted(((i, u, t, *plain(u, t)) for i, u, t in asked), key=str)


def test_a_long_history_has_no_quadratic_frame(spark):
    """Three hundred thousand rows of one user in three years."""
    began = time.time()
    v = spark.range(150_000).selectExpr("1L user_id", "id * 600 t", "id said")
    q = spark.range(150_000).selectExpr("id", "1L user_id", "id * 600 + 299 t")
    got = rows.around(q, v, "user_id", "t").filter("before.said = id and (after.said = id + 1 or (after is null and id = 149999))")
    assert got.count() == 150_000 and time.time() - began < 60
    offsets = changes.offsets_at(q, spark.range(150_000).selectExpr("1L user_id", "id * 600 arrival", "id visit_id", "id utc_offset"))
    assert offsets.filter("offset = id").count() == 150_000


def test_running_sums_and_numbers(spark):
    draw = random.Random(4)
    values = [(i, draw.randrange(9)) for i in draw.sample(range(1000), 200)]
    df = spark.createDataFrame(values, "id long, n long").repartition(5)
    total, want = 0, []
    for no, (i, n) in enumerate(sorted(values)):
        total += n
        want.append((i, n, total, no + 1))
    out = rows.numbered(rows.running_sum(df, [F.col("id")], "n", "upto"), [F.col("id")], "no")
    assert [tuple(r) for r in out.select("id", "n", "upto", "no").orderBy("id").collect()] == want
    assert rows.running_sum(df.limit(0), [F.col("id")], "n", "upto").count() == 0


def test_joined_phrases(spark):
    """From left to right, a word is joined once; texts without phrases, words or neighbours stay."""
    pairs = [("a", "b"), ("b", "a"), ("b", "c"), ("a", "a")]
    draw = random.Random(1)
    texts = [(i, [draw.choice("abcd") for _ in range(draw.randrange(12))]) for i in range(60)] + [(60, []), (61, ["a"]), (62, ["a", "b"])]

    def plain(words):
        out = []
        while words:
            n = 2 if tuple(words[:2]) in pairs else 1
            out.append("_".join(words[:n]))
            words = words[n:]
        return out

    df = spark.createDataFrame(texts, "id long, words array<string>").repartition(3)
    got = {r.id: r.words for r in interests.joined_phrases(df, spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {i: plain(w) for i, w in texts}
    learned = {(r.a, r.b): r.n for r in interests.learned_phrases(df, 3, 0.0).collect()}
    counts = {}
    for _, w in texts:
        for p in zip(w, w[1:], strict=False):
            counts[p] = counts.get(p, 0) + 1
    assert learned == {p: n for p, n in counts.items() if n > 3}


def test_phrases_need_no_windows(spark, small):
    found = plan(jobs.phrases(spark, small))
    assert "Window" not in found and "NestedLoop" not in found and found.count("Exchange") < 12


def test_private_places_meet_their_owner_only(spark, small):
    """What the join makes of private places are a user's own pairs: none is thrown away behind it."""
    both = joins.candidates(spark, small)
    assert both.filter("kind = 'place'").count() > 0
    own = view(spark, small, "fx_place").select("user_id", F.col("place_id").alias("id"))
    assert both.filter("kind = 'place'").join(own, ["user_id", "id"], "left_anti").count() == 0
    keys = [line for line in plan(both).splitlines() if "Join" in line and "user_id" in line]
    assert keys and "owner" not in plan(both)


def test_trigrams_as_numbers(spark):
    names = ["Blue anvil 7", "", "a", "ab  cd", "Été 12", "zz zz"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    a, b = scalars.trigrams(F.col("a")), scalars.trigrams(F.col("b"))
    number = scalars.trigram_numbers
    assert df.filter(scalars.containment(a, b) != scalars.containment(number(a), number(b))).count() == 0
    assert df.filter(F.size(number(a)) != F.size(F.array_distinct(number(a)))).count() == 0


def test_overlaps_make_no_pairs(spark, small, monkeypatch):
    """Rows by rows and with counts of earlier ones the sums are those of all pairs; no join is of visits with visits."""
    monkeypatch.setattr(overlaps, "AT_ONCE", 7)
    draw, day = random.Random(4), 86400
    visits = [(draw.randrange(2), draw.randrange(40), s, s + draw.choice([0, 5, 600, 40_000, day])) for s in (draw.randrange(day) for _ in range(90))]
    asked = [(100 + i, u, at, s - 3600, e + 3600) for i, (u, at, s, e) in enumerate(visits[:50])]
    want = {}
    for k, u, at, s, e in asked:
        n = sum(max(0, min(e, b + m) - max(s, a + m)) for w, t, a, b in visits if w == u and t < at for m in (-day, 0, day))
        want |= {(k, u): n} if n else {}
    a = spark.createDataFrame(asked, "id long, u long, at long, start long, end long").repartition(3)
    v = spark.createDataFrame(visits, "u long, at long, start long, end long").repartition(3)
    assert {(r.id, r.u): r.overlap for r in overlaps.with_earlier(a, v, ["u"], "id", 3600).collect()} == want
    text = plan(joins.time_of_day_overlap(spark, small))
    assert "arrival" not in "".join(line for line in text.splitlines() if "Join" in line) and "MapInArrow" in text


def test_phrases_are_counted_in_columns(spark):
    """Words and pairs come out of batches as sums, so no word is a row of its own."""
    df = spark.createDataFrame([(i, ["new", "york", "is", "big"]) for i in range(9)] + [(10, []), (11, None), (12, ["york"])], "id long, words array<string>").repartition(3)
    found = interests.learned_phrases(df, 5, 0.0)
    assert {(r.a, r.b): (r.n, r.score) for r in found.collect()} == {("new", "york"): (9, round(7 / 90, 9)), ("york", "is"): (9, round(7 / 90, 9)), ("is", "big"): (9, round(7 / 81, 9))}
    assert "Generate" not in plan(found)
