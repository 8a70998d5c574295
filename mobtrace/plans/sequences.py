"""Sequences: stays, visits, moves, windows, home and work."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mobtrace.fixtures import oracle, view
from mobtrace.operators import rows as r
from mobtrace.operators import stays as s
from mobtrace.operators import trees
from mobtrace.plans.registry import query


@query("flagship")
def flagship(spark, d):
    """Time per place: trace to stays, stays to the nearest venue, consecutive stays to visits, visits to totals."""
    found = s.extract_stays(view(spark, d, "fx_trace"))
    venues = view(spark, d, "fx_venue").groupBy("lat", "lon").agg(F.min("venue_id").alias("place_id"))
    visits = s.nearest_stays_to_places(found, venues, 300.0).filter("place_id is not null")
    visits = visits.select("user_id", "place_id", "arrival", "departure", F.col("arrival").alias("visit_id"), F.lit(-3600).cast("long").alias("utc_offset"))
    return s.merged_visits(visits).groupBy("place_id").agg(F.sum(F.col("departure") - F.col("arrival")).alias("duration"), F.count("*").alias("visits"), F.count_distinct("user_id").alias("users"))


@query("W1_stays")
def stays(spark, d):
    return s.extract_stays(view(spark, d, "fx_trace"))


HAVERSINE = "2 * 6372795.0 * asin(sqrt(least(1.0, pow(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))))"


@query("W2_steps_and_speed", oracle(f"WITH p AS (SELECT *, (ts_local - day_start) // 14400 AS part, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(ts_local) OVER w AS ts2 FROM fx_trace WINDOW w AS (PARTITION BY user_id, day_no, (ts_local - day_start) // 14400 ORDER BY ts_local)), c AS (SELECT user_id, day_no, part, round(avg({HAVERSINE}), 3) AS step, round(avg({HAVERSINE} / (ts2 - ts_local)), 6) AS speed FROM p WHERE lat2 IS NOT NULL GROUP BY user_id, day_no, part), q AS (SELECT a.user_id, a.day_no, a.part, a.ts_local, max({HAVERSINE.replace('radians(lat)', 'radians(a.lat)').replace('- lat)', '- a.lat)').replace('- lon)', '- a.lon)').replace('lat2', 'b.lat').replace('lon2', 'b.lon')}) AS far, round(sum({HAVERSINE.replace('radians(lat)', 'radians(a.lat)').replace('- lat)', '- a.lat)').replace('- lon)', '- a.lon)').replace('lat2', 'b.lat').replace('lon2', 'b.lon')}), 3) AS total FROM p a JOIN p b ON a.user_id = b.user_id AND a.day_no = b.day_no AND a.part = b.part GROUP BY 1, 2, 3, 4), m AS (SELECT user_id, day_no, part, round(max(far), 3) AS diameter, arg_min(ts_local, (total, ts_local)) AS medoid FROM q GROUP BY 1, 2, 3) SELECT m.user_id, m.day_no, m.part, diameter, medoid, step, speed FROM m LEFT JOIN c ON m.user_id = c.user_id AND m.day_no = c.day_no AND m.part = c.part", "fx_trace"))
def steps_and_speed(spark, d):
    """Diameter, medoid, mean step and mean speed of each four hours of a user's trace; distances between their points are worked out in blocks, never as rows."""
    from mobtrace.functions import geo

    key = ["user_id", "day_no", "part"]
    t = view(spark, d, "fx_trace").withColumn("part", F.floor((F.col("ts_local") - F.col("day_start")) / 14400))
    w = Window.partitionBy(*key).orderBy("ts_local")
    away = lambda lat2, lon2: geo.haversine(F.col("lat"), F.col("lon"), F.col(lat2), F.col(lon2), geo.STAY_RADIUS)
    p = t.withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w), "ts2": F.lead("ts_local").over(w)}).filter("lat2 is not null")
    c = p.groupBy(*key).agg(F.round(F.avg(away("lat2", "lon2")), 3).alias("step"), F.round(F.avg(away("lat2", "lon2") / (F.col("ts2") - F.col("ts_local"))), 6).alias("speed"))
    m = s.spans(t).withColumn("diameter", F.round("diameter", 3))
    return m.join(c, key, "left").select(*key, "diameter", "medoid", "step", "speed")


@query("W3_carried_in", oracle("WITH l AS (SELECT user_id, day_no, arg_max({'lat': lat, 'lon': lon}, ts_local) AS p FROM fx_trace GROUP BY user_id, day_no), d AS (SELECT DISTINCT user_id, day_no, day_start FROM fx_trace) SELECT user_id, day_no, ts_local, ts_utc, lat, lon FROM fx_trace UNION ALL SELECT d.user_id, d.day_no, d.day_start, d.day_start - 3600, l.p.lat, l.p.lon FROM d JOIN l ON l.user_id = d.user_id AND l.day_no + 1 = d.day_no"))
def carried_in(spark, d):
    return s.carried_in(view(spark, d, "fx_trace")).select("user_id", "day_no", "ts_local", "ts_utc", "lat", "lon")


@query("W4_assigned_places")
def assigned_places(spark, d):
    venues = view(spark, d, "fx_venue").select("venue_id", "lat", "lon", "nb_checkins")
    return s.assign_places(s.extract_stays(s.carried_in(view(spark, d, "fx_trace"))), venues)


@query("W5_merged_visits", oracle("WITH a AS (SELECT *, CASE WHEN lag(place_id) OVER w = place_id THEN 0 ELSE 1 END AS new FROM fx_visit WINDOW w AS (PARTITION BY user_id ORDER BY arrival, visit_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY arrival, visit_id ROWS UNBOUNDED PRECEDING) AS run FROM a) SELECT user_id, place_id, min(arrival) AS arrival, max(departure) AS departure, arg_max(utc_offset, (arrival, visit_id)) AS utc_offset, count(*) AS n_merged FROM b GROUP BY user_id, run, place_id"))
def merged_visits(spark, d):
    return s.merged_visits(view(spark, d, "fx_visit"))


@query("W6_moves", oracle("SELECT user_id, day_no, from_place, place_id AS to_place, left_at, arrival AS arrived_at FROM (SELECT *, lag(place_id) OVER w AS from_place, lag(departure) OVER w AS left_at FROM fx_visit WINDOW w AS (PARTITION BY user_id, day_no ORDER BY arrival, visit_id)) WHERE left_at IS NOT NULL"))
def moves(spark, d):
    return s.moves(view(spark, d, "fx_visit"))


@query("W7_last_visit_extended", oracle("SELECT visit_id, user_id, arrival, CASE WHEN row_number() OVER (PARTITION BY user_id, day_no ORDER BY arrival DESC, visit_id DESC) = 1 THEN greatest(departure, (day_no + 1) * 86400 - 1) ELSE departure END AS departure FROM fx_visit"))
def last_visit_extended(spark, d):
    w = Window.partitionBy("user_id", "day_no").orderBy(F.desc("arrival"), F.desc("visit_id"))
    v = view(spark, d, "fx_visit").withColumn("n", F.row_number().over(w))
    return v.select("visit_id", "user_id", "arrival", F.when(F.col("n") == 1, F.greatest("departure", (F.col("day_no") + 1) * 86400 - 1)).otherwise(F.col("departure")).alias("departure"))


#: Visits of a trace by part of the day: the place recurs at night and at work, else it changes. Local times; the offset is null for one user in seven.
PARTS = "SELECT user_id, day_no, day_start, (ts_local - day_start) // 14400 AS part, user_id * 10 + CASE (ts_local - day_start) // 14400 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 3 + day_no % 3 END AS place_id, min(ts_utc) AS arrival, max(ts_utc) AS departure, CASE WHEN user_id % 7 <> 5 THEN -3600 END AS utc_offset FROM fx_trace GROUP BY 1, 2, 3, 4, 5"
TODAY, DAYS, HOURS = 9, 3, 3
IN_HOURS = "greatest(0, least(e, day_start + {1} * 3600 + 3599) - greatest(s, day_start + {0} * 3600))"
HOME_AND_WORK = f"""v AS ({PARTS}), l AS (SELECT *, row_number() OVER (PARTITION BY user_id, day_no ORDER BY arrival DESC) = 1 AS last FROM v WHERE day_no BETWEEN {TODAY - DAYS} AND {TODAY - 1}),
ok AS (SELECT user_id FROM l GROUP BY user_id HAVING count(DISTINCT day_no) = {DAYS} AND count(*) FILTER (WHERE last AND utc_offset IS NULL) = 0),
t AS (SELECT l.*, greatest(day_start, arrival - utc_offset) AS s, CASE WHEN last THEN day_start + 86399 ELSE departure - utc_offset END AS e, (day_no % 7) < 5 AS weekday FROM l WHERE user_id IN (SELECT user_id FROM ok)),
p AS (SELECT user_id, place_id, sum({IN_HOURS.format(0, 7)} + {IN_HOURS.format(20, 23)})::BIGINT AS home_s, sum(CASE WHEN weekday THEN {IN_HOURS.format(9, 18)} ELSE 0 END)::BIGINT AS work_s FROM t GROUP BY user_id, place_id),
d AS (SELECT user_id, count(DISTINCT day_no) FILTER (WHERE weekday) * {HOURS} * 3600 AS least FROM t GROUP BY user_id),
hw AS (SELECT p.user_id, arg_max(place_id, (home_s, place_id)) FILTER (WHERE home_s > {DAYS * HOURS * 3600}) AS home, list_sort(list(place_id) FILTER (WHERE work_s > least)) AS work FROM p JOIN d ON p.user_id = d.user_id GROUP BY p.user_id)"""


def parts_of_days(spark, d):
    part = F.floor((F.col("ts_local") - F.col("day_start")) / 14400)
    place = F.col("user_id") * 10 + F.when(part < 2, 1).when(part < 4, 2).otherwise(3 + F.col("day_no") % 3)
    t = view(spark, d, "fx_trace").groupBy("user_id", "day_no", "day_start", part.alias("part"), place.alias("place_id"))
    return t.agg(F.min("ts_utc").alias("arrival"), F.max("ts_utc").alias("departure")).withColumn("utc_offset", F.when(F.col("user_id") % 7 != 5, F.lit(-3600)))


@query("W8_home_and_work", oracle(f"WITH {HOME_AND_WORK} SELECT * FROM hw", "fx_trace"))
def home_and_work(spark, d):
    return s.home_and_work(parts_of_days(spark, d), TODAY, DAYS, HOURS)


@query("W9_place_types", oracle(f"WITH {HOME_AND_WORK}, k AS (SELECT DISTINCT user_id, place_id, CASE WHEN place_id % 4 = 3 THEN 2 ELSE 0 END AS typed FROM v) SELECT k.user_id, k.place_id, (CASE WHEN typed <> 0 THEN typed WHEN k.place_id = hw.home THEN 1 WHEN list_contains(hw.work, k.place_id) THEN 3 ELSE 0 END)::BIGINT AS place_type FROM k LEFT JOIN hw ON k.user_id = hw.user_id", "fx_trace"))
def place_types(spark, d):
    """Only places without a type get a probable one: home 1, work 3."""
    v = parts_of_days(spark, d)
    found = s.home_and_work(v, TODAY, DAYS, HOURS)
    k = v.select("user_id", "place_id").distinct().withColumn("typed", F.when(F.col("place_id") % 4 == 3, 2).otherwise(0))
    kind = F.when(F.col("typed") != 0, F.col("typed")).when(F.col("place_id") == F.col("home"), 1).when(F.array_contains("work", F.col("place_id")), 3).otherwise(0)
    return k.join(found, "user_id", "left").select("user_id", "place_id", kind.cast("long").alias("place_type"))


@query("W10_challenges", oracle("WITH f AS (SELECT user_id, day_no, place_id, arg_min(visit_id, (arrival, visit_id)) AS visit_id FROM fx_visit GROUP BY user_id, day_no, place_id), p AS (SELECT DISTINCT venue_id AS place_id, pi_id FROM fx_score), u AS (SELECT f.*, p.pi_id, row_number() OVER (PARTITION BY f.user_id, f.day_no, f.place_id ORDER BY md5(f.user_id || ':' || f.day_no || ':' || f.place_id || ':' || p.pi_id || ':7')) AS k FROM f JOIN p ON f.place_id = p.place_id WHERE NOT EXISTS (SELECT 1 FROM fx_rating r WHERE r.session_id = f.user_id AND r.place_id = f.place_id AND r.pi_id = p.pi_id)) SELECT f.user_id, f.day_no, f.place_id, f.visit_id, u.pi_id, coalesce(u.k, 1) AS place_number FROM f LEFT JOIN (SELECT * FROM u WHERE k <= 2) u ON f.user_id = u.user_id AND f.day_no = u.day_no AND f.place_id = u.place_id", "fx_visit", "fx_score", "fx_rating"))
def challenges(spark, d, seed: int = 7):
    """For the first visit of each place of a day up to two of its interests that the user hasn't rated, drawn by a hash of the keys; one without interest where none is left."""
    key = ["user_id", "day_no", "place_id"]
    first = view(spark, d, "fx_visit").groupBy(*key).agg(F.min_by("visit_id", F.struct("arrival", "visit_id")).alias("visit_id"))
    every = view(spark, d, "fx_score").select(F.col("venue_id").alias("place_id"), "pi_id").distinct()
    rated = view(spark, d, "fx_rating").select(F.col("session_id").alias("user_id"), "place_id", "pi_id")
    left = first.select(*key).join(every, "place_id").join(rated, ["user_id", "place_id", "pi_id"], "left_anti")
    w = Window.partitionBy(*key).orderBy(F.md5(F.concat_ws(":", *key, "pi_id", F.lit(seed))))
    drawn = left.withColumn("k", F.row_number().over(w).cast("long")).filter("k <= 2")
    return first.join(drawn, key, "left").select(*key, "visit_id", "pi_id", F.coalesce("k", F.lit(1).cast("long")).alias("place_number"))


@query("W13_contexts", oracle("WITH q AS (SELECT user_id, venue_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, venue_id) AS n FROM fx_checkin), u AS (SELECT user_id FROM fx_checkin GROUP BY user_id HAVING count(*) >= 5) SELECT a.venue_id AS target, b.venue_id AS context, count(*) AS n FROM q a JOIN q b ON a.user_id = b.user_id AND b.n - a.n IN (-2, -1, 1, 2) WHERE a.user_id IN (SELECT user_id FROM u) GROUP BY ALL"))
def contexts(spark, d, reach: int = 2, least: int = 5):
    """Pairs of places within two steps of a user's sequence; neighbours come from one window, not from a join."""
    w = Window.partitionBy("user_id").orderBy("ts", "venue_id")
    q = view(spark, d, "fx_checkin").withColumn("size", F.count("*").over(Window.partitionBy("user_id"))).filter(F.col("size") >= least)
    near = F.array(*[f("venue_id", i).over(w) for i in range(1, reach + 1) for f in (F.lag, F.lead)])
    pairs = q.withColumn("near", F.array_compact(near)).select(F.col("venue_id").alias("target"), F.explode("near").alias("context"))
    return pairs.groupBy("target", "context").agg(F.count("*").alias("n"))


@query("W14_adaptive_cells")
def adaptive_cells(spark, d, most: int = 50):
    """Cells are split in four while they hold ``most`` venues or more."""
    return trees.adaptive_cells(view(spark, d, "fx_venue"), (F.col("lon") + 180) / 360, (F.col("lat") + 90) / 180, most)


@query("W15_fixed_grid", oracle("WITH b AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM fx_venue) SELECT i, j, round(s + i * (n - s) / 10, 8) AS south, round(w + j * (e - w) / 10, 8) AS west FROM b, range(10) a(i), range(10) c(j)"))
def fixed_grid(spark, d, parts: int = 10):
    b = view(spark, d, "fx_venue").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    index = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    g = b.select("*", index.alias("i")).select("*", index.alias("j"))
    return g.select("i", "j", F.round(F.col("s") + F.col("i") * (F.col("n") - F.col("s")) / parts, 8).alias("south"), F.round(F.col("w") + F.col("j") * (F.col("e") - F.col("w")) / parts, 8).alias("west"))
