"""Joins: equal keys, trees, distance, polygons, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from mobtrace.fixtures import oracle, table, view
from mobtrace.functions import scalars as x
from mobtrace.operators import overlaps
from mobtrace.operators import rows as r
from mobtrace.operators import spatial
from mobtrace.operators.trees import paths
from mobtrace.plans.registry import query
from mobtrace.plans.scalars import TRIGRAMS
from mobtrace.sources.scratch import cut


@query("J1_visits_with_venues", oracle("SELECT v.user_id, v.visit_id, v.arrival, p.name FROM fx_visit v JOIN fx_venue p ON v.place_id = p.venue_id"))
def visits_with_venues(spark, d):
    p = view(spark, d, "fx_venue").select(F.col("venue_id").alias("place_id"), "name")
    return view(spark, d, "fx_visit").join(p, "place_id").select("user_id", "visit_id", "arrival", "name")


@query("J2_totals_joined_back", oracle("SELECT v.day_no, v.place_id, count(*) AS today, t.visits, t.duration FROM fx_visit v JOIN (SELECT place_id, count(*) AS visits, sum(departure - arrival)::BIGINT AS duration FROM fx_visit GROUP BY place_id) t ON v.place_id = t.place_id GROUP BY v.day_no, v.place_id, t.visits, t.duration"))
def totals_joined_back(spark, d):
    """Totals come from the daily counts, so the visits are grouped once."""
    v = view(spark, d, "fx_visit")
    day = v.groupBy("place_id", "day_no").agg(F.count("*").alias("today"), F.sum(F.col("departure") - F.col("arrival")).alias("s"))
    total = day.groupBy("place_id").agg(F.sum("today").alias("visits"), F.sum("s").alias("duration"))
    return day.join(total, "place_id").select("day_no", "place_id", "today", "visits", "duration")


@query("J3_unnested_categories", oracle("SELECT v.venue_id, u.category_id, c.name FROM fx_venue v LEFT JOIN (SELECT venue_id, unnest(CASE WHEN nb_checkins < 100 THEN [] ELSE [leaf_category, extra_category, 'none'] END) AS category_id FROM fx_venue) u ON v.venue_id = u.venue_id LEFT JOIN fx_category c ON u.category_id = c.category_id"))
def unnested_categories(spark, d):
    """An empty array keeps its venue with a null category."""
    ids = F.when(F.col("nb_checkins") < 100, F.array().cast("array<string>")).otherwise(F.array("leaf_category", "extra_category", F.lit("none")))
    v = view(spark, d, "fx_venue").select("venue_id", F.explode_outer(ids).alias("category_id"))
    return v.join(view(spark, d, "fx_category").select("category_id", "name"), "category_id", "left").select("venue_id", "category_id", "name")


@query("J4_full_chain", oracle("WITH p AS (SELECT 'b' || (pi_id + 11) AS category_id, list_sort(list({'pi_id': pi_id, 'n': n})) AS pis FROM (SELECT pi_id, count(*) AS n FROM fx_score GROUP BY pi_id) GROUP BY 1) SELECT coalesce(c.category_id, p.category_id) AS category_id, c.name, pis, len(pis) AS n_pi FROM fx_category c FULL JOIN p ON c.category_id = p.category_id"))
def full_chain(spark, d):
    s = view(spark, d, "fx_score").groupBy("pi_id").agg(F.count("*").alias("n"))
    p = s.groupBy(F.concat(F.lit("b"), F.col("pi_id") + 11).alias("category_id")).agg(F.array_sort(F.collect_list(F.struct("pi_id", "n"))).alias("pis"))
    both = view(spark, d, "fx_category").select("category_id", "name").join(p, "category_id", "full")
    return both.select("category_id", "name", "pis", F.when(F.col("pis").isNotNull(), F.size("pis").cast("long")).alias("n_pi"))


@query("J5_parents", oracle("SELECT c.category_id, c.name, p.name AS parent FROM fx_category c JOIN fx_category p ON c.parent_id = p.category_id"))
def parents(spark, d):
    c = view(spark, d, "fx_category")
    p = c.select(F.col("category_id").alias("of"), F.col("name").alias("parent"))
    return c.join(p, F.col("parent_id") == F.col("of")).select("category_id", "name", "parent")


@query("J6_ancestor_paths", oracle("WITH t AS (SELECT category_id, [category_id] AS ids, [name] AS names FROM fx_category WHERE parent_id = '' UNION ALL SELECT c.category_id, list_append(ids, c.category_id), list_append(names, c.name) FROM fx_category c JOIN t ON c.parent_id = t.category_id) SELECT * FROM t").replace("WITH fx_category", "WITH RECURSIVE fx_category"))
def ancestor_paths(spark, d):
    return paths(view(spark, d, "fx_category"))


@query("J7_tips_of_categories", oracle("SELECT c AS category_id, count(*) AS tips, count(DISTINCT venue_id) AS venues FROM (SELECT t.tip_id, t.venue_id, unnest([v.leaf_category, v.extra_category]) AS c FROM fx_tip t JOIN fx_venue v ON t.venue_id = v.venue_id) GROUP BY c"))
def tips_of_categories(spark, d):
    v = view(spark, d, "fx_venue").select("venue_id", F.explode(F.array("leaf_category", "extra_category")).alias("category_id"))
    return view(spark, d, "fx_tip").select("tip_id", "venue_id").join(v, "venue_id").groupBy("category_id").agg(F.count("*").alias("tips"), F.count_distinct("venue_id").alias("venues"))


@query("J8_ids_to_rows", oracle("WITH a AS (SELECT venue_id, unnest([nb_checkins % 10, nb_checkins // 10 % 10]) AS pi_id FROM fx_venue) SELECT a.venue_id, a.pi_id::BIGINT AS pi_id, s.n FROM a JOIN (SELECT pi_id, count(*) AS n FROM fx_score GROUP BY pi_id) s ON a.pi_id = s.pi_id"))
def ids_to_rows(spark, d):
    n = F.col("nb_checkins")
    a = view(spark, d, "fx_venue").select("venue_id", F.explode(F.array((n % 10).cast("long"), F.floor(n / 10) % 10)).alias("pi_id"))
    return a.join(view(spark, d, "fx_score").groupBy("pi_id").agg(F.count("*").alias("n")), "pi_id").select("venue_id", "pi_id", "n")


@query("J9_tips_with_authors", oracle("SELECT t.tip_id, t.author_id, u.n AS author_tips FROM fx_tip t JOIN (SELECT author_id, count(*) AS n FROM fx_tip GROUP BY author_id) u ON t.author_id = u.author_id ORDER BY t.tip_id DESC"))
def tips_with_authors(spark, d):
    t = view(spark, d, "fx_tip").select("tip_id", "author_id")
    return t.join(t.groupBy("author_id").agg(F.count("*").alias("author_tips")), "author_id").select("tip_id", "author_id", "author_tips").orderBy(F.desc("tip_id"))


@query("J10_scores_with_names", oracle("SELECT s.venue_id, s.pi_id, s.model_type, s.feature_type, 'pi ' || s.pi_id AS name, s.score FROM fx_score s JOIN (SELECT DISTINCT pi_id FROM fx_tag) t ON s.pi_id = t.pi_id ORDER BY s.venue_id, s.score DESC, s.pi_id"))
def scores_with_names(spark, d):
    names = view(spark, d, "fx_tag").select(F.col("pi_id").cast("long").alias("pi_id")).distinct().withColumn("name", F.concat(F.lit("pi "), "pi_id"))
    s = view(spark, d, "fx_score").join(names, "pi_id").select("venue_id", "pi_id", "model_type", "feature_type", "name", "score")
    return s.orderBy("venue_id", F.desc("score"), "pi_id")


@query("J11_reviews", oracle("SELECT v.visit_id, r.pi_id, r.rating FROM fx_visit v JOIN fx_rating r ON v.user_id = r.session_id AND v.place_id = r.place_id WHERE v.deleted IS NOT TRUE"))
def reviews(spark, d):
    v = view(spark, d, "fx_visit").filter(r.not_true(F.col("deleted"))).select("visit_id", F.col("user_id").alias("session_id"), "place_id")
    return v.join(view(spark, d, "fx_rating"), ["session_id", "place_id"]).select("visit_id", "pi_id", "rating")


MERCATOR = "6378137.0 * radians({0}.lon) AS {1}x, 6378137.0 * ln(tan(pi() / 4 + radians({0}.lat) / 2)) AS {1}y"
PROBES = "SELECT user_id, day_no, min(ts_local) AS ts, min(lat) AS lat, min(lon) AS lon FROM fx_trace GROUP BY user_id, day_no, ts_local // 14400"
NEAR = f"WITH s AS ({PROBES}), p AS (SELECT s.*, {MERCATOR.format('s', 'p')} FROM s), q AS (SELECT venue_id, name, nb_checkins, {MERCATOR.format('v', 'm')} FROM fx_venue v), j AS (SELECT user_id, ts, venue_id, name, nb_checkins, sqrt(pow(mx - px, 2) + pow(my - py, 2)) AS distance FROM p JOIN q ON abs(mx - px) <= 250 AND abs(my - py) <= 250 WHERE sqrt(pow(mx - px, 2) + pow(my - py, 2)) <= 250)"


def probes(spark, d):
    """The south-western corner of each four hours of a user's trace."""
    t = view(spark, d, "fx_trace").groupBy("user_id", "day_no", F.floor(F.col("ts_local") / 14400).alias("part"))
    return spatial.projected(t.agg(F.min("ts_local").alias("ts"), F.min("lat").alias("lat"), F.min("lon").alias("lon"))).withColumnsRenamed({"mx": "px", "my": "py"}).select("user_id", "ts", "px", "py")


def nearest_of_places(probed, points, metres: float, by=()):
    """For each place of a probe (px, py) and ``by``, columns of the points: how many points (id, checkins, mx, my) are near, the nearest (x: distance, id), and the sum of their check-ins.

    Points are summed by where they are, so places meet places, however many rows lie there.
    """
    at = points.groupBy("mx", "my", *by).agg(F.count("*").alias("n"), F.min("id").alias("id"), F.sum("checkins").alias("checkins"))
    near = spatial.within(probed.select("px", "py").distinct(), at, metres)
    return near.groupBy("px", "py", *by).agg(F.sum("n").alias("n"), F.min(F.struct("distance", "id")).alias("x"), F.sum("checkins").alias("checkins"))


@query("J12_near_venues", oracle(f"{NEAR} SELECT user_id, ts, count(*) AS n, arg_min(venue_id, (distance, venue_id)) AS nearest, round(min(distance), 3) AS distance, sum(nb_checkins)::BIGINT AS checkins FROM j GROUP BY user_id, ts", "fx_trace", "fx_venue"))
def nearest(spark, d):
    p = cut(probes(spark, d), "probes")
    j = nearest_of_places(p, shared_points(spark, d, "venue"), 250.0)
    return p.join(j, ["px", "py"]).select("user_id", "ts", "n", F.col("x.id").alias("nearest"), F.round("x.distance", 3).alias("distance"), "checkins")


#: Places of users, venues and places of the knowledge base in reach of each probe; a user's places only for the user.
CANDIDATES = f"""s AS ({PROBES}), p AS (SELECT s.*, {MERCATOR.format('s', 'p')} FROM s),
c AS (SELECT 'place' AS kind, user_id AS owner, place_id AS id, v.name, nb_visits AS checkins, {MERCATOR.format('v', 'm')} FROM fx_place v
  UNION ALL SELECT 'venue', NULL, venue_id, v.name, nb_checkins, {MERCATOR.format('v', 'm')} FROM fx_venue v
  UNION ALL SELECT 'kb', NULL, venue_id, 'Venue ' || venue_id, 0, {MERCATOR.format('v', 'm')} FROM fx_venue v WHERE nb_checkins > 20 AND NOT (lat = 0 AND lon = 0)),
j AS (SELECT p.user_id, ts, kind, id, name, checkins, sqrt(pow(mx - px, 2) + pow(my - py, 2)) AS distance FROM p JOIN c ON abs(mx - px) <= 250 AND abs(my - py) <= 250 AND (owner IS NULL OR owner = p.user_id) WHERE sqrt(pow(mx - px, 2) + pow(my - py, 2)) <= 250)"""


def shared_points(spark, d, *kinds):
    """Venues and places of the knowledge base (kind, id, name, checkins, mx, my)."""
    v = view(spark, d, "fx_venue")
    of = {
        "venue": v.select(F.lit("venue").alias("kind"), F.col("venue_id").alias("id"), "name", F.col("nb_checkins").cast("long").alias("checkins"), "lat", "lon"),
        "kb": v.filter("nb_checkins > 20 and not (lat = 0 and lon = 0)").select(F.lit("kb").alias("kind"), F.col("venue_id").alias("id"), F.concat(F.lit("Venue "), "venue_id").alias("name"), F.lit(0).cast("long").alias("checkins"), "lat", "lon"),
    }
    found = of[kinds[0]] if len(kinds) == 1 else of["venue"].unionByName(of["kb"])
    return spatial.projected(found).drop("lat", "lon")


def own_candidates(spark, d, probed, metres: float = 250.0, named=()):
    """A user's places near the user's probes, by user and cell; ``named`` are expressions over the places that are worked out once for each."""
    own = view(spark, d, "fx_place").select("user_id", F.lit("place").alias("kind"), F.col("place_id").alias("id"), "name", F.col("nb_visits").alias("checkins"), "lat", "lon")
    return spatial.within(probed, spatial.projected(own).select("*", *named).drop("lat", "lon"), metres, ["user_id"], "points")


def candidates(spark, d, metres: float = 250.0):
    """All candidates of the probes, a row each: as many as probes times what lies near, so queries that only sum or rank them go by places instead. A user's places meet that user's probes only, all others meet by cell."""
    p = probes(spark, d)
    columns = ["user_id", "ts", "kind", "id", "name", "checkins", "distance"]
    shared = spatial.within(p, shared_points(spark, d, "venue", "kb"), metres)
    return shared.select(*columns).unionByName(own_candidates(spark, d, p, metres).select(*columns))


@query("J12_near_places", oracle(f"WITH {CANDIDATES} SELECT user_id, ts, CASE WHEN kind = 'place' AND checkins > 0 THEN 'visited' ELSE kind END AS kind, count(*) AS n, arg_min(id, (distance, id)) AS nearest, round(min(distance), 3) AS distance, sum(checkins)::BIGINT AS checkins FROM j GROUP BY 1, 2, 3", "fx_trace", "fx_venue", "fx_place"))
def near_places(spark, d):
    """The four kinds of candidates of a probe: own places, those with visits that count, venues, places of the knowledge base."""
    p = cut(probes(spark, d), "probes")
    kind = F.when(F.col("checkins") > 0, "visited").otherwise(F.col("kind"))
    own = own_candidates(spark, d, p).groupBy("user_id", "ts", kind.alias("kind")).agg(F.count("*").alias("n"), F.min(F.struct("distance", "id")).alias("x"), F.sum("checkins").alias("checkins"))
    shared = p.join(nearest_of_places(p, shared_points(spark, d, "venue", "kb"), 250.0, ["kind"]), ["px", "py"])
    j = shared.select(*own.columns).unionByName(own)
    return j.select("user_id", "ts", "kind", "n", F.col("x.id").alias("nearest"), F.round("x.distance", 3).alias("distance"), "checkins")


#: What each probe asks for.
ASKED = "CASE (user_id + ts // 14400) % 5 WHEN 0 THEN 'blue bolt' WHEN 1 THEN 'small ring' WHEN 2 THEN 'red widget' WHEN 3 THEN 'venue 7' ELSE 'blue anvil 7' END"


def asked():
    at = F.pmod(F.col("user_id") + F.floor(F.col("ts") / 14400), F.lit(5)).cast("int")
    return F.element_at(F.array(*[F.lit(x_) for x_ in ("blue bolt", "small ring", "red widget", "venue 7", "blue anvil 7")]), at + 1)


def of_name():
    return x.trigram_numbers(x.trigrams(F.col("name"))).alias("of_name")


def held():
    """The share of what is asked for that a name holds."""
    return F.round(x.containment(F.col("of_wanted"), F.col("of_name")), 6)


def asking(spark, d, wanted):
    """The probes with what they ask for (an expression over them), written as they are read several times."""
    return cut(probes(spark, d).withColumn("wanted", wanted), "probes")


def asked_of(p):
    """``p`` with the trigrams of what is asked for, made once for each row, as numbers."""
    return p.withColumn("of_wanted", x.trigram_numbers(x.trigrams(F.col("wanted"))))


def places_asked(p, points, metres: float = 250.0):
    """Different places of probes and what is asked there (px, py, wanted), with the places of points near (mx, my, distance)."""
    near = spatial.within(p.select("px", "py", "wanted").distinct(), points.select("mx", "my").distinct(), metres)
    return cut(near, "places-asked")


def scored(near, points):
    """Points with what is asked of their place, each question once a place, and the similarity of their names."""
    asked_there = asked_of(near.select("mx", "my", "wanted").distinct())
    return asked_there.join(points.withColumn("of_name", of_name()), ["mx", "my"]).withColumn("similarity", held()).drop("of_wanted", "of_name")


@query("J13_near_and_named", oracle(f"WITH {CANDIDATES}, a AS (SELECT *, {ASKED} AS asked FROM j), k AS (SELECT *, {TRIGRAMS.format('name')} AS a, {TRIGRAMS.format('asked')} AS b FROM a), z AS (SELECT *, round(len(list_intersect(a, b))::DOUBLE / len(b), 6) AS similarity FROM k) SELECT user_id, ts, kind, arg_min(id, (-similarity, distance, id)) AS id, max(similarity) AS similarity FROM z WHERE similarity >= 0.3 GROUP BY user_id, ts, kind", "fx_trace", "fx_venue", "fx_place"))
def near_and_named(spark, d, least: float = 0.3):
    """Of the candidates near a probe the one of each kind whose name best holds what the probe asks for; of equal ones the nearest.

    At one place the best is that of the greatest similarity and then the smallest id, for each question that probes
    ask there; probes of a place and question choose among the places near.
    """
    p = asking(spark, d, asked())
    points = shared_points(spark, d, "venue", "kb").groupBy("mx", "my", "kind", "name").agg(F.min("id").alias("id"))
    near = places_asked(p, points)
    at = scored(near, points).filter(F.col("similarity") >= least).groupBy("mx", "my", "wanted", "kind").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "id")).alias("y"))
    rank = lambda s, i: F.min(F.struct(s.alias("s"), F.col("distance"), i.alias("id"))).alias("x")
    shared = near.join(at, ["mx", "my", "wanted"]).groupBy("px", "py", "wanted", "kind").agg(rank(F.col("y.s"), F.col("y.id")))
    shared = p.join(shared, ["px", "py", "wanted"]).select("user_id", "ts", "kind", "x")
    own = own_candidates(spark, d, asked_of(p), named=[of_name()]).withColumn("similarity", held()).filter(F.col("similarity") >= least)
    best = shared.unionByName(own.groupBy("user_id", "ts", "kind").agg(rank(-F.col("similarity"), F.col("id"))))
    return best.select("user_id", "ts", "kind", "x.id", (-F.col("x.s")).alias("similarity"))


TYPED = f"SELECT *, {TRIGRAMS.format('name')} AS a, {TRIGRAMS.format('typed')} AS b FROM (SELECT *, left({ASKED}, 6) AS typed FROM j WHERE kind <> 'kb')"


@query("J14_autocomplete", oracle(f"WITH {CANDIDATES}, k AS ({TYPED}), z AS (SELECT *, round(len(list_intersect(a, b))::DOUBLE / len(b), 6) AS similarity FROM k), h AS (SELECT *, CASE kind WHEN 'place' THEN row_number() OVER (PARTITION BY user_id, ts, kind ORDER BY distance, id) ELSE row_number() OVER (PARTITION BY user_id, ts, kind ORDER BY similarity DESC, distance, checkins DESC, id) END AS n FROM z WHERE (starts_with(name, typed) OR similarity >= 0.6) AND (kind <> 'place' OR checkins > 0)), t AS (SELECT * FROM h WHERE n <= CASE kind WHEN 'place' THEN 5 ELSE 10 END) SELECT user_id, ts, kind, id, name, similarity, round(distance, 3) AS distance FROM t WHERE kind = 'place' OR NOT EXISTS (SELECT 1 FROM t o JOIN fx_place p ON p.user_id = o.user_id AND p.place_id = o.id WHERE o.kind = 'place' AND o.user_id = t.user_id AND o.ts = t.ts AND p.venue_id = t.id)", "fx_trace", "fx_venue", "fx_place"))
def autocomplete(spark, d):
    """A user's visited places near a probe that begin like or resemble what is typed, nearest first; then venues, most similar first, but for those among the places.

    The ten first venues of a probe are among the ten first of each place for what is typed, and are the same for all probes of one place that type the same.
    """
    p = asking(spark, d, F.substring(asked(), 1, 6))
    fits = F.startswith("name", F.col("wanted")) | (F.col("similarity") >= 0.6)
    own = own_candidates(spark, d, asked_of(p), named=[of_name()]).withColumn("similarity", held()).filter(fits & (F.col("checkins") > 0))
    places = r.top(own, ["user_id", "ts"], [F.col("distance"), F.col("id")], 5).select("user_id", "ts", "kind", "id", "name", "similarity", "distance")
    # of equal names at a place the ten first stand for all
    points = r.top(shared_points(spark, d, "venue"), ["mx", "my", "name"], [F.desc("checkins"), F.col("id")], 10)
    near = places_asked(p, points)
    at = r.top(scored(near, points).filter(fits), ["mx", "my", "wanted"], [F.desc("similarity"), F.desc("checkins"), F.col("id")], 10)
    venues = r.top(near.join(at, ["mx", "my", "wanted"]), ["px", "py", "wanted"], [F.desc("similarity"), F.col("distance"), F.desc("checkins"), F.col("id")], 10)
    venues = venues.groupBy("px", "py", "wanted").agg(F.collect_list(F.struct("kind", "id", "name", "similarity", "distance")).alias("found"))
    link = view(spark, d, "fx_place").select("user_id", F.col("place_id").alias("id"), "venue_id").filter("venue_id is not null")
    seen = places.join(link, ["user_id", "id"]).groupBy("user_id", "ts").agg(F.collect_set("venue_id").alias("seen"))
    rest = p.join(seen, ["user_id", "ts"], "left").join(venues, ["px", "py", "wanted"])
    rest = rest.select("user_id", "ts", F.inline(F.filter("found", lambda v: F.col("seen").isNull() | ~F.array_contains("seen", v["id"]))))
    return places.unionByName(rest).withColumn("distance", F.round("distance", 3))


BOXES = "SELECT extra_category AS polygon_id, min(lon) - 0.0051 AS x1, max(lon) + 0.0049 AS x2, min(lat) - 0.0051 AS y1, min(lat) + 0.0249 AS y2 FROM fx_venue GROUP BY extra_category"


def boxes(spark, d):
    """A rectangle for each inner category, as a closed ring."""
    b = view(spark, d, "fx_venue").groupBy(F.col("extra_category").alias("polygon_id")).agg((F.min("lon") - 0.0051).alias("x1"), (F.max("lon") + 0.0049).alias("x2"), (F.min("lat") - 0.0051).alias("y1"), (F.min("lat") + 0.0249).alias("y2"))
    p = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    return b.select("polygon_id", F.array(p("x1", "y1"), p("x2", "y1"), p("x2", "y2"), p("x1", "y2"), p("x1", "y1")).alias("ring"))


@query("J15_points_in_polygons", oracle(f"WITH b AS ({BOXES}), h AS (SELECT venue_id, polygon_id FROM fx_venue v JOIN b ON lon >= x1 AND lon < x2 AND lat >= y1 AND lat < y2) SELECT v.venue_id, list_sort(coalesce(list(h.polygon_id) FILTER (WHERE h.polygon_id IS NOT NULL), [])) AS polygons FROM fx_venue v LEFT JOIN h ON v.venue_id = h.venue_id GROUP BY v.venue_id"))
def points_in_polygons(spark, d):
    v = view(spark, d, "fx_venue")
    hits = spatial.containing(v.select("venue_id", F.col("lon").alias("x"), F.col("lat").alias("y")), boxes(spark, d), 0.02)
    by = hits.groupBy("venue_id").agg(F.array_sort(F.collect_list("polygon_id")).alias("polygons"))
    return v.select("venue_id").join(by, "venue_id", "left").select("venue_id", F.coalesce("polygons", F.array().cast("array<string>")).alias("polygons"))


PARTS = f"WITH b AS ({BOXES}), p AS (SELECT DISTINCT lat, lon FROM fx_venue), h AS (SELECT lat, lon, polygon_id, greatest(0, least(lon + 0.004, x2) - greatest(lon - 0.004, x1)) * greatest(0, least(lat + 0.004, y2) - greatest(lat - 0.004, y1)) / (0.008 * 0.008) AS ratio FROM p, b)"


@query("J16_buffers_in_polygons", oracle(f"{PARTS} SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, polygon_id, round(ratio, 6) AS ratio FROM h WHERE ratio > 0.01"))
def buffers_in_polygons(spark, d):
    p = view(spark, d, "fx_venue").select("lat", "lon").distinct().withColumns({"px": F.col("lon"), "py": F.col("lat")})
    return spatial.overlapping(p, boxes(spark, d), 0.004).select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "polygon_id", F.round("ratio", 6).alias("ratio"))


EDGES = "WITH b AS (SELECT polygon_id, 6378137.0 * radians(x1) AS x1, 6378137.0 * radians(x2) AS x2, 6378137.0 * ln(tan(pi() / 4 + radians(y1) / 2)) AS y1, 6378137.0 * ln(tan(pi() / 4 + radians(y2) / 2)) AS y2 FROM ({0})), p AS (SELECT lat, lon, 6378137.0 * radians(lon) AS px, 6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) AS py FROM (SELECT DISTINCT lat, lon FROM fx_venue)), n AS (SELECT lat, lon, polygon_id, sqrt(pow(greatest(x1 - px, 0, px - x2), 2) + pow(greatest(y1 - py, 0, py - y2), 2)) AS distance, sqrt(pow((x1 + x2) / 2 - px, 2) + pow((y1 + y2) / 2 - py, 2)) AS centre FROM p, b)"


@query("J17_nearest_polygon", oracle(EDGES.format(BOXES) + " SELECT lat, lon, arg_min(polygon_id, (round(centre, 3), polygon_id)) AS polygon_id, arg_min(round(distance, 3), (round(centre, 3), polygon_id)) AS distance, 'Street ' || arg_min(polygon_id, (round(centre, 3), polygon_id)) AS street, arg_min(substr(polygon_id, 2), (round(centre, 3), polygon_id)) AS number FROM n WHERE distance <= 800 GROUP BY lat, lon", "fx_venue"))
def nearest_polygon(spark, d, metres: float = 800.0):
    """Of the polygons within some metres that of the nearest centre, with street and number from its tags."""
    from mobtrace.functions import geo

    p = view(spark, d, "fx_venue").select("lat", "lon").distinct()
    p = spatial.projected(p).withColumns({"px": F.col("mx"), "py": F.col("my")}).drop("mx", "my")
    ring = F.transform("ring", lambda q: F.struct(geo.mercator_x(q["x"]).alias("x"), geo.mercator_y(q["y"]).alias("y")))
    b = boxes(spark, d).select("polygon_id", ring.alias("ring"))
    tags = F.concat(F.lit('"addr:street"=>"Street '), "polygon_id", F.lit('", "addr:housenumber"=>"'), F.substring("polygon_id", F.lit(2), F.lit(3)), F.lit('"'))
    near = spatial.overlapping(p, b.withColumn("tags", tags), metres, 0.0)
    edges = F.transform(F.sequence(F.lit(0), F.size("ring") - 2), lambda i: geo.segment_distance(F.col("px"), F.col("py"), F.get("ring", i)["x"], F.get("ring", i)["y"], F.get("ring", i + 1)["x"], F.get("ring", i + 1)["y"]))
    near = near.withColumn("distance", F.when(geo.inside(F.col("py"), F.col("px"), F.col("ring")), 0.0).otherwise(F.array_min(edges))).filter(F.col("distance") <= metres)
    corners = F.slice("ring", F.lit(1), F.size("ring") - 1)
    mean = lambda c: F.aggregate(corners, F.lit(0.0), lambda a, q: a + q[c]) / F.size(corners)
    near = near.withColumn("centre", F.round(geo.planar_distance(F.col("px"), F.col("py"), mean("x"), mean("y")), 3))
    best = near.groupBy("lat", "lon").agg(F.min(F.struct("centre", "polygon_id", "distance", "tags")).alias("x")).withColumn("t", x.parse_tags(F.col("x.tags")))
    return best.select("lat", "lon", "x.polygon_id", F.round("x.distance", 3).alias("distance"), F.element_at("t", "addr:street").alias("street"), F.element_at("t", "addr:housenumber").alias("number"))


LINKED = f"""WITH b AS ({BOXES}), n AS (SELECT extra_category AS polygon_id, min(name) AS own, max(name) AS house FROM fx_venue GROUP BY extra_category),
h AS (SELECT v.venue_id, v.name, b.polygon_id, n.own, n.house, greatest(0, least(lon + 0.004, x2) - greatest(lon - 0.004, x1)) * greatest(0, least(lat + 0.004, y2) - greatest(lat - 0.004, y1)) / (0.008 * 0.008) AS ratio FROM fx_venue v, b JOIN n ON b.polygon_id = n.polygon_id),
t AS (SELECT venue_id, polygon_id, {TRIGRAMS.format('name')} AS a, {TRIGRAMS.format('own')} AS o, {TRIGRAMS.format('house')} AS u FROM h WHERE ratio > 0.01),
s AS (SELECT venue_id, polygon_id, round(len(list_intersect(a, o))::DOUBLE / len(list_distinct(list_concat(a, o))), 6) AS s1, round(len(list_intersect(a, u))::DOUBLE / len(list_distinct(list_concat(a, u))), 6) AS s2 FROM t),
f AS (SELECT venue_id, arg_min(polygon_id, (-s1, polygon_id)) FILTER (WHERE s1 >= 0.45) AS p1, max(s1) FILTER (WHERE s1 >= 0.45) AS m1, arg_min(polygon_id, (-greatest(s1, s2), polygon_id)) FILTER (WHERE greatest(s1, s2) >= 0.45) AS p2, max(greatest(s1, s2)) FILTER (WHERE greatest(s1, s2) >= 0.45) AS m2 FROM s GROUP BY venue_id)
SELECT v.venue_id, coalesce(p1, p2) AS polygon_id, coalesce(m1, m2) AS similarity, CASE WHEN p1 IS NOT NULL THEN 'name' WHEN p2 IS NOT NULL THEN 'house name' ELSE 'failed' END AS state FROM fx_venue v LEFT JOIN f ON v.venue_id = f.venue_id"""


@query("J18_venues_linked_to_polygons", oracle(LINKED, "fx_venue"))
def venues_linked_to_polygons(spark, d, least: float = 0.45):
    """The polygon in reach whose name is most similar to a venue's, else the one by name or house name; below the threshold none. Both passes read the pairs once."""
    v = view(spark, d, "fx_venue")
    names = v.groupBy(F.col("extra_category").alias("polygon_id")).agg(F.min("name").alias("own"), F.max("name").alias("house"))
    near = spatial.overlapping(v.select("venue_id", "name", F.col("lon").alias("px"), F.col("lat").alias("py")), boxes(spark, d).join(names, "polygon_id"), 0.004)
    like = lambda c: F.round(x.similarity(x.trigrams(F.col("name")), x.trigrams(F.col(c))), 6)
    near = near.select("venue_id", "polygon_id", like("own").alias("s1"), like("house").alias("s2")).withColumn("s2", F.greatest("s1", "s2"))
    best = lambda s: F.min(F.when(F.col(s) >= least, F.struct((-F.col(s)).alias("s"), "polygon_id")))
    found = near.groupBy("venue_id").agg(best("s1").alias("a"), best("s2").alias("b"))
    out = v.select("venue_id").join(found, "venue_id", "left")
    state = F.when(F.col("a").isNotNull(), "name").when(F.col("b").isNotNull(), "house name").otherwise("failed")
    return out.select("venue_id", F.coalesce("a.polygon_id", "b.polygon_id").alias("polygon_id"), (-F.coalesce("a.s", "b.s")).alias("similarity"), state.alias("state"))


AREAS = "a AS (SELECT lat - 0.012 AS s, lat + 0.012 AS n, lon - 0.012 AS w, lon + 0.012 AS e FROM (SELECT DISTINCT lat, lon FROM fx_venue WHERE nb_checkins > 400))"


@query("J19_covered", oracle(f"WITH {AREAS} SELECT venue_id, EXISTS (SELECT 1 FROM a WHERE lat - 0.004 >= s AND lat + 0.004 <= n AND lon - 0.004 >= w AND lon + 0.004 <= e) AS covered FROM fx_venue"))
def covered(spark, d):
    """Whether the buffer of a venue lies in an area that was searched; areas go to the cells that they touch."""
    v = view(spark, d, "fx_venue")
    points = v.select("lat", "lon").distinct()
    known = within_areas(points, areas(v), 0.004).withColumn("covered", F.lit(True))
    return v.join(known, ["lat", "lon"], "left").select("venue_id", F.coalesce("covered", F.lit(False)).alias("covered"))


def areas(v):
    a = v.filter("nb_checkins > 400").select("lat", "lon").distinct()
    return a.select((F.col("lat") - 0.012).alias("s"), (F.col("lat") + 0.012).alias("n"), (F.col("lon") - 0.012).alias("w"), (F.col("lon") + 0.012).alias("e"))


def within_areas(points, areas, half: float, cell: float = 0.02):
    """The points (lat, lon) whose square of half a side lies in an area, each once."""
    cover = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    areas = areas.withColumn("cy", cover("s", "n")).withColumn("cx", cover("w", "e"))
    points = points.withColumn("cy", F.floor(F.col("lat") / cell)).withColumn("cx", F.floor(F.col("lon") / cell))
    inside = (F.col("lat") - half >= F.col("s")) & (F.col("lat") + half <= F.col("n")) & (F.col("lon") - half >= F.col("w")) & (F.col("lon") + half <= F.col("e"))
    return points.join(areas, ["cx", "cy"]).filter(inside).select("lat", "lon").distinct()


SAMPLED = "('0x' || substr(md5(venue_id || ':' || i || ':{}'), 1, 8))::BIGINT::DOUBLE / 4294967296"


@query("J19_covered_by_samples", oracle(f"WITH {AREAS}, u AS (SELECT venue_id, i, lat, lon, CASE WHEN i = 0 THEN 0 ELSE {SAMPLED.format(1)} END AS ra, {SAMPLED.format(2)} AS rb FROM fx_venue, range(11) n(i)), q AS (SELECT venue_id, round(lat + degrees(400 * sqrt(ra) * sin(2 * pi() * rb) / 6378137.0), 8) AS lat, round(lon + degrees(400 * sqrt(ra) * cos(2 * pi() * rb) / (6378137.0 * cos(radians(lat)))), 8) AS lon FROM u) SELECT venue_id, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM a WHERE lat >= s AND lat <= n AND lon >= w AND lon <= e)) AS n_inside FROM q GROUP BY venue_id", "fx_venue"))
def covered_by_samples(spark, d, radius: float = 400.0, samples: int = 10):
    """How many of a venue's centre and ten points drawn around it lie in searched areas; all of them: it is covered."""
    from mobtrace.operators.models import uniform

    v = view(spark, d, "fx_venue")
    q = v.select("venue_id", "lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(samples))).alias("i"))
    a, b = (uniform(F.col("venue_id"), F.col("i"), seed=s) for s in (1, 2))
    far, turn = radius * F.sqrt(F.when(F.col("i") == 0, 0.0).otherwise(a)), 2 * F.pi() * b
    lat = F.col("lat") + F.degrees(far * F.sin(turn) / 6378137.0)
    lon = F.col("lon") + F.degrees(far * F.cos(turn) / (6378137.0 * F.cos(F.radians("lat"))))
    q = q.select("venue_id", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))
    known = within_areas(q.select("lat", "lon").distinct(), areas(v), 0.0).withColumn("in", F.lit(1))
    return q.join(known, ["lat", "lon"], "left").groupBy("venue_id").agg(F.count("in").alias("n_inside"))


@query("J20_merged_candidates", oracle(f"WITH {CANDIDATES}, own AS (SELECT j.*, p.venue_id FROM j JOIN fx_place p ON p.user_id = j.user_id AND p.place_id = j.id WHERE kind = 'place') SELECT user_id, ts, 'user' AS origin, id, round(distance, 3) AS distance FROM own UNION ALL SELECT user_id, ts, 'venue', id, round(distance, 3) FROM j WHERE kind = 'venue' AND NOT EXISTS (SELECT 1 FROM own WHERE own.user_id = j.user_id AND own.ts = j.ts AND own.venue_id = j.id)", "fx_trace", "fx_venue", "fx_place"))
def merged_candidates(spark, d, packed: int = 1000):
    """A user's places near a probe first, then the venues that aren't among them.

    The result has a row for each probe and venue near it; what moves are probes with the places near, and ids of venues packed by place, ``packed`` an array.
    """
    p = cut(probes(spark, d), "probes")
    link = view(spark, d, "fx_place").select("user_id", F.col("place_id").alias("id"), "venue_id")
    own = own_candidates(spark, d, p).join(link, ["user_id", "id"])
    seen = own.groupBy("user_id", "ts").agg(F.collect_set("venue_id").alias("seen"))
    v = shared_points(spark, d, "venue").select("mx", "my", "id")
    size = v.groupBy("mx", "my").agg(F.ceil(F.count("*") / packed).alias("packs"))
    near = spatial.within(p.select("px", "py").distinct(), size, 250.0).select("px", "py", "mx", "my", "distance")
    lists = v.join(size, ["mx", "my"]).groupBy("mx", "my", F.pmod(F.xxhash64("id"), F.col("packs")).alias("pack")).agg(F.collect_list("id").alias("ids"))
    rest = p.join(seen, ["user_id", "ts"], "left").join(near, ["px", "py"]).join(lists, ["mx", "my"])
    left = F.filter("ids", lambda i: F.col("seen").isNull() | ~F.array_contains("seen", i))
    rest = rest.select("user_id", "ts", F.lit("venue").alias("origin"), F.explode(left).alias("id"), "distance")
    return own.select("user_id", "ts", F.lit("user").alias("origin"), "id", "distance").unionByName(rest).withColumn("distance", F.round("distance", 3))


@query("J21_closest_place", oracle(f"WITH {CANDIDATES}, f AS (SELECT user_id, ts, arg_min(id, (distance, id)) FILTER (WHERE kind = 'place' AND checkins > 0 AND distance <= 100) AS own, arg_min(id, (distance, id)) FILTER (WHERE kind = 'venue') AS venue FROM j GROUP BY user_id, ts) SELECT user_id, ts, coalesce(own, venue) AS id, CASE WHEN own IS NOT NULL THEN 'user' ELSE 'venue' END AS origin FROM f WHERE own IS NOT NULL OR venue IS NOT NULL", "fx_trace", "fx_venue", "fx_place"))
def closest_place(spark, d):
    """The nearest visited place of the user within 100 m, else the nearest venue within 250 m."""
    p = cut(probes(spark, d), "probes")
    own = own_candidates(spark, d, p).filter((F.col("checkins") > 0) & (F.col("distance") <= 100)).groupBy("user_id", "ts").agg(F.min(F.struct("distance", "id")).alias("own"))
    venue = nearest_of_places(p, shared_points(spark, d, "venue"), 250.0).select("px", "py", F.col("x").alias("venue"))
    j = p.join(own, ["user_id", "ts"], "left").join(venue, ["px", "py"], "left")
    j = j.select("user_id", "ts", F.coalesce("own.id", "venue.id").alias("id"), F.when(F.col("own").isNotNull(), "user").otherwise("venue").alias("origin"))
    return j.filter("id is not null")


OVERLAP = " + ".join(f"greatest(0, least(s.a + s.n + 3600, p.a + p.n + {k}) - greatest(s.a - 3600, p.a + {k}))" for k in (-86400, 0, 86400))


@query("J22_time_of_day_overlap", oracle(f"WITH v AS (SELECT visit_id, user_id, place_id, arrival, arrival % 86400 AS a, least(departure - arrival, 86400) AS n FROM fx_visit), c AS (SELECT * FROM (SELECT o.user_id, o.place_id, p.place_id AS near, row_number() OVER (PARTITION BY o.user_id, o.place_id ORDER BY round(2 * 6378137.0 * asin(sqrt(pow(sin(radians(p.lat - o.lat) / 2), 2) + cos(radians(o.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - o.lon) / 2), 2))), 3), p.place_id) AS k FROM fx_place o JOIN fx_place p ON o.user_id = p.user_id WHERE abs(p.lat - o.lat) < 0.015 AND abs(p.lon - o.lon) < 0.015) WHERE k <= 5) SELECT s.visit_id, p.place_id, sum({OVERLAP})::BIGINT AS overlap FROM v s JOIN c ON c.user_id = s.user_id AND c.place_id = s.place_id JOIN v p ON p.user_id = s.user_id AND p.place_id = c.near AND p.arrival < s.arrival GROUP BY s.visit_id, p.place_id HAVING sum({OVERLAP}) > 0", "fx_visit", "fx_place"))
def time_of_day_overlap(spark, d, most: int = 5, reach: float = 0.015, pad: int = 3600):
    """Seconds of day, padded by an hour, that a visit shares with the user's earlier visits at the five nearest places.

    Visits meet those of the candidate places only, on user and place, sorted by time; earlier
    ones are counts by second of the day, not rows to be paired. Midnight counts.
    """
    from mobtrace.functions import geo

    p = view(spark, d, "fx_place").select("user_id", "place_id", "lat", "lon")
    cell = lambda c: F.floor(F.col(c) / reach)
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    own = p.withColumn("dy", F.explode(near)).withColumn("dx", F.explode(near)).select("user_id", "place_id", "lat", "lon", (cell("lat") + F.col("dy")).alias("cy"), (cell("lon") + F.col("dx")).alias("cx"))
    other = p.select("user_id", F.col("place_id").alias("near"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), cell("lat").alias("cy"), cell("lon").alias("cx"))
    c = own.join(other, ["user_id", "cy", "cx"]).filter((F.abs(F.col("lat2") - F.col("lat")) < reach) & (F.abs(F.col("lon2") - F.col("lon")) < reach))
    c = c.withColumn("away", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3))
    c = r.top(c, ["user_id", "place_id"], [F.col("away"), F.col("near")], most).select("user_id", "place_id", "near")
    v = view(spark, d, "fx_visit").select("visit_id", "user_id", "place_id", "arrival", F.pmod("arrival", F.lit(86400)).alias("a"), F.least(F.col("departure") - F.col("arrival"), F.lit(86400)).alias("n"))
    s = v.select("visit_id", "user_id", "place_id", F.col("arrival").alias("at"), (F.col("a") - pad).alias("start"), (F.col("a") + F.col("n") + pad).alias("end")).join(c, ["user_id", "place_id"])
    before = v.select("user_id", F.col("place_id").alias("near"), F.col("arrival").alias("at"), F.col("a").alias("start"), (F.col("a") + F.col("n")).alias("end"))
    return overlaps.with_earlier(s, before, ["user_id", "near"], "visit_id", pad).groupBy("visit_id", F.col("near").alias("place_id")).agg(F.sum("overlap").alias("overlap")).filter("overlap > 0")


@query("J23_redirected", oracle("WITH m AS (SELECT venue_id, venue_id // 2 AS redirect FROM fx_venue WHERE nb_checkins <= 50) SELECT coalesce(redirect, c.venue_id) AS venue_id, count(*) AS n FROM fx_checkin c LEFT JOIN m ON c.venue_id = m.venue_id GROUP BY 1"))
def redirected(spark, d):
    m = view(spark, d, "fx_venue").filter("nb_checkins <= 50").select("venue_id", F.floor(F.col("venue_id") / 2).alias("redirect"))
    c = view(spark, d, "fx_checkin").groupBy("venue_id").agg(F.count("*").alias("n"))
    return c.join(m, "venue_id", "left").groupBy(F.coalesce("redirect", "venue_id").alias("venue_id")).agg(F.sum("n").alias("n"))


@query("J24_ratings_with_scores", oracle("SELECT r.place_id, r.pi_id, s.model_type, s.feature_type, count(*) AS n, round(avg(r.rating), 6) AS rating, round(max(s.score), 6) AS score FROM fx_rating r JOIN fx_score s ON r.place_id = s.venue_id AND r.pi_id = s.pi_id GROUP BY ALL"))
def ratings_with_scores(spark, d):
    """Ratings are averaged before they meet the scores."""
    mean = view(spark, d, "fx_rating").groupBy(F.col("place_id").alias("venue_id"), "pi_id").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("rating"))
    s = view(spark, d, "fx_score").withColumn("score", F.round("score", 6))
    return mean.join(s, ["venue_id", "pi_id"]).select(F.col("venue_id").alias("place_id"), "pi_id", "model_type", "feature_type", "n", "rating", "score")


@query("J25_linked_entities")
def linked_entities(spark, d, metres: float = 200.0, least: float = 0.6):
    """Interests of a venue and its parent: what their categories give, and the type of the place of the knowledge base that lies near and is named alike; similar names are one, with all their sources."""
    from mobtrace.operators import interests

    c = view(spark, d, "fx_category").select("category_id", F.col("name").alias("category"))
    v = spatial.projected(view(spark, d, "fx_venue")).select("venue_id", "name", "leaf_category", "extra_category", "mx", "my", F.floor(F.col("venue_id") / 2).alias("parent_id"))
    parent = v.select(F.col("venue_id").alias("parent_id"), *[F.col(x_).alias(f"up_{x_}") for x_ in ("name", "leaf_category", "mx", "my")])
    own = v.select("venue_id", F.lit("own").alias("of"), "name", "leaf_category", F.col("mx").alias("px"), F.col("my").alias("py"))
    up = v.join(parent, "parent_id").select("venue_id", F.lit("parent").alias("of"), F.col("up_name").alias("name"), F.col("up_leaf_category").alias("leaf_category"), F.col("up_mx").alias("px"), F.col("up_my").alias("py"))
    both = own.unionByName(up)
    kb = v.filter("venue_id % 2 = 0").join(c, F.col("extra_category") == F.col("category_id")).select(F.col("venue_id").alias("kb_id"), F.concat("name", F.lit(" hall")).alias("kb_name"), F.lower("category").alias("type"), "mx", "my")
    # different names at different places meet; of equal names of the knowledge base at a place the first stands for all
    kb = kb.groupBy("mx", "my", "kb_name").agg(F.min(F.struct("kb_id", "type")).alias("k"))
    kb = kb.withColumn("of_kb", x.trigram_numbers(x.trigrams(F.col("kb_name"))))
    asked = both.select("name", "px", "py").distinct().withColumn("of_name", of_name())
    near = spatial.within(asked, kb, metres).withColumn("s", F.round(x.containment(F.col("of_name"), F.col("of_kb")), 6)).filter(F.col("s") >= least)
    linked = near.groupBy("px", "py", "name").agg(F.min(F.struct((-F.col("s")).alias("s"), "distance", "k")).alias("x")).select("px", "py", "name", F.col("x.k.type").alias("type"))
    found = both.join(linked, ["px", "py", "name"]).select("venue_id", F.concat("of", F.lit(" kb")).alias("source"), F.col("type").alias("name"))
    named = both.join(c, F.col("leaf_category") == F.col("category_id")).select("venue_id", F.concat("of", F.lit(" category")).alias("source"), F.lower("category").alias("name"))
    every = found.unionByName(named).groupBy("venue_id", "name").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    # the order in which a place's sources are asked
    asked_in = F.array(*[F.lit(s) for s in ("own kb", "own category", "parent category", "parent kb")])
    first = F.array_min(F.transform("sources", lambda s: F.array_position(asked_in, s)))
    return interests.merged_sources(every, ["venue_id"], "name", "sources", first)


INSTANTS = "SELECT event_id, user_id % 50 AS user_id, 788918400 + (event_id * 7919 % 2400) * 86400 + event_id % 86400 AS t FROM events"


@query("J26_nearest_in_time", oracle(f"WITH q AS ({INSTANTS}), v AS (SELECT user_id, arrival, min(visit_id) AS visit_id FROM fx_visit GROUP BY user_id, arrival), w AS (SELECT v.*, f.utc_offset, f.place_id FROM v JOIN fx_visit f ON v.visit_id = f.visit_id) SELECT event_id, arg_min(utc_offset, (abs(arrival - q.t), arrival)) AS offset_then, arg_max(place_id, arrival) FILTER (WHERE arrival <= q.t) AS latest_place FROM q JOIN w ON q.user_id = w.user_id GROUP BY event_id", "fx_visit"))
def nearest_in_time(spark, d):
    """For each asked instant the offset of the user's nearest visit and the place of the latest one; no pairs are made."""
    at = F.lit(788918400) + F.pmod(F.col("event_id") * 7919, F.lit(2400)) * 86400 + F.pmod("event_id", F.lit(86400))
    q = table(spark, d, "events").select("event_id", F.pmod("user_id", F.lit(50)).alias("user_id"), at.alias("t"))
    v = view(spark, d, "fx_visit").groupBy("user_id", F.col("arrival").alias("t")).agg(F.min_by(F.struct(F.col("utc_offset").cast("long").alias("utc_offset"), "place_id"), "visit_id").alias("x")).select("user_id", "t", "x.*")
    near = r.around(q, v, "user_id", "t").filter("before is not null or after is not null")
    return near.select("event_id", F.when(r.earlier_is_nearer(F.col("t")), F.col("before.utc_offset")).otherwise(F.col("after.utc_offset")).alias("offset_then"), F.col("before.place_id").alias("latest_place"))
