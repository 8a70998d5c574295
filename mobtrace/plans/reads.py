"""Filters, keyed reads, set operations and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mobtrace.fixtures import oracle, table, view
from mobtrace.operators import rows as r
from mobtrace.functions import scalars as x
from mobtrace.plans.registry import query
from mobtrace.plans.scalars import FROM_CENTRE, TRIGRAMS, from_centre


@query("F1_points_of_day", oracle("SELECT user_id, ts_local, ts_utc, lat, lon, nb_steps FROM fx_trace WHERE day_no = 1 ORDER BY user_id, ts_local"))
def points_of_day(spark, d):
    return view(spark, d, "fx_trace").filter("day_no = 1").select("user_id", "ts_local", "ts_utc", "lat", "lon", "nb_steps").orderBy("user_id", "ts_local")


@query("F2_trace_between", oracle("SELECT user_id, ts_local, ts_utc FROM fx_trace WHERE ts_local BETWEEN 1704070800 AND 1704085200 OR ts_utc BETWEEN 1704153600 AND 1704157200"))
def trace_between(spark, d):
    t = view(spark, d, "fx_trace")
    return t.filter(F.col("ts_local").between(1704070800, 1704085200) | F.col("ts_utc").between(1704153600, 1704157200)).select("user_id", "ts_local", "ts_utc")


@query("F3_box_by_popularity", oracle("SELECT venue_id, nb_checkins FROM fx_venue WHERE lat BETWEEN 51.5 AND 51.56 AND lon BETWEEN -0.1 AND 0.0 ORDER BY nb_checkins DESC, venue_id LIMIT 20"))
def box_by_popularity(spark, d):
    return view(spark, d, "fx_venue").filter(F.col("lat").between(51.5, 51.56) & F.col("lon").between(-0.1, 0.0)).select("venue_id", "nb_checkins").orderBy(F.desc("nb_checkins"), "venue_id").limit(20)


@query("F4_deleted_two_ways", oracle("SELECT place_id, count(*) AS n, count(*) FILTER (WHERE deleted IS NOT TRUE) AS not_true, count(*) FILTER (WHERE deleted <> TRUE) AS surely_not FROM fx_visit GROUP BY place_id"))
def deleted_two_ways(spark, d):
    v = view(spark, d, "fx_visit")
    return v.groupBy("place_id").agg(F.count("*").alias("n"), F.count_if(r.not_true(F.col("deleted"))).alias("not_true"), F.count_if(r.surely_false(F.col("deleted"))).alias("surely_not"))


@query("F5_visits_by_day", oracle("SELECT user_id, day_no, visit_id, place_id, arrival, departure, arrival - utc_offset AS local_arrival FROM fx_visit WHERE deleted IS NOT TRUE"))
def visits_by_day(spark, d):
    v = view(spark, d, "fx_visit").filter(r.not_true(F.col("deleted")))
    return v.select("user_id", "day_no", "visit_id", "place_id", "arrival", "departure", (F.col("arrival") - F.col("utc_offset")).alias("local_arrival"))


@query("F5_visits_at_place", oracle("SELECT place_id, visit_id, arrival, departure FROM fx_visit ORDER BY place_id, arrival, visit_id"))
def visits_at_place(spark, d):
    return view(spark, d, "fx_visit").select("place_id", "visit_id", "arrival", "departure").orderBy("place_id", "arrival", "visit_id")


@query("F5_messages", oracle("SELECT user_id, ts, sender, message FROM fx_chat"))
def messages(spark, d):
    return view(spark, d, "fx_chat").select("user_id", "ts", "sender", "message")


@query("F5_moves_of_days", oracle("SELECT user_id, day_no, from_place, to_place, left_at, arrived_at FROM (SELECT user_id, day_no, lag(place_id) OVER w AS from_place, place_id AS to_place, lag(departure) OVER w AS left_at, arrival AS arrived_at FROM fx_visit WINDOW w AS (PARTITION BY user_id, day_no ORDER BY arrival, visit_id)) WHERE left_at IS NOT NULL AND user_id BETWEEN 3 AND 9 ORDER BY user_id, arrived_at"))
def moves_of_days(spark, d):
    from mobtrace.operators.stays import moves

    return moves(view(spark, d, "fx_visit").filter(F.col("user_id").between(3, 9))).orderBy("user_id", "arrived_at")


@query("F5_reviews_and_interests", oracle("SELECT session_id AS user_id, place_id, pi_id, rating, CASE WHEN rating >= 4 THEN 'kept' ELSE 'open' END AS state FROM fx_rating WHERE session_id % 10 = 3 ORDER BY user_id, place_id, pi_id"))
def reviews_and_interests(spark, d):
    """Interests of some users by place, with their reviews."""
    r_ = view(spark, d, "fx_rating").filter(F.col("session_id") % 10 == 3)
    return r_.select(F.col("session_id").alias("user_id"), "place_id", "pi_id", "rating", F.when(F.col("rating") >= 4, "kept").otherwise("open").alias("state")).orderBy("user_id", "place_id", "pi_id")


@query("F5_by_ids", oracle("SELECT v.visit_id, v.user_id, p.place_id, p.name FROM fx_visit v JOIN fx_place p ON v.user_id = p.user_id AND v.place_id = p.place_id WHERE v.visit_id IN (SELECT event_id FROM events WHERE event_type = 'click')"))
def by_ids(spark, d):
    """Visits and their places for a table of asked ids."""
    asked = table(spark, d, "events").filter("event_type = 'click'").select(F.col("event_id").alias("visit_id"))
    v = view(spark, d, "fx_visit").select("visit_id", "user_id", "place_id").join(asked, "visit_id", "left_semi")
    return v.join(view(spark, d, "fx_place").select("user_id", "place_id", "name"), ["user_id", "place_id"]).select("visit_id", "user_id", "place_id", "name")


@query("F6_name_lookup", oracle("SELECT v.venue_id, v.name FROM fx_venue v WHERE lower(v.name) IN (SELECT lower(name) FROM fx_venue WHERE nb_checkins = 500)"))
def name_lookup(spark, d):
    v = view(spark, d, "fx_venue")
    asked = v.filter("nb_checkins = 500").select(F.lower("name").alias("asked")).distinct()
    return v.join(asked, F.lower("name") == F.col("asked"), "left_semi").select("venue_id", "name")


@query("F7_known_and_scored", oracle("SELECT v.venue_id, EXISTS (SELECT 1 FROM fx_score s WHERE s.venue_id = v.venue_id) AS scored, EXISTS (SELECT 1 FROM fx_checkin c WHERE c.venue_id = v.venue_id) AS checked_in FROM fx_venue v"))
def known_and_scored(spark, d):
    v = view(spark, d, "fx_venue").select("venue_id")
    v = r.flag(v, view(spark, d, "fx_score"), "venue_id", "scored")
    return r.flag(v, view(spark, d, "fx_checkin"), "venue_id", "checked_in")


@query("F8_denied_venues", oracle("SELECT c.* FROM fx_checkin c WHERE c.venue_id NOT IN (SELECT venue_id FROM fx_venue WHERE nb_checkins >= 450)"))
def denied_venues(spark, d):
    denied = view(spark, d, "fx_venue").filter("nb_checkins >= 450").select("venue_id")
    return view(spark, d, "fx_checkin").join(denied, "venue_id", "left_anti").select("user_id", "venue_id", "ts")


@query("F9_users_with_key", "SELECT c_custkey, c_mktsegment AS push_id FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> ''")
def users_with_key(spark, d):
    return table(spark, d, "customer").filter(F.col("c_mktsegment").isNotNull() & (F.col("c_mktsegment") != "")).select("c_custkey", F.col("c_mktsegment").alias("push_id"))


@query("F10_tags_of_categories", oracle("SELECT t.word_id, t.pi_id FROM fx_tag t WHERE t.pi_id IN (0, 1, 2, 3, 4, 5) AND t.word_id IN (SELECT vec_id FROM embeddings)"))
def tags_of_categories(spark, d):
    words = table(spark, d, "embeddings").select(F.col("vec_id").alias("word_id"))
    return view(spark, d, "fx_tag").filter(F.col("pi_id").isin(*range(6))).join(words, "word_id", "left_semi").select("word_id", "pi_id")


@query("F11_usable_places", oracle("SELECT v.venue_id, lat, lon, list_sort(list(s.pi_id) FILTER (WHERE s.pi_id IS NOT NULL)) AS interests FROM fx_venue v LEFT JOIN (SELECT DISTINCT venue_id, pi_id FROM fx_score WHERE NOT coalesce(score < 5, false)) s ON v.venue_id = s.venue_id WHERE NOT (lat = 0 AND lon = 0) AND abs(lat) < 90 AND lon <> 0 GROUP BY v.venue_id, lat, lon"))
def usable_places(spark, d):
    """Places off the null island and the poles, with those of their interests that aren't discarded."""
    v = view(spark, d, "fx_venue").filter("not (lat = 0 and lon = 0) and abs(lat) < 90 and lon <> 0").select("venue_id", "lat", "lon")
    kept = view(spark, d, "fx_score").filter("not coalesce(score < 5, false)").groupBy("venue_id").agg(F.array_sort(F.collect_set("pi_id")).alias("interests"))
    return v.join(kept, "venue_id", "left").select("venue_id", "lat", "lon", "interests")


@query("F13_icon_fallback", oracle("SELECT c.category_id, c.name, CASE WHEN c.parent_id <> '' THEN c.parent_id ELSE c.category_id END AS icon FROM fx_category c ORDER BY icon, c.name"))
def icon_fallback(spark, d):
    c = view(spark, d, "fx_category")
    return c.select("category_id", "name", F.when(F.col("parent_id") != "", F.col("parent_id")).otherwise(F.col("category_id")).alias("icon")).orderBy("icon", "name")


@query("F14_listing", oracle("SELECT user_id, count(DISTINCT place_id) AS places, min(arrival) AS joined FROM fx_visit GROUP BY user_id"))
def listing(spark, d):
    return view(spark, d, "fx_visit").groupBy("user_id").agg(F.count_distinct("place_id").alias("places"), F.min("arrival").alias("joined"))


@query("F14_whole_tables", oracle("SELECT 'place' AS kind, user_id || ':' || place_id AS id, name FROM fx_place UNION ALL SELECT 'category', category_id, name FROM fx_category UNION ALL SELECT 'venue', venue_id || '', name FROM fx_venue UNION ALL SELECT DISTINCT 'interest', pi_id || '', 'pi ' || pi_id FROM fx_score"))
def whole_tables(spark, d):
    """Listings of places, categories, venues and the catalogue of interests."""
    id_ = lambda *c: F.concat_ws(":", *c)
    places = view(spark, d, "fx_place").select(F.lit("place").alias("kind"), id_("user_id", "place_id").alias("id"), "name")
    categories = view(spark, d, "fx_category").select(F.lit("category").alias("kind"), F.col("category_id").alias("id"), "name")
    venues = view(spark, d, "fx_venue").select(F.lit("venue").alias("kind"), id_("venue_id").alias("id"), "name")
    interests = view(spark, d, "fx_score").select("pi_id").distinct().select(F.lit("interest").alias("kind"), id_("pi_id").alias("id"), F.concat(F.lit("pi "), "pi_id").alias("name"))
    return places.unionByName(categories).unionByName(venues).unionByName(interests)


@query("T1_popular_near", oracle(f"SELECT leaf_category, venue_id, nb_checkins FROM (SELECT *, row_number() OVER (PARTITION BY leaf_category ORDER BY nb_checkins DESC, round({FROM_CENTRE}, 3), venue_id) AS n FROM fx_venue) WHERE n <= 5"))
def popular_near(spark, d):
    v = view(spark, d, "fx_venue")
    return r.top(v, ["leaf_category"], [F.desc("nb_checkins"), F.round(from_centre(), 3), F.col("venue_id")], 5).select("leaf_category", "venue_id", "nb_checkins")


@query("T2_by_similarity", oracle(f"WITH s AS (SELECT venue_id, nb_checkins, round({FROM_CENTRE}, 3) AS distance, {TRIGRAMS.format('name')} AS a, {TRIGRAMS.format(chr(39) + 'small bolts' + chr(39))} AS b FROM fx_venue), t AS (SELECT *, round(len(list_intersect(a, b))::DOUBLE / len(b), 6) AS similarity FROM s) SELECT venue_id, similarity, distance FROM t ORDER BY similarity DESC, distance, nb_checkins DESC, venue_id LIMIT 15"))
def by_similarity(spark, d, asked: str = "small bolts", n: int = 15):
    """The venues whose names hold most of what is asked, nearest first, then by popularity."""
    similarity = F.round(x.containment(x.trigrams(F.lit(asked)), x.trigrams(F.col("name"))), 6)
    v = view(spark, d, "fx_venue").select("venue_id", "nb_checkins", similarity.alias("similarity"), F.round(from_centre(), 3).alias("distance"))
    return v.orderBy(F.desc("similarity"), "distance", F.desc("nb_checkins"), "venue_id").limit(n).select("venue_id", "similarity", "distance")


@query("T3_top_scores", oracle("SELECT venue_id, pi_id, model_type, feature_type, score FROM (SELECT *, row_number() OVER (PARTITION BY venue_id, model_type, feature_type ORDER BY score DESC, pi_id) AS n FROM fx_score) WHERE n <= 3"))
def top_scores(spark, d):
    s = view(spark, d, "fx_score")
    return r.top(s, ["venue_id", "model_type", "feature_type"], [F.desc("score"), F.col("pi_id")], 3).select("venue_id", "pi_id", "model_type", "feature_type", "score")


@query("T4_most_common", oracle("SELECT venue_id, count(*) AS n FROM fx_checkin GROUP BY venue_id ORDER BY n DESC, venue_id LIMIT 30"))
def most_common(spark, d):
    return view(spark, d, "fx_checkin").groupBy("venue_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "venue_id").limit(30)


@query("W11_ranked", oracle("SELECT venue_id, pi_id, model_type, feature_type, row_number() OVER (PARTITION BY venue_id, model_type, feature_type ORDER BY score DESC, pi_id) - 1 AS rank FROM fx_score"))
def ranked(spark, d):
    w = Window.partitionBy("venue_id", "model_type", "feature_type").orderBy(F.desc("score"), "pi_id")
    return view(spark, d, "fx_score").select("venue_id", "pi_id", "model_type", "feature_type", (F.row_number().over(w) - 1).cast("long").alias("rank"))


@query("W12_first_of_group", oracle("SELECT user_id, min_by(venue_id, (ts, venue_id)) AS venue_id, min(ts) AS ts FROM fx_checkin GROUP BY user_id"))
def first_of_group(spark, d):
    """The least of a struct needs no sort of a user's rows."""
    return view(spark, d, "fx_checkin").groupBy("user_id").agg(F.min(F.struct("ts", "venue_id")).alias("x")).select("user_id", "x.venue_id", "x.ts")


@query("U1_union", oracle("SELECT venue_id, 'leaf' AS kind, leaf_category AS category_id FROM fx_venue UNION ALL SELECT venue_id, 'extra', extra_category FROM fx_venue"))
def union(spark, d):
    v = view(spark, d, "fx_venue")
    leaf, extra = (v.select("venue_id", F.lit(k).alias("kind"), F.col(f"{k}_category").alias("category_id")) for k in ("leaf", "extra"))
    return leaf.unionByName(extra)


@query("U2_united_ids", oracle("SELECT session_id AS user_id, pi_id, list_sort(list(DISTINCT place_id)) AS places FROM fx_rating GROUP BY session_id, pi_id"))
def united_ids(spark, d):
    """The places of each interest of a user, as one array; a user has a bounded number of places."""
    return view(spark, d, "fx_rating").groupBy(F.col("session_id").alias("user_id"), "pi_id").agg(F.array_sort(F.collect_set("place_id")).alias("places"))


@query("U3_differences", oracle("SELECT venue_id, list_filter([leaf_category, extra_category], lambda c: c <> 'n3') AS categories FROM fx_venue WHERE venue_id NOT IN (SELECT venue_id FROM fx_score)"))
def differences(spark, d):
    seen = view(spark, d, "fx_score").select("venue_id")
    v = view(spark, d, "fx_venue").join(seen, "venue_id", "left_anti")
    return v.select("venue_id", F.array_remove(F.array("leaf_category", "extra_category"), "n3").alias("categories"))


@query("U4_shared_words", "SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda w: list_contains(string_split(lower(p_type), ' '), w)))) AS shared, len(list_distinct(string_split(p_name, ' '))) AS n FROM part")
def shared_words(spark, d):
    words = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.array_intersect(words, F.split(F.lower("p_type"), " "))).alias("shared"), F.size(F.array_distinct(words)).cast("long").alias("n"))


@query("U5_added_ids", oracle("SELECT venue_id, CASE WHEN leaf_category = 'b11' OR extra_category = 'b11' THEN [leaf_category, extra_category] ELSE [leaf_category, extra_category, 'b11'] END AS categories FROM fx_venue"))
def added_ids(spark, d):
    return view(spark, d, "fx_venue").select("venue_id", F.array_union(F.array("leaf_category", "extra_category"), F.array(F.lit("b11"))).alias("categories"))
