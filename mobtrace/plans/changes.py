"""Edits and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from mobtrace.fixtures import oracle, table, view
from mobtrace.operators import changes as c
from mobtrace.plans.registry import query

NEW = "SELECT user_id, arrival, max(departure) + 600 AS departure, min(place_id) AS place_id FROM fx_visit GROUP BY user_id, arrival HAVING max(departure) - arrival > 7200 UNION ALL SELECT user_id, max(arrival) + 1, max(departure), 0 FROM fx_visit GROUP BY user_id"
OLD = "SELECT user_id, arrival, max(departure) AS departure, min(place_id) AS place_id FROM fx_visit GROUP BY user_id, arrival"


def old_and_new(spark, d):
    v = view(spark, d, "fx_visit")
    old = v.groupBy("user_id", "arrival").agg(F.max("departure").alias("departure"), F.min("place_id").alias("place_id"))
    more = v.groupBy("user_id").agg((F.max("arrival") + 1).alias("arrival"), F.max("departure").alias("departure"), F.lit(0).cast("long").alias("place_id"))
    return old, old.filter("departure - arrival > 7200").withColumn("departure", F.col("departure") + 600).unionByName(more)


@query("E1_upserted_visits", oracle(f"WITH o AS ({OLD}), n AS ({NEW}) SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.arrival, n.arrival) AS arrival, greatest(o.departure, n.departure) AS departure, coalesce(o.place_id, n.place_id) AS place_id FROM o FULL JOIN n ON o.user_id = n.user_id AND o.arrival = n.arrival"))
def upserted_visits(spark, d):
    old, new = old_and_new(spark, d)
    return c.upsert(old, new, ["user_id", "arrival"], {"departure": "greatest", "place_id": "old"})


@query("E2_partial_update", oracle("SELECT visit_id, CASE WHEN visited THEN 0 ELSE place_id END AS place_id, CASE WHEN visited AND deleted THEN departure + 60 ELSE departure END AS departure FROM fx_visit"))
def partial_update(spark, d):
    """Null in an edit keeps what is there."""
    v = view(spark, d, "fx_visit").select("visit_id", "place_id", "departure", "visited", "deleted")
    edits = v.filter("visited").select("visit_id", F.lit(0).cast("long").alias("place_id"), F.when(F.col("deleted"), F.col("departure") + 60).alias("departure"))
    return c.partial_update(v.select("visit_id", "place_id", "departure"), edits, "visit_id")


INSTANTS = "788918400 + (event_id * 7919 % 2400) * 86400 + event_id % 86400"
NEAREST = "SELECT id, arg_min(utc_offset, (abs(arrival - q.t), arrival)) AS off FROM q JOIN (SELECT user_id, arrival, arg_min(utc_offset, visit_id) AS utc_offset FROM fx_visit GROUP BY user_id, arrival) w ON q.user_id = w.user_id GROUP BY id"


@query("E3_added_visits", oracle(f"WITH q AS (SELECT event_id AS id, user_id % 50 AS user_id, {INSTANTS} AS t, CASE WHEN event_id % 3 = 1 THEN event_id % 100 + 1 END AS new_venue, CASE WHEN event_id % 3 = 2 THEN event_id % 97 END AS new_place, 'custom ' || event_id AS name FROM events), o AS ({NEAREST}), r AS (SELECT q.*, o.off, p.place_id AS of_venue, CASE WHEN new_venue IS NOT NULL THEN coalesce(p.place_id, 2000000000 + new_venue) WHEN new_place IS NOT NULL THEN new_place ELSE 1000000000 + q.id END AS place_id FROM q JOIN o ON q.id = o.id LEFT JOIN fx_place p ON p.user_id = q.user_id AND p.venue_id = q.new_venue), a AS (SELECT user_id, t AS arrival, max(t + 3600) AS departure, arg_max(place_id, id) AS place_id, arg_max(off, id) AS utc_offset FROM r GROUP BY user_id, t), v AS (SELECT user_id, arrival, max(departure) AS departure, arg_min(place_id, visit_id) AS place_id, arg_min(utc_offset, visit_id) AS utc_offset FROM fx_visit GROUP BY user_id, arrival) SELECT 'visit' AS kind, coalesce(v.user_id, a.user_id) AS user_id, coalesce(v.arrival, a.arrival) AS at, coalesce(v.place_id, a.place_id) AS place_id, coalesce(v.utc_offset, a.utc_offset)::BIGINT AS utc_offset, greatest(v.departure, a.departure)::VARCHAR AS detail FROM v FULL JOIN a ON v.user_id = a.user_id AND v.arrival = a.arrival UNION ALL SELECT DISTINCT 'place', user_id, NULL, place_id, NULL, CASE WHEN new_venue IS NOT NULL THEN 'venue ' || new_venue ELSE name END FROM r WHERE (new_venue IS NOT NULL AND of_venue IS NULL) OR (new_venue IS NULL AND new_place IS NULL)", "fx_visit", "fx_place"))
def added_visits(spark, d):
    """Visits after users added some, at a new place, a venue or a known place, with the offset of their nearest visit; and the places that this adds."""
    e = table(spark, d, "events")
    t = F.lit(788918400) + F.pmod(F.col("event_id") * 7919, F.lit(2400)) * 86400 + F.pmod("event_id", F.lit(86400))
    third = F.col("event_id") % 3
    edits = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("user_id"), t.alias("t"), F.when(third == 1, F.col("event_id") % 100 + 1).alias("new_venue"), F.when(third == 2, F.col("event_id") % 97).alias("new_place"), F.concat(F.lit("custom "), "event_id").alias("name"), F.lit(None).cast("long").alias("old_place"))
    v, places = view(spark, d, "fx_visit"), view(spark, d, "fx_place")
    routed, after = c.routed_places(c.offsets_at(edits, v), places)
    new = c.latest(routed.select("user_id", F.col("t").alias("arrival"), (F.col("t") + 3600).alias("departure"), "place_id", F.col("offset").alias("utc_offset"), "id"), ["user_id", "arrival"], ["id"]).drop("id")
    first = v.groupBy("user_id", "arrival").agg(F.max("departure").alias("departure"), F.min_by(F.struct("place_id", "utc_offset"), "visit_id").alias("x"))
    old = first.select("user_id", "arrival", "departure", "x.place_id", F.col("x.utc_offset").cast("long").alias("utc_offset"))
    visits = c.upsert(old, new, ["user_id", "arrival"], {"departure": "greatest"})
    rows = visits.select(F.lit("visit").alias("kind"), "user_id", F.col("arrival").alias("at"), "place_id", "utc_offset", F.col("departure").cast("string").alias("detail"))
    added = after.join(places.select("user_id", "place_id"), ["user_id", "place_id"], "left_anti")
    none = F.lit(None).cast("long")
    return rows.unionByName(added.select(F.lit("place").alias("kind"), "user_id", none.alias("at"), "place_id", none.alias("utc_offset"), F.col("name").alias("detail")))


@query("E4_edited_visits", oracle("WITH e AS (SELECT v.visit_id AS id, v.user_id, v.place_id AS old_place, p.venue_id AS old_venue, CASE WHEN v.visit_id % 6 = 0 THEN p.name ELSE 'edited ' || v.visit_id END AS name, p.name AS old_name, CASE WHEN v.visit_id % 6 IN (2, 3) THEN v.visit_id % 100 + 1 END AS new_venue, CASE WHEN v.visit_id % 6 = 4 THEN v.visit_id % 97 END AS new_place FROM fx_visit v JOIN fx_place p ON v.user_id = p.user_id AND v.place_id = p.place_id WHERE v.visited), r AS (SELECT e.*, p.place_id AS of_venue, CASE WHEN e.name = old_name THEN 'same' WHEN new_venue IS NOT NULL THEN 'venue' WHEN new_place IS NOT NULL THEN 'place' WHEN old_venue IS NOT NULL THEN 'custom' ELSE 'renamed' END AS branch FROM e LEFT JOIN fx_place p ON p.user_id = e.user_id AND p.venue_id = e.new_venue), t AS (SELECT *, CASE branch WHEN 'same' THEN old_place WHEN 'renamed' THEN old_place WHEN 'venue' THEN coalesce(of_venue, 2000000000 + new_venue) WHEN 'place' THEN new_place ELSE 1000000000 + id END AS place_id FROM r), n AS (SELECT user_id, place_id, arg_max(name, id) AS name FROM t WHERE branch = 'renamed' GROUP BY user_id, place_id) SELECT 'visit' AS kind, v.user_id, v.visit_id AS id, coalesce(t.place_id, v.place_id) AS place_id, coalesce(t.branch, 'unchanged') AS detail, CASE WHEN t.id IS NULL THEN v.departure ELSE v.departure + 60 END AS departure FROM fx_visit v LEFT JOIN t ON v.visit_id = t.id UNION ALL SELECT 'place', p.user_id, NULL, p.place_id, coalesce(n.name, p.name), NULL FROM fx_place p LEFT JOIN n ON p.user_id = n.user_id AND p.place_id = n.place_id UNION ALL SELECT DISTINCT 'place', user_id, NULL, place_id, CASE WHEN branch = 'venue' THEN 'venue ' || new_venue ELSE name END, NULL FROM t WHERE branch = 'custom' OR (branch = 'venue' AND of_venue IS NULL)", "fx_visit", "fx_place"))
def edited_visits(spark, d):
    """Visits and places after edits of the visited ones: by the same name, a venue, another place, a new place in a venue's stead, or a new name."""
    v, places = view(spark, d, "fx_visit"), view(spark, d, "fx_place")
    sixth = F.col("visit_id") % 6
    names = places.select("user_id", "place_id", F.col("name").alias("now"))
    edits = v.filter("visited").join(names, ["user_id", "place_id"]).select(F.col("visit_id").alias("id"), "user_id", F.col("place_id").alias("old_place"), F.when(sixth == 0, F.col("now")).otherwise(F.concat(F.lit("edited "), "visit_id")).alias("name"), F.when(sixth.isin(2, 3), F.col("visit_id") % 100 + 1).alias("new_venue"), F.when(sixth == 4, F.col("visit_id") % 97).alias("new_place"), (F.col("departure") + 60).alias("departure"))
    routed, after = c.routed_places(edits, places)
    changed = routed.select(F.col("id").alias("visit_id"), "place_id", "departure", F.col("branch").alias("detail"))
    old = v.select("visit_id", "user_id", "place_id", "departure", F.lit("unchanged").alias("detail"))
    rows = c.partial_update(old, changed, "visit_id").select(F.lit("visit").alias("kind"), "user_id", F.col("visit_id").alias("id"), "place_id", "detail", "departure")
    none = F.lit(None).cast("long")
    return rows.unionByName(after.select(F.lit("place").alias("kind"), "user_id", none.alias("id"), "place_id", F.col("name").alias("detail"), none.alias("departure")))


@query("E5_marked", oracle("SELECT 'visit' AS kind, user_id, visit_id AS id, CASE WHEN visit_id % 7 = 0 THEN true ELSE deleted END AS deleted, CASE WHEN visit_id % 11 = 0 THEN true ELSE visited END AS visited, NULL AS name, NULL AS place_type FROM fx_visit UNION ALL SELECT 'place', user_id, place_id, NULL, NULL, CASE WHEN place_id % 5 = 0 AND place_id % 3 = 2 THEN 'Home' WHEN place_id % 5 = 1 THEN 'renamed ' || place_id ELSE name END, CASE WHEN place_id % 5 = 0 THEN CASE place_id % 3 WHEN 0 THEN -1 ELSE place_id % 3 END ELSE 0 END FROM fx_place", "fx_visit", "fx_place"))
def marked(spark, d):
    """Visits marked as deleted or visited; places of a new type (0 becomes -1, 2 names the place Home) or a new name."""
    v, p = view(spark, d, "fx_visit"), view(spark, d, "fx_place")
    marks = v.filter("visit_id % 7 = 0 or visit_id % 11 = 0").select("visit_id", F.when(F.col("visit_id") % 7 == 0, True).alias("deleted"), F.when(F.col("visit_id") % 11 == 0, True).alias("visited"))
    visits = c.partial_update(v.select("visit_id", "user_id", "deleted", "visited"), marks, "visit_id")
    id_ = F.concat_ws(":", "user_id", "place_id")
    old = p.select(id_.alias("key"), "user_id", "place_id", "name", F.lit(0).cast("long").alias("place_type"))
    asked = F.col("place_id") % 3
    types = p.filter("place_id % 5 = 0").select(id_.alias("key"), F.when(asked == 0, F.lit(-1).cast("long")).otherwise(asked).alias("place_type"), F.when(asked == 2, "Home").alias("name"))
    names = p.filter("place_id % 5 = 1").select(id_.alias("key"), F.concat(F.lit("renamed "), "place_id").alias("name"))
    places = c.partial_update(c.partial_update(old, types, "key"), names, "key")
    none = lambda kind: F.lit(None).cast(kind)
    rows = visits.select(F.lit("visit").alias("kind"), "user_id", F.col("visit_id").alias("id"), "deleted", "visited", none("string").alias("name"), none("long").alias("place_type"))
    return rows.unionByName(places.select(F.lit("place").alias("kind"), "user_id", F.col("place_id").alias("id"), none("boolean").alias("deleted"), none("boolean").alias("visited"), "name", "place_type"))


FEW = "(SELECT user_id FROM fx_visit GROUP BY user_id HAVING count(*) < 295)"
NINE = {
    "traces": "SELECT user_id FROM fx_trace", "visits": "SELECT user_id FROM fx_visit", "places": "SELECT user_id FROM fx_place",
    "moves": "SELECT user_id FROM (SELECT user_id, lag(departure) OVER (PARTITION BY user_id, day_no ORDER BY arrival, visit_id) AS l FROM fx_visit) WHERE l IS NOT NULL",
    "review_challenges": "SELECT user_id FROM (SELECT DISTINCT user_id, day_no, place_id FROM fx_visit)", "reviews_visits": "SELECT user_id FROM fx_visit WHERE visited",
    "reviews_personal_information": "SELECT session_id AS user_id FROM fx_rating", "personal_information": "SELECT user_id FROM (SELECT DISTINCT p.user_id, p.place_id, s.pi_id FROM fx_place p JOIN fx_score s ON p.place_id = s.venue_id)",
    "aggregated_personal_information": "SELECT user_id FROM (SELECT DISTINCT session_id AS user_id, pi_id FROM fx_rating)",
}


@query("E6_erased", oracle(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS before, count(*) FILTER (WHERE user_id NOT IN {FEW}) AS after FROM ({q})" for n, q in NINE.items()), "fx_visit", "fx_trace", "fx_place", "fx_rating", "fx_score"))
def erased(spark, d):
    """Rows of the nine tables before and after users with few visits are erased."""
    from mobtrace.operators import stays

    v, places, ratings = view(spark, d, "fx_visit"), view(spark, d, "fx_place"), view(spark, d, "fx_rating").withColumnRenamed("session_id", "user_id")
    pi = places.select("user_id", "place_id").join(view(spark, d, "fx_score").select(F.col("venue_id").alias("place_id"), "pi_id").distinct(), "place_id")
    tables = {
        "traces": view(spark, d, "fx_trace"), "visits": v, "places": places, "moves": stays.moves(v), "review_challenges": v.select("user_id", "day_no", "place_id").distinct(),
        "reviews_visits": v.filter("visited"), "reviews_personal_information": ratings, "personal_information": pi, "aggregated_personal_information": ratings.select("user_id", "pi_id").distinct(),
    }
    users = v.groupBy("user_id").agg(F.count("*").alias("n")).filter("n < 295").select("user_id")
    out = c.erase(tables, users, dict.fromkeys(tables, "user_id"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    rows = [count(df, "before").crossJoin(count(out[name], "after")).select(F.lit(name).alias("name"), "before", "after") for name, df in tables.items()]  # a row on either side
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    return found


@query("E6_without_orphans", oracle("WITH p AS (SELECT DISTINCT user_id * 1000 + place_id AS place_id FROM fx_visit), v AS (SELECT visit_id, deleted, user_id * 1000 + place_id AS place_id FROM fx_visit), o AS (SELECT place_id FROM v GROUP BY place_id HAVING count(*) = 1 AND count(*) FILTER (WHERE deleted) = 1) SELECT place_id FROM p WHERE place_id NOT IN (SELECT place_id FROM o)"))
def without_orphans(spark, d):
    v = view(spark, d, "fx_visit").withColumn("place_id", F.col("user_id") * 1000 + F.col("place_id"))
    return c.without_orphans(v.select("place_id").distinct(), v, v.filter("deleted"))


KINDS = "SELECT 'relevance' AS kind, session_id, place_id, pi_id, rating FROM fx_rating UNION ALL SELECT 'importance', session_id, place_id, pi_id, 1 + (rating + pi_id) % 5 FROM fx_rating UNION ALL SELECT 'privacy', session_id, NULL, pi_id, max(rating) FROM fx_rating GROUP BY session_id, pi_id UNION ALL SELECT 'place', session_id, place_id, NULL, min(rating) FROM fx_rating GROUP BY session_id, place_id"


@query("E7_ratings_upserted", oracle(f"WITH k AS ({KINDS}) SELECT kind, session_id, place_id, pi_id, (CASE WHEN rating < 4 THEN 6 - rating ELSE rating END)::BIGINT AS rating FROM k UNION ALL SELECT 'new', session_id, -1, pi_id, 3 FROM fx_rating WHERE pi_id = 1 GROUP BY session_id, pi_id UNION ALL SELECT 'session', session_id, NULL, NULL, CASE WHEN count(*) >= 3 THEN 1700000000 + session_id END FROM fx_rating GROUP BY session_id"))
def ratings_upserted(spark, d):
    """Four kinds of ratings after newer ones were put on them, by their keys (null counts as a key), with new rows; and the ends of finished sessions."""
    r_ = view(spark, d, "fx_rating").withColumn("rating", F.col("rating").cast("long"))
    none = F.lit(None).cast("long")
    columns = ["kind", "session_id", "place_id", "pi_id", "rating"]
    both = r_.select(F.explode(F.array(F.struct(F.lit("relevance").alias("kind"), F.col("rating").alias("r")), F.struct(F.lit("importance").alias("kind"), (1 + (F.col("rating") + F.col("pi_id")) % 5).alias("r")))).alias("x"), "session_id", "place_id", "pi_id")
    both = both.select("x.kind", "session_id", "place_id", "pi_id", F.col("x.r").alias("rating"))
    privacy = r_.groupBy("session_id", "pi_id").agg(F.max("rating").alias("rating")).select(F.lit("privacy").alias("kind"), "session_id", none.alias("place_id"), "pi_id", "rating")
    place = r_.groupBy("session_id", "place_id").agg(F.min("rating").alias("rating")).select(F.lit("place").alias("kind"), "session_id", "place_id", none.alias("pi_id"), "rating")
    old = both.unionByName(privacy).unionByName(place)
    fresh = r_.filter("pi_id = 1").select(F.lit("new").alias("kind"), "session_id", F.lit(-1).cast("long").alias("place_id"), "pi_id", F.lit(3).cast("long").alias("rating")).distinct()
    new = old.filter("rating < 4").withColumn("rating", 6 - F.col("rating")).unionByName(fresh)
    ends = r_.groupBy("session_id").agg(F.count("*").alias("n")).select(F.lit("session").alias("kind"), "session_id", none.alias("place_id"), none.alias("pi_id"), F.when(F.col("n") >= 3, 1_700_000_000 + F.col("session_id")).alias("rating"))
    return c.upsert(old.select(columns), new.select(columns), ["kind", "session_id", "place_id", "pi_id"], {"rating": "new"}).unionByName(ends)


@query("E8_saved_reviews", oracle("WITH r AS (SELECT place_id, pi_id, max(rating) AS review FROM fx_rating WHERE rating > 2 GROUP BY place_id, pi_id) SELECT s.venue_id, s.pi_id, s.model_type, s.feature_type, r.review FROM fx_score s LEFT JOIN r ON s.venue_id = r.place_id AND s.pi_id = r.pi_id"))
def saved_reviews(spark, d):
    r = view(spark, d, "fx_rating").filter("rating > 2").groupBy(F.col("place_id").alias("venue_id"), "pi_id").agg(F.max("rating").alias("review"))
    return view(spark, d, "fx_score").join(r, ["venue_id", "pi_id"], "left").select("venue_id", "pi_id", "model_type", "feature_type", "review")


#: Interests of users over all their places, and the three answers that some users gave to them.
AGGREGATED = "g AS (SELECT session_id AS user_id, pi_id, count(DISTINCT place_id) AS places FROM fx_rating GROUP BY session_id, pi_id), w AS (SELECT session_id AS user_id, pi_id, max(rating) AS personal, min(rating) AS explanation, CASE WHEN pi_id % 3 > 0 THEN max(rating + place_id % 2) END AS privacy FROM fx_rating WHERE session_id % 2 = 0 GROUP BY session_id, pi_id)"


@query("E8_aggregated_reviews", oracle(f"WITH {AGGREGATED} SELECT g.user_id, g.pi_id, places, personal AS review_personal_information, explanation AS review_explanation, privacy AS review_privacy, w.user_id IS NOT NULL AS reviewed FROM g LEFT JOIN w ON g.user_id = w.user_id AND g.pi_id = w.pi_id", "fx_rating"))
def aggregated_reviews(spark, d):
    """Reviews of aggregated interests: the three answers fill what they say, and the interest counts as reviewed."""
    r = view(spark, d, "fx_rating").withColumnRenamed("session_id", "user_id")
    none = F.lit(None).cast("long")
    answers = ["review_personal_information", "review_explanation", "review_privacy"]
    old = r.groupBy("user_id", "pi_id").agg(F.count_distinct("place_id").alias("places")).select("*", *[none.alias(a) for a in answers], F.lit(False).alias("reviewed"))
    given = r.filter("user_id % 2 = 0").groupBy("user_id", "pi_id").agg(F.max("rating").alias(answers[0]), F.min("rating").alias(answers[1]), F.max(F.when(F.col("pi_id") % 3 > 0, F.col("rating") + F.col("place_id") % 2)).alias(answers[2]))
    new = given.select("user_id", "pi_id", none.alias("places"), *answers, F.lit(True).alias("reviewed"))
    return c.upsert(old, new, ["user_id", "pi_id"], {a: "filled" for a in answers} | {"reviewed": "new"})


@query("E9_refreshed_icons", oracle("SELECT v.visit_id, coalesce(c.name, 'default') AS icon FROM fx_visit v LEFT JOIN fx_venue p ON v.place_id = p.venue_id LEFT JOIN fx_category c ON p.leaf_category = c.category_id"))
def refreshed_icons(spark, d):
    names = view(spark, d, "fx_category").select(F.col("category_id").alias("leaf_category"), F.col("name").alias("icon"))
    icons = view(spark, d, "fx_venue").select(F.col("venue_id").alias("place_id"), "leaf_category").join(names, "leaf_category")
    return view(spark, d, "fx_visit").join(icons, "place_id", "left").select("visit_id", F.coalesce("icon", F.lit("default")).alias("icon"))
