"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mobtrace.fixtures import oracle, table, view
from mobtrace.operators import rows as r
from mobtrace.plans.registry import query



@query("A1_user_summary", oracle("SELECT user_id, count(DISTINCT place_id) AS places, count(DISTINCT visit_id) AS visits, count(DISTINCT day_no) AS n_days, max(departure) AS last_departure, list_sort(list(DISTINCT day_no)) AS days FROM fx_visit WHERE deleted IS NOT TRUE GROUP BY user_id ORDER BY last_departure DESC, user_id"))
def user_summary(spark, d):
    """Distinct places and days come from one set each, so the rows aren't expanded for every distinct count."""
    v = view(spark, d, "fx_visit").filter(r.not_true(F.col("deleted")))
    s = v.groupBy("user_id").agg(F.size(F.collect_set("place_id")).cast("long").alias("places"), F.count_distinct("visit_id").alias("visits"), F.max("departure").alias("last_departure"), F.array_sort(F.collect_set("day_no")).alias("days"))
    return s.select("user_id", "places", "visits", F.size("days").cast("long").alias("n_days"), "last_departure", "days").orderBy(F.desc("last_departure"), "user_id")


@query("A2_reviewed_summary", oracle("SELECT v.user_id, count(DISTINCT place_id) AS places, count(*) AS visits, (SELECT count(DISTINCT (place_id, pi_id)) FROM fx_rating r WHERE r.session_id = v.user_id) AS reviewed FROM fx_visit v WHERE visited GROUP BY v.user_id"))
def reviewed_summary(spark, d):
    v = view(spark, d, "fx_visit").filter("visited").groupBy("user_id").agg(F.count_distinct("place_id").alias("places"), F.count("*").alias("visits"))
    n = view(spark, d, "fx_rating").groupBy("session_id").agg(F.count_distinct("place_id", "pi_id").alias("reviewed"))
    return v.join(n, F.col("user_id") == F.col("session_id"), "left").select("user_id", "places", "visits", F.coalesce("reviewed", F.lit(0).cast("long")).alias("reviewed"))


@query("A3_place_totals", oracle("SELECT place_id, sum(departure - arrival)::BIGINT AS duration, count(DISTINCT visit_id) AS visits FROM fx_visit WHERE deleted IS NOT TRUE GROUP BY place_id"))
def place_totals(spark, d):
    v = view(spark, d, "fx_visit").filter(r.not_true(F.col("deleted")))
    return v.groupBy("place_id").agg(F.sum(F.col("departure") - F.col("arrival")).alias("duration"), F.count_distinct("visit_id").alias("visits"))


@query("A4_nested_counts", oracle("SELECT count(*) AS places, sum(n)::BIGINT AS visits, max(users) AS most_users FROM (SELECT place_id, count(*) AS n, count(DISTINCT user_id) AS users FROM fx_visit GROUP BY place_id)"))
def nested_counts(spark, d):
    by = view(spark, d, "fx_visit").groupBy("place_id").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return by.agg(F.count("*").alias("places"), F.sum("n").alias("visits"), F.max("users").alias("most_users"))


@query("A5_places_with_visits", oracle("SELECT user_id, place_id, sum(departure - arrival)::BIGINT AS duration, list_sort(list({'arrival': arrival, 'visit_id': visit_id})) AS visits FROM fx_visit WHERE deleted IS NOT TRUE GROUP BY user_id, place_id"))
def places_with_visits(spark, d):
    v = view(spark, d, "fx_visit").filter(r.not_true(F.col("deleted")))
    return v.groupBy("user_id", "place_id").agg(F.sum(F.col("departure") - F.col("arrival")).alias("duration"), F.array_sort(F.collect_list(F.struct("arrival", "visit_id"))).alias("visits"))


@query("A6_top_places", oracle("SELECT place_id, count(*) AS visits FROM fx_visit GROUP BY place_id ORDER BY visits DESC, place_id LIMIT 25"))
def top_places(spark, d):
    return view(spark, d, "fx_visit").groupBy("place_id").agg(F.count("*").alias("visits")).orderBy(F.desc("visits"), "place_id").limit(25)


@query("A7_messages_of_users", oracle("SELECT user_id, count(*) AS n FROM fx_chat WHERE sender GROUP BY user_id"))
def messages_of_users(spark, d):
    return view(spark, d, "fx_chat").filter("sender").groupBy("user_id").agg(F.count("*").alias("n"))


@query("A8_venues_with_n_tips", oracle("SELECT venue_id, count(*) AS n FROM fx_tip GROUP BY venue_id HAVING count(*) = (SELECT min(n) FROM (SELECT count(*) AS n FROM fx_tip GROUP BY venue_id))"))
def venues_with_n_tips(spark, d, n: int | None = None):
    """Venues with exactly n tips; without n, as in the query, n is the smallest number that any venue has, so tables of every size have such venues."""
    counts = view(spark, d, "fx_tip").groupBy("venue_id").agg(F.count("*").alias("n"))
    if n is not None:
        return counts.filter(F.col("n") == n)
    return counts.join(F.broadcast(counts.agg(F.min("n").alias("n"))), "n").select("venue_id", "n")  # one row


@query("A9_category_names", oracle("SELECT v.venue_id, list_sort(list(DISTINCT c.name)) AS names FROM fx_venue v JOIN fx_category c ON c.category_id IN (v.leaf_category, v.extra_category) GROUP BY v.venue_id"))
def category_names(spark, d):
    v = view(spark, d, "fx_venue").select("venue_id", F.explode(F.array("leaf_category", "extra_category")).alias("category_id"))
    return v.join(view(spark, d, "fx_category"), "category_id").groupBy("venue_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


@query("A10_merged_cells", oracle("SELECT extra_category AS category, list_sort(list(DISTINCT k)) AS keys FROM (SELECT extra_category, unnest([leaf_category, 'k' || nb_checkins]) AS k FROM fx_venue) GROUP BY extra_category"))
def merged_cells(spark, d):
    from mobtrace.functions.scalars import decode_cell

    cell = F.concat("extra_category", F.lit("["), "leaf_category", F.lit(";k"), "nb_checkins", F.lit("]"))
    c = view(spark, d, "fx_venue").select(decode_cell(cell).alias("c")).select("c.category", F.explode("c.keys").alias("key"))
    return c.groupBy("category").agg(F.array_sort(F.collect_set("key")).alias("keys"))


@query("A11_two_ratings", oracle("SELECT place_id, list_sort(list(rating) FILTER (WHERE pi_id = 1)) AS of_1, list_sort(list(rating) FILTER (WHERE pi_id = 2)) AS of_2 FROM fx_rating WHERE pi_id IN (1, 2) GROUP BY place_id"))
def two_ratings(spark, d):
    of = lambda i: F.array_sort(F.collect_list(F.when(F.col("pi_id") == i, F.col("rating"))))
    g = view(spark, d, "fx_rating").filter(F.col("pi_id").isin(1, 2)).groupBy("place_id").agg(of(1).alias("a"), of(2).alias("b"))
    return g.select("place_id", F.when(F.size("a") > 0, F.col("a")).alias("of_1"), F.when(F.size("b") > 0, F.col("b")).alias("of_2"))


SESSIONS = "SELECT user_id, day_no, min(arrival) AS s, CASE WHEN count(deleted) > 0 THEN min(departure) END AS e, count(DISTINCT place_id) AS places FROM fx_visit GROUP BY user_id, day_no"


def sessions(spark, d):
    """A user's day as a session: start, end (null if it isn't finished), distinct places."""
    return view(spark, d, "fx_visit").groupBy("user_id", "day_no").agg(F.min("arrival").alias("s"), F.when(F.count("deleted") > 0, F.min("departure")).alias("e"), F.count_distinct("place_id").alias("places"))


@query("A12_session_stats", oracle(f"WITH t AS ({SESSIONS}) SELECT count(*) AS sessions, count(e) AS finished, round(avg(e - s) FILTER (WHERE e - s < 3600) / 60, 6) AS mean_minutes, round(avg(places), 6) AS mean_places, (SELECT count(DISTINCT place_id) FROM fx_visit) AS places FROM t"))
def session_stats(spark, d):
    t = sessions(spark, d)
    length = F.col("e") - F.col("s")
    every = view(spark, d, "fx_visit").agg(F.count_distinct("place_id").alias("places"))
    s = t.agg(F.count("*").alias("sessions"), F.count("e").alias("finished"), F.round(F.avg(F.when(length < 3600, length)) / 60, 6).alias("mean_minutes"), F.round(F.avg("places"), 6).alias("mean_places"))
    return s.crossJoin(every)  # a row on either side


@query("A12_session_rows", oracle(f"WITH t AS ({SESSIONS}) SELECT user_id, day_no, places AS nb_places, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') AS started, coalesce(strftime(make_timestamp(e * 1000000), '%Y-%m-%d %H:%M:%S'), 'N/A') AS ended FROM t"))
def session_rows(spark, d):
    text = lambda c: F.coalesce(F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))
    return sessions(spark, d).select("user_id", "day_no", F.col("places").alias("nb_places"), text("s").alias("started"), text("e").alias("ended"))


@query("A13_ratings_of_pairs", oracle("SELECT place_id, pi_id, list_sort(list(rating)) AS ratings, round(avg(rating), 6) AS mean FROM fx_rating GROUP BY place_id, pi_id"))
def ratings_of_pairs(spark, d):
    return view(spark, d, "fx_rating").groupBy("place_id", "pi_id").agg(F.array_sort(F.collect_list("rating")).alias("ratings"), F.round(F.avg("rating"), 6).alias("mean"))


RANKED = "(SELECT *, row_number() OVER (PARTITION BY venue_id, model_type, feature_type ORDER BY score DESC, pi_id) - 1 AS rank FROM fx_score)"


@query("A14_rank_by_rating", oracle(f"SELECT model_type, rank, " + ", ".join(f"count(*) FILTER (WHERE rating = {i}) AS r{i}" for i in range(1, 6)) + f" FROM {RANKED} s JOIN fx_rating r ON s.venue_id = r.place_id AND s.pi_id = r.pi_id GROUP BY model_type, rank", "fx_score", "fx_rating"))
def rank_by_rating(spark, d):
    from mobtrace.plans.reads import ranked

    s = ranked(spark, d)
    both = s.join(view(spark, d, "fx_rating").withColumnRenamed("place_id", "venue_id"), ["venue_id", "pi_id"])
    p = both.groupBy("model_type", "rank").pivot("rating", [1, 2, 3, 4, 5]).count()
    return p.select("model_type", "rank", *[F.coalesce(F.col(str(i)), F.lit(0).cast("long")).alias(f"r{i}") for i in range(1, 6)])


@query("A15_ensemble_score", oracle(f"SELECT venue_id, pi_id, round(count(*) * avg(score) / (avg(rank) + 1) + 1e-7, 4) AS score FROM {RANKED} GROUP BY venue_id, pi_id", "fx_score"))
def ensemble_score(spark, d):
    """Ranks come from a window over the one read. The added 1e-7 keeps scores that lie on a rounding step on one side of it."""
    w = Window.partitionBy("venue_id", "model_type", "feature_type").orderBy(F.desc("score"), "pi_id")
    s = view(spark, d, "fx_score").withColumn("rank", F.row_number().over(w) - 1)
    return s.groupBy("venue_id", "pi_id").agg(F.round(F.count("*") * F.avg("score") / (F.avg("rank") + 1) + 1e-7, 4).alias("score"))


@query("A16_scores_regrouped", oracle("SELECT venue_id, pi_id, round(avg(score), 6) AS mean, list_sort(list({'model_type': model_type, 'feature_type': feature_type, 'score': score})) AS meta FROM fx_score GROUP BY venue_id, pi_id"))
def scores_regrouped(spark, d):
    return view(spark, d, "fx_score").groupBy("venue_id", "pi_id").agg(F.round(F.avg("score"), 6).alias("mean"), F.array_sort(F.collect_list(F.struct("model_type", "feature_type", "score"))).alias("meta"))


@query("A17_configurations", oracle("SELECT DISTINCT 'configuration' AS kind, model_type || '/' || feature_type AS value FROM fx_score UNION ALL SELECT DISTINCT 'place', venue_id || '' FROM fx_score UNION ALL SELECT DISTINCT 'category', extra_category FROM fx_venue UNION ALL SELECT DISTINCT 'subcategory', leaf_category FROM fx_venue"))
def configurations(spark, d):
    """What occurs: model configurations, places, categories and subcategories; one row for each, so a pass over each table."""
    s, v = view(spark, d, "fx_score"), view(spark, d, "fx_venue")
    each = lambda *pairs: F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in pairs])).alias("x")
    found = s.select(each(("configuration", F.concat_ws("/", "model_type", "feature_type")), ("place", F.col("venue_id")))).unionByName(v.select(each(("category", F.col("extra_category")), ("subcategory", F.col("leaf_category")))))
    return found.select("x.kind", "x.value").distinct()


@query("A18_vocabulary", oracle("SELECT venue_id, n, row_number() OVER (ORDER BY n DESC, venue_id) AS code FROM (SELECT venue_id, count(*) AS n FROM fx_checkin GROUP BY venue_id) UNION ALL SELECT NULL, 0, 0"))
def vocabulary(spark, d):
    """Dense codes from 1 by frequency; code 0, without an id, is for what isn't known."""
    n = view(spark, d, "fx_checkin").groupBy("venue_id").agg(F.count("*").alias("n"))
    unknown = spark.range(1).select(F.lit(None).cast("long").alias("venue_id"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("code"))
    return r.numbered(n, [F.desc("n"), F.col("venue_id")], "code").unionByName(unknown)


@query("A20_checkins_in_order", oracle("SELECT user_id, list_sort(list({'ts': ts, 'venue_id': venue_id})) AS checkins FROM fx_checkin GROUP BY user_id"))
def checkins_in_order(spark, d):
    return view(spark, d, "fx_checkin").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "venue_id"))).alias("checkins"))


@query("A21_day_bundles", oracle("WITH v AS (SELECT *, lag(place_id) OVER w AS from_place, lag(departure) OVER w AS left_at FROM fx_visit WHERE deleted IS NOT TRUE WINDOW w AS (PARTITION BY user_id, day_no ORDER BY arrival, visit_id)), i AS (SELECT u.user_id, u.day_no, list_sort(list(DISTINCT r.pi_id)) AS interests FROM (SELECT DISTINCT user_id, day_no, place_id FROM v) u JOIN fx_rating r ON r.session_id = u.user_id AND r.place_id = u.place_id GROUP BY u.user_id, u.day_no), b AS (SELECT user_id, day_no, list_sort(list({'arrival': arrival, 'place_id': place_id})) AS visits, list_sort(list(DISTINCT place_id)) AS places, coalesce(list_sort(list({'arrived_at': arrival, 'from_place': from_place, 'to_place': place_id, 'left_at': left_at}) FILTER (WHERE left_at IS NOT NULL)), []) AS moves, min(arrival) AS first_arrival, max(departure) AS last_departure FROM v GROUP BY user_id, day_no) SELECT b.*, coalesce(i.interests, []) AS interests FROM b LEFT JOIN i ON b.user_id = i.user_id AND b.day_no = i.day_no", "fx_visit", "fx_rating"))
def day_bundles(spark, d):
    """Visits, places, moves and rated interests of a user's day; lists are as long as a day's visits."""
    from pyspark.sql import Window

    v = view(spark, d, "fx_visit").filter(r.not_true(F.col("deleted")))
    w = Window.partitionBy("user_id", "day_no").orderBy("arrival", "visit_id")
    v = v.withColumns({"from_place": F.lag("place_id").over(w), "left_at": F.lag("departure").over(w)})
    move = F.when(F.col("left_at").isNotNull(), F.struct(F.col("arrival").alias("arrived_at"), "from_place", F.col("place_id").alias("to_place"), "left_at"))
    b = v.groupBy("user_id", "day_no").agg(F.array_sort(F.collect_list(F.struct("arrival", "place_id"))).alias("visits"), F.array_sort(F.collect_set("place_id")).alias("places"), F.array_sort(F.collect_list(move)).alias("moves"), F.min("arrival").alias("first_arrival"), F.max("departure").alias("last_departure"))
    rated = view(spark, d, "fx_rating").select(F.col("session_id").alias("user_id"), "place_id", "pi_id")
    i = v.select("user_id", "day_no", "place_id").distinct().join(rated, ["user_id", "place_id"]).groupBy("user_id", "day_no").agg(F.array_sort(F.collect_set("pi_id")).alias("interests"))
    return b.join(i, ["user_id", "day_no"], "left").withColumn("interests", F.coalesce("interests", F.array().cast("array<bigint>")))


#: The time that reminders are worked out for; local hour 20 where the offset is an hour.
NOW = 996_699_600
DAY = 86_400
PENDING = f"""SELECT u.user_id, unconfirmed, coalesce(unrated_places, 0) AS unrated_places, coalesce(unrated_interests, 0) AS unrated_interests
FROM (SELECT user_id, count(*) FILTER (WHERE visited IS NULL AND arrival > {NOW} - 7 * {DAY}) AS unconfirmed FROM fx_visit GROUP BY user_id) u
LEFT JOIN (SELECT user_id, count(DISTINCT place_id) AS unrated_places FROM i WHERE rating IS NULL GROUP BY user_id) p ON u.user_id = p.user_id
LEFT JOIN (SELECT user_id, count(*) AS unrated_interests FROM (SELECT user_id, pi_id FROM i GROUP BY user_id, pi_id HAVING count(rating) = 0) GROUP BY user_id) a ON u.user_id = a.user_id"""
OWN = "i AS (SELECT p.user_id, p.place_id, s.pi_id, r.rating FROM fx_place p JOIN (SELECT DISTINCT venue_id, pi_id FROM fx_score) s ON p.place_id = s.venue_id LEFT JOIN fx_rating r ON r.session_id = p.user_id AND r.place_id = p.place_id AND r.pi_id = s.pi_id)"


def pending(spark, d, now: int):
    """Reviews that wait for each user: visits of the last week, places with an unrated interest, interests that are rated nowhere."""
    v = view(spark, d, "fx_visit")
    recent = F.col("visited").isNull() & (F.col("arrival") > now - 7 * DAY)
    u = v.groupBy("user_id").agg(F.count_if(recent).alias("unconfirmed"))
    every = view(spark, d, "fx_score").select(F.col("venue_id").alias("place_id"), "pi_id").distinct()
    rated = view(spark, d, "fx_rating").select(F.col("session_id").alias("user_id"), "place_id", "pi_id", "rating")
    i = view(spark, d, "fx_place").select("user_id", "place_id").join(every, "place_id").join(rated, ["user_id", "place_id", "pi_id"], "left")
    p = i.filter("rating is null").groupBy("user_id").agg(F.count_distinct("place_id").alias("unrated_places"))
    a = i.groupBy("user_id", "pi_id").agg(F.count("rating").alias("n")).groupBy("user_id").agg(F.count_if(F.col("n") == 0).alias("unrated_interests"))
    return u.join(p, "user_id", "left").join(a, "user_id", "left").fillna(0, ["unrated_places", "unrated_interests"])


@query("A22_pending_reviews", oracle(f"WITH {OWN} {PENDING}", "fx_visit", "fx_place", "fx_score", "fx_rating"))
def pending_reviews(spark, d):
    return pending(spark, d, NOW)


@query("A23_reminders", oracle(f"WITH {OWN}, p AS ({PENDING}), u AS (SELECT user_id, min(arrival) AS joined, max(departure) AS updated, arg_max(utc_offset, (arrival, visit_id)) AS zone FROM fx_visit GROUP BY user_id), k AS (SELECT u.user_id, CASE WHEN abs(updated - {NOW}) <= 96 * 3600 AND {NOW} - joined > {DAY} AND (({NOW} - zone) % {DAY}) // 3600 = 20 THEN CASE WHEN unconfirmed > 0 THEN 'timeline' WHEN unrated_places > 0 OR unrated_interests > 0 THEN 'review' END END AS kind, abs(updated - {NOW}) <= 2 * {DAY} AND {NOW} - joined > 7 * {DAY} AS survey FROM u JOIN p ON u.user_id = p.user_id) SELECT * FROM k WHERE kind IS NOT NULL OR survey", "fx_visit", "fx_place", "fx_score", "fx_rating"))
def reminders(spark, d, now: int = NOW):
    """Who is due for a message: reviews at local hour 20, for users who were seen within 96 hours and joined a day ago; a survey for those seen within 48 hours who joined a week ago."""
    v = view(spark, d, "fx_visit")
    u = v.groupBy("user_id").agg(F.min("arrival").alias("joined"), F.max("departure").alias("updated"), F.max_by("utc_offset", F.struct("arrival", "visit_id")).alias("zone"))
    u = u.join(pending(spark, d, now), "user_id")
    seen, since = F.abs(F.col("updated") - now), now - F.col("joined")
    due = (seen <= 96 * 3600) & (since > DAY) & (F.floor(F.pmod(now - F.col("zone"), F.lit(DAY)) / 3600) == 20)
    kind = F.when(due & (F.col("unconfirmed") > 0), "timeline").when(due & ((F.col("unrated_places") > 0) | (F.col("unrated_interests") > 0)), "review")
    return u.select("user_id", kind.alias("kind"), ((seen <= 2 * DAY) & (since > 7 * DAY)).alias("survey")).filter("kind is not null or survey")


@query("A24_frequency_weights", oracle("WITH n AS (SELECT pi_id, count(*) AS n FROM fx_rating WHERE rating >= 4 GROUP BY pi_id) SELECT k.pi_id, round(coalesce(n.n, 1)::DOUBLE / (SELECT sum(n) FROM n), 6) AS weight FROM (SELECT DISTINCT pi_id FROM fx_score) k LEFT JOIN n ON k.pi_id = n.pi_id"))
def frequency_weights(spark, d):
    n = view(spark, d, "fx_rating").filter("rating >= 4").groupBy("pi_id").agg(F.count("*").alias("n"))
    every = view(spark, d, "fx_score").select("pi_id").distinct()
    total = n.agg(F.sum("n").alias("total"))
    return every.join(n, "pi_id", "left").crossJoin(F.broadcast(total)).select("pi_id", F.round(F.coalesce("n", F.lit(1)) / F.col("total"), 6).alias("weight"))  # one row is sent


@query("A25_keys_of_cells", oracle("SELECT category, key FROM (SELECT DISTINCT extra_category AS category, k AS key FROM (SELECT extra_category, unnest([leaf_category, 'K' || (nb_checkins % 7)]) AS k FROM fx_venue)) ORDER BY category, lower(key)"))
def keys_of_cells(spark, d):
    from mobtrace.functions.scalars import decode_cell

    cell = F.concat("extra_category", F.lit("["), "leaf_category", F.lit(";K"), F.col("nb_checkins") % 7, F.lit("]"))
    c = view(spark, d, "fx_venue").select(decode_cell(cell).alias("c")).select("c.category", F.explode("c.keys").alias("key"))
    return c.distinct().orderBy("category", F.lower("key"))
