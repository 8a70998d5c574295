"""Readers and writers, as round trips of views through files in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from mobtrace.fixtures import oracle, table, view
from mobtrace.functions import geo
from mobtrace.functions import scalars as x
from mobtrace.plans.registry import query
from mobtrace.sources import files
from mobtrace.sources.scratch import scratch


@query("S1_traces", oracle("SELECT DISTINCT CAST(user_id AS VARCHAR) AS user_id, round(lat, 6) AS lat, round(lon, 6) AS lon, ts_local, ts_utc, strftime(make_timestamp(ts_local * 1000000), '%Y-%m-%d') AS day, nb_steps FROM fx_trace"))
def traces(spark, d):
    t = view(spark, d, "fx_trace")
    stamp = F.concat(F.date_format(F.timestamp_seconds("ts_local"), "yyyy-MM-dd HH:mm:ss"), F.lit(" +0100"))
    out = t.select(F.col("user_id").cast("string").alias("User"), F.col("lat").alias("Lat"), F.col("lon").alias("Lon"), stamp.alias("Timestamp"), F.col("nb_steps").alias("NbSteps"))
    blank = out.limit(1).withColumn("User", F.lit(" "))
    path = scratch(spark, "traces")
    out.unionByName(blank.select(out.columns)).write.option("header", True).csv(path)
    return files.read_traces(spark, path).select("user_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "ts_local", "ts_utc", "day", "nb_steps")


@query("S2_points", oracle("SELECT lat, lon, ts_local AS ts FROM fx_trace"))
def points(spark, d):
    path = scratch(spark, "points")
    view(spark, d, "fx_trace").select("lat", "lon", "ts_local").write.csv(path)
    return files.read_points(spark, path)


@query("S4_checkins", oracle("SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(venue_id AS VARCHAR) AS venue_id, ts * 1000 AS ms, ts * 1000 + 3600000 AS local_ms FROM fx_checkin"))
def checkins(spark, d):
    path = scratch(spark, "checkins")
    date = F.date_format(F.timestamp_seconds("ts"), "EEE MMM dd HH:mm:ss xx yyyy")
    view(spark, d, "fx_checkin").select("user_id", "venue_id", date.alias("date"), F.lit(60).alias("o")).write.option("sep", "\t").csv(path)
    return files.read_checkins(spark, path)


@query("S5_pois", oracle("SELECT CAST(venue_id AS VARCHAR) AS venue_id, lat, lon, leaf_category AS category FROM fx_venue"))
def pois(spark, d):
    path = scratch(spark, "pois")
    v = view(spark, d, "fx_venue").select("venue_id", F.col("lat").cast("string").alias("lat"), F.col("lon").cast("string").alias("lon"), "leaf_category", F.lit("GB").alias("c"), "name", F.lit("*").alias("e"))
    bad = v.limit(3).withColumn("lat", F.lit("north"))
    v.unionByName(bad).write.option("sep", "\t").csv(path)
    return files.read_pois(spark, path).select("venue_id", "lat", "lon", "category")


@query("S6_place_interests", oracle("SELECT CAST(venue_id AS VARCHAR) AS place_id, list(pi_id || '' ORDER BY score DESC, pi_id || '') AS interests FROM (SELECT venue_id, pi_id, max(score) AS score FROM fx_score GROUP BY venue_id, pi_id) GROUP BY venue_id"))
def place_interests(spark, d):
    path = scratch(spark, "place-pi")
    s = view(spark, d, "fx_score").groupBy("venue_id", "pi_id").agg(F.max("score").alias("score"))
    s.select("venue_id", F.lit("predict").alias("t"), "pi_id", F.concat(F.lit("pi, "), "pi_id").alias("n"), "score").write.csv(path)
    return files.read_place_pi(spark, path).select("place_id", F.transform("interests", lambda i: i["pi_id"]).alias("interests"))


@query("S7_wide_lookup", "SELECT p_brand AS \"ID\", unnest(['INT', 'INT', 'ACT']) AS category, unnest(['a ' || p_brand, 'b ' || p_brand, 'c']) AS value FROM (SELECT DISTINCT p_brand FROM part)")
def wide_lookup(spark, d):
    path = scratch(spark, "wide")
    b = table(spark, d, "part").select("p_brand").distinct()
    b.select(F.col("p_brand").alias("ID"), F.concat(F.lit("a "), "p_brand", F.lit(", b "), "p_brand").alias("INT"), F.lit("c").alias("ACT"), F.lit(None).cast("string").alias("SOC")).write.option("header", True).option("sep", ";").csv(path)
    return files.read_wide_lookup(spark, path)


@query("S8_lookup", "SELECT n_regionkey::VARCHAR AS region, count(*) AS n, min(n_name) AS first_name FROM nation GROUP BY n_regionkey")
def lookup(spark, d):
    path = scratch(spark, "lookup")
    table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).write.option("header", True).option("sep", ";").csv(path)
    return files.read_lookup(spark, path, "region").select("region", F.size("rows").cast("long").alias("n"), F.col("rows")[0]["name"].alias("first_name"))


@query("S17_taxonomy_leaves", oracle("SELECT c.category_id, c.name, p.name AS parent FROM fx_category c LEFT JOIN fx_category p ON c.parent_id = p.category_id WHERE c.category_id NOT IN (SELECT parent_id FROM fx_category)"))
def taxonomy_leaves(spark, d):
    return files.taxonomy_leaves(view(spark, d, "fx_category"))


@query("S19_pending_ids", oracle("SELECT DISTINCT venue_id FROM fx_checkin WHERE venue_id NOT IN (SELECT venue_id FROM fx_score)"))
def pending_ids(spark, d):
    return files.pending(view(spark, d, "fx_checkin"), view(spark, d, "fx_score"), "venue_id")


@query("S18_cells", oracle("SELECT venue_id, round(lat - 0.25, 6) AS south, round(lon - 0.25, 6) AS west, round(lat + 0.25, 6) AS north, round(lon + 0.25, 6) AS east FROM fx_venue"))
def cells(spark, d):
    """Failed searches as URLs, with their corners in either order."""
    at = lambda name, i: F.concat(F.lit(f"{name}="), F.format_string("%.6f", F.col("lat") + i * 0.25), F.lit(","), F.format_string("%.6f", F.col("lon") + i * 0.25))
    sw, ne = at("sw", -1), at("ne", 1)
    url = F.concat(F.lit("http://h/search?"), F.when(F.col("venue_id") % 2 == 0, F.concat_ws("&", sw, ne)).otherwise(F.concat_ws("&", ne, sw)))
    return view(spark, d, "fx_venue").select("venue_id", files.parse_cells(url).alias("c")).select("venue_id", "c.*")


@query("S20_features", oracle("""WITH t AS (SELECT v.user_id, v.place_id, v.departure - v.arrival AS dur, p.lat, p.lon, p.name, v.day_no, v.visit_id FROM fx_visit v JOIN fx_place p ON v.user_id = p.user_id AND v.place_id = p.place_id),
a AS (SELECT 'all' AS kind, NULL AS user_id, place_id AS id, any_value(lat) AS lat, any_value(lon) AS lon, '"dur":' || sum(dur) || ',"nb_visits":' || count(*) AS props FROM t GROUP BY place_id
UNION ALL SELECT 'user', user_id, place_id, any_value(lat), any_value(lon), '"dur":' || sum(dur) || ',"nb_visits":' || count(*) FROM t GROUP BY user_id, place_id
UNION ALL SELECT 'visit', user_id, visit_id, lat, lon, '"dur":' || dur || ',"label":"' || name || '"' FROM t
UNION ALL SELECT 'point', user_id, ts_local, lat, lon, '"ts":' || ts_local || ',"label":"' || strftime(make_timestamp(ts_local * 1000000), '%H:%M') || '"' FROM fx_trace WHERE day_no = 1)
SELECT kind, user_id, id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || printf('%.6f,%.6f', lon, lat) || ']},"properties":{' || props || '}}' AS feature FROM a""", "fx_visit", "fx_place", "fx_trace"))
def features(spark, d):
    """Features of places over all users and of each user, of visits with their place's name, and of a day's points with their time."""
    p = view(spark, d, "fx_place").select("user_id", "place_id", "lat", "lon", "name")
    t = view(spark, d, "fx_visit").join(p, ["user_id", "place_id"]).withColumn("dur", F.col("departure") - F.col("arrival"))
    at = [F.first("lat").alias("lat"), F.first("lon").alias("lon")]  # all of a place's rows have the same
    totals = [F.sum("dur").alias("dur"), F.count("*").alias("nb_visits")]
    made = lambda df, kind, user, id_, *props: df.select(F.lit(kind).alias("kind"), user.cast("long").alias("user_id"), F.col(id_).alias("id"), files.feature(F.struct(*props), F.col("lon").cast("decimal(9,6)"), F.col("lat").cast("decimal(9,6)")).alias("feature"))
    every = made(t.groupBy("place_id").agg(*at, *totals), "all", F.lit(None), "place_id", "dur", "nb_visits")
    users = made(t.groupBy("user_id", "place_id").agg(*at, *totals), "user", F.col("user_id"), "place_id", "dur", "nb_visits")
    visits = made(t, "visit", F.col("user_id"), "visit_id", "dur", F.col("name").alias("label"))
    points = made(view(spark, d, "fx_trace").filter("day_no = 1"), "point", F.col("user_id"), "ts_local", F.col("ts_local").alias("ts"), x.hour_minute(F.col("ts_local")).alias("label"))
    return every.unionByName(users).unionByName(visits).unionByName(points)


@query("S20_collections", oracle("SELECT user_id, len(collection) AS size, starts_with(collection, '{\"type\":\"FeatureCollection\",\"features\":[{\"type\":\"Feature\"') AS whole FROM (SELECT user_id, '{\"type\":\"FeatureCollection\",\"features\":[' || string_agg('{\"type\":\"Feature\",\"geometry\":{\"type\":\"Point\",\"coordinates\":[' || printf('%.6f,%.6f', lon, lat) || ']},\"properties\":{\"nb_visits\":' || nb_visits || '}}', ',') || ']}' AS collection FROM fx_place GROUP BY user_id)"))
def collections(spark, d):
    """A collection of features for each user, whose places are bounded in number."""
    p = view(spark, d, "fx_place")
    f = p.select("user_id", "place_id", files.feature(F.struct("nb_visits"), F.col("lon").cast("decimal(9,6)"), F.col("lat").cast("decimal(9,6)")).alias("feature"))
    c = f.groupBy("user_id").agg(files.collection(F.col("place_id"), F.col("feature")).alias("collection"))
    head = '{"type":"FeatureCollection","features":[{"type":"Feature"'
    return c.select("user_id", F.length("collection").cast("long").alias("size"), F.startswith("collection", F.lit(head)).alias("whole"))


@query("S21_user_export", oracle("SELECT 'visits' AS kind, user_id, count(*) AS n, min(arrival) AS first FROM fx_visit GROUP BY user_id UNION ALL SELECT 'places', user_id, count(*), min(place_id) FROM fx_place GROUP BY user_id UNION ALL SELECT 'moves', user_id, count(*), min(arrival) FROM (SELECT user_id, arrival, lag(departure) OVER (PARTITION BY user_id, day_no ORDER BY arrival, visit_id) AS l FROM fx_visit) WHERE l IS NOT NULL GROUP BY user_id UNION ALL SELECT 'interests', session_id, count(*), min(place_id) FROM fx_rating GROUP BY session_id UNION ALL SELECT 'traces', user_id, count(*), min(ts_local) FROM fx_trace GROUP BY user_id"))
def user_export(spark, d):
    """A folder of JSON for each user and kind of data, read back as one table."""
    from mobtrace.operators import stays

    v = view(spark, d, "fx_visit")
    tables = {
        "visits": (v, "arrival"), "places": (view(spark, d, "fx_place"), "place_id"), "moves": (stays.moves(v), "arrived_at"),
        "interests": (view(spark, d, "fx_rating").withColumnRenamed("session_id", "user_id"), "place_id"), "traces": (view(spark, d, "fx_trace"), "ts_local"),
    }
    path, every = scratch(spark, "export"), None
    for kind, (df, first) in tables.items():
        rows = df.select(F.lit(kind).alias("kind"), "user_id", F.col(first).cast("long").alias("first"), F.to_json(F.struct(*[c for c in df.columns if c != "user_id"])).alias("row"))
        every = rows if every is None else every.unionByName(rows)
    # a folder's rows come together, so it has one file (several if it is large); tasks move their files in, not the driver one by one
    every = every.hint("rebalance", "user_id", "kind").sortWithinPartitions("user_id", "kind")
    every.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("user_id", "kind").json(path)
    back = spark.read.schema("row string, first long, user_id long, kind string").json(path)
    return back.filter("row is not null").groupBy("kind", "user_id").agg(F.count("*").alias("n"), F.min("first").alias("first"))


@query("S22_predictions_written", oracle("SELECT venue_id, pi_id, 'pi, \"' || pi_id || '\"' AS name, round(max(score), 6) AS score FROM fx_score GROUP BY venue_id, pi_id"))
def predictions_written(spark, d):
    path = scratch(spark, "predicted")
    s = view(spark, d, "fx_score").groupBy("venue_id", "pi_id").agg(F.round(F.max("score"), 6).alias("score"))
    s.select("venue_id", "pi_id", F.concat(F.lit('pi, "'), "pi_id", F.lit('"')).alias("name"), "score").write.option("escape", '"').csv(path)
    return spark.read.schema("venue_id long, pi_id long, name string, score double").option("escape", '"').csv(path)


@query("S23_category_dump", oracle("SELECT c.name, coalesce(p.name, '') AS parent, c.category_id FROM fx_category c LEFT JOIN fx_category p ON c.parent_id = p.category_id"))
def category_dump(spark, d):
    path = scratch(spark, "categories")
    c = view(spark, d, "fx_category")
    up = c.select(F.col("category_id").alias("parent_id"), F.col("name").alias("parent"))
    c.join(up, "parent_id", "left").select("name", F.coalesce("parent", F.lit("")).alias("parent"), "category_id").write.option("sep", ";").csv(path)
    return spark.read.schema("name string, parent string, category_id string").option("sep", ";").csv(path).fillna("", ["parent"])


@query("S24_boxes_as_text", oracle("SELECT venue_id, printf('POLYGON((%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f,%.6f %.6f))', lon - 0.25, lat - 0.25, lon - 0.25, lat + 0.25, lon + 0.25, lat + 0.25, lon + 0.25, lat - 0.25, lon - 0.25, lat - 0.25) AS wkt FROM fx_venue"))
def boxes_as_text(spark, d):
    a, o = F.col("lat"), F.col("lon")
    return view(spark, d, "fx_venue").select("venue_id", geo.box_to_wkt(a - 0.25, o - 0.25, a + 0.25, o + 0.25).alias("wkt"))
