"""Nested JSON, triples, polygons and logs, written from the views and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from mobtrace.fixtures import oracle, table, view
from mobtrace.functions import scalars as x
from mobtrace.operators import interests, spatial
from mobtrace.plans.joins import boxes
from mobtrace.plans.registry import query
from mobtrace.sources import files
from mobtrace.sources.scratch import scratch


def lines(spark, df, name):
    """Writes one text column and reads it again as ``value``."""
    path = scratch(spark, name)
    df.toDF("value").write.text(path)
    return spark.read.text(path)


@query("S3_logs", oracle("SELECT 'u7' AS user_id, '2024-01-01' AS day, arrival AS ts, 's' || place_id AS session, CASE WHEN visited THEN place_id END AS place FROM fx_visit WHERE deleted IS NOT NULL"))
def logs(spark, d):
    """Bars quote; rows with bad times go; bad arguments become an empty object."""
    v = view(spark, d, "fx_visit")
    stamp = F.when(F.col("deleted").isNull(), "no time").otherwise(F.date_format(F.timestamp_seconds("arrival"), "yyyy-MM-dd HH:mm:ss"))
    args = F.when(F.col("visited"), F.concat(F.lit('{"place": '), "place_id", F.lit(', "x": "a,b"}'))).otherwise("{broken")
    folder = scratch(spark, "logs")
    number = F.pmod("place_id", F.lit(3)).cast("string")
    rows = v.select(F.concat(F.lit("u7_2024-01-01_"), number, F.lit("_log.csv")).alias("name"), F.lit("u7").alias("User"), stamp.alias("Timestamp"), F.concat(F.lit("s"), "place_id").alias("Session"), F.lit("t").alias("Type"), args.alias("Args"))
    rows.repartition("name").write.partitionBy("name").option("header", True).option("quote", "|").option("quoteAll", True).csv(folder)
    out = files.read_logs(spark, folder)
    return out.select("user_id", "day", "ts", "session", F.try_variant_get("args", "$.place", "long").alias("place"))


def triples(spark, d):
    v = view(spark, d, "fx_venue")
    s = F.concat(F.lit("<http://kb/Venue_"), "venue_id", F.lit(">"))
    row = lambda p, o: F.concat_ws(" ", s, F.lit(f"<http://kb/{p}>"), o, F.lit("."))
    each = F.array(row("geo/lat", F.concat(F.lit('"'), F.format_string("%.4f", "lat"), F.lit('"'))), row("geo/long", F.format_string("%.4f", "lon")), row("type", F.concat(F.lit("<"), "leaf_category", F.lit(">"))), row("type", F.concat(F.lit("<"), "extra_category", F.lit(">"))))
    text = v.select(F.explode(F.when(F.col("nb_checkins") > 20, each).otherwise(F.slice(each, 2, 3))).alias("value"))
    path = scratch(spark, "triples")
    text.unionByName(spark.range(1).select(F.lit("# a comment").alias("value"))).write.text(path)
    return files.read_triples(spark, path)


@query("S9_triples", oracle("SELECT count(DISTINCT venue_id) AS subjects, sum(CASE WHEN nb_checkins > 20 THEN 3 ELSE 2 END)::BIGINT AS rows, sum(CASE WHEN nb_checkins > 20 THEN 4 ELSE 3 END)::BIGINT AS objects FROM fx_venue"))
def read_triples(spark, d):
    return triples(spark, d).agg(F.count_distinct("subject").alias("subjects"), F.count("*").alias("rows"), F.sum(F.size("objects")).alias("objects"))


@query("S10_kb_places", oracle("SELECT 'http://kb/Venue_' || venue_id AS uri, 'Venue ' || venue_id AS name, round(lat, 4) AS lat, round(lon, 4) AS lon, least(leaf_category, extra_category) AS type_uri FROM fx_venue WHERE nb_checkins > 20"))
def kb_places(spark, d):
    return files.kb_places(triples(spark, d)).select("uri", "name", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "type_uri")


@query("S11_census", "SELECT 'E' || n_nationkey AS geo_code, CASE WHEN n_regionkey <> 2 THEN n_name ELSE 'old' END AS label, CASE WHEN n_regionkey <> 2 THEN (n_nationkey * 10)::DOUBLE ELSE -1.0::DOUBLE END AS total FROM nation")
def census(spark, d):
    """Two header rows; only rows of one geography type change the tracts."""
    n = table(spark, d, "nation")
    kind = F.when(F.col("n_regionkey") == 2, "Ward").otherwise("Tract")
    text = n.select(F.concat_ws(",", "n_nationkey", F.concat(F.lit("E"), "n_nationkey"), "n_name", kind, F.lit("X"), F.col("n_nationkey") * 10).alias("value"))
    heads = spark.range(1).select(F.explode(F.array(F.lit("CDU_ID,GEO_CODE,GEO_LABEL,GEO_TYPE,GEO_TYP2,F1"), F.lit(",,,,,Total"))).alias("value"))
    tracts = n.select(F.concat(F.lit("E"), "n_nationkey").alias("geo_code"), F.lit("old").alias("label"), F.lit(-1.0).alias("total"))
    return files.census_tracts(lines(spark, heads.unionByName(text), "census"), tracts, "Tract")


@query("S12_polygons", oracle("SELECT extra_category AS polygon_id, 5::BIGINT AS n_points, round(min(lon) - 0.0051, 6) AS west, round(min(lat) + 0.0249, 6) AS north FROM fx_venue GROUP BY extra_category"))
def polygons(spark, d):
    """Rings as WKT text and back; the identifier stands before a tab."""
    b = boxes(spark, d)
    wkt = F.concat(F.lit("POLYGON(("), F.array_join(F.transform("ring", lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])), ","), F.lit("))"))
    t = lines(spark, b.select(F.concat_ws("\t", "polygon_id", wkt)), "polygons").select(F.split("value", "\t").alias("c"))
    p = spatial.boxed(t.select(F.col("c")[0].alias("polygon_id"), F.explode(files.polygons(F.col("c")[1])).alias("ring")))
    return p.select("polygon_id", F.size("ring").cast("long").alias("n_points"), F.round("x1", 6).alias("west"), F.round("y2", 6).alias("north"))


@query("F12_polygons_kept", oracle("WITH b AS (SELECT extra_category, (max(lon) - min(lon) + 0.01) AS w, min(venue_id) AS m FROM fx_venue GROUP BY extra_category) SELECT extra_category AS polygon_id FROM b WHERE w * 0.03 * 1e6 < 6100 AND (m % 3 = 0 OR m % 2 = 0) AND m % 5 <> 0"))
def polygons_kept(spark, d):
    """Polygons with a name or a house name, without an administrative level, below an area by the shoelace formula."""
    area = F.aggregate(F.sequence(F.lit(0), F.size("ring") - 2), F.lit(0.0), lambda s, i: s + F.get("ring", i)["x"] * F.get("ring", i + 1)["y"] - F.get("ring", i + 1)["x"] * F.get("ring", i)["y"])
    v = view(spark, d, "fx_venue").groupBy(F.col("extra_category").alias("polygon_id")).agg(F.min("venue_id").alias("m"))
    tagged = v.select("polygon_id", F.when(F.col("m") % 3 == 0, "name").alias("name"), F.when(F.col("m") % 2 == 0, "house").alias("house"), F.when(F.col("m") % 5 == 0, 8).alias("level"))
    p = boxes(spark, d).join(tagged, "polygon_id").filter("(name is not null or house is not null) and level is null")
    return p.withColumn("area", F.abs(area) / 2).filter(F.col("area") * 1e6 < 6100).select("polygon_id")


def venue_json(spark, d):
    v = view(spark, d, "fx_venue")
    category = F.array(F.struct(F.col("leaf_category").alias("id")), F.struct(F.col("extra_category").alias("id")))
    chain = F.when(F.col("nb_checkins") > 250, F.array(F.struct(F.concat(F.lit("ch"), "extra_category").alias("id"), F.lit("Chain").alias("name"), F.struct(F.lit("http://l/").alias("prefix"), F.col("extra_category").alias("name")).alias("logo"))))
    nested = F.struct(
        F.col("venue_id").cast("string").alias("id"), F.when(F.col("venue_id") % 3 > 0, F.col("name")).alias("name"), F.struct(F.col("lat"), F.col("lon").alias("lng")).alias("location"),
        category.alias("categories"), F.struct(F.col("nb_checkins").alias("checkinsCount")).alias("stats"), F.when(F.col("venue_id") % 10 == 0, F.concat(F.lit("r"), "venue_id")).alias("redirect"), chain.alias("chains"),
    )
    return lines(spark, v.select(F.to_json(nested)), "venues")


@query("S13_venues", oracle("WITH v AS (SELECT CAST(venue_id AS VARCHAR) AS venue_id, CASE WHEN venue_id % 3 > 0 THEN name ELSE '' END AS name, [leaf_category, extra_category] AS categories, nb_checkins::BIGINT AS nb_checkins, 0::BIGINT AS nb_tips, venue_id % 10 = 0 AS r FROM fx_venue) SELECT venue_id, name, categories, nb_checkins, nb_tips, '' AS redirect_venue_id FROM v UNION ALL SELECT 'r' || venue_id, name, categories, nb_checkins, nb_tips, 'copy' FROM v WHERE r"))
def venues(spark, d):
    return files.normalise_venues(venue_json(spark, d)).select("venue_id", "name", "categories", "nb_checkins", "nb_tips", "redirect_venue_id")


@query("S14_chains", oracle("SELECT DISTINCT 'ch' || extra_category AS chain_id, 'Chain' AS name, 'http://l/' || extra_category AS logo_url FROM fx_venue WHERE nb_checkins > 250"))
def chains(spark, d):
    return files.venue_chains(venue_json(spark, d))


@query("S15_categories", oracle("SELECT category_id, parent_id, name FROM fx_category"))
def categories(spark, d):
    """The tree is nested from its leaves up, written as JSON and flattened again."""
    c = view(spark, d, "fx_category")
    rows = c.select("category_id", "parent_id", F.struct(F.col("category_id").alias("id"), "name").alias("node"))
    leaf = rows.filter("category_id like 'b%'").groupBy(F.col("parent_id").alias("up")).agg(F.collect_list("node").alias("categories"))
    middle = rows.filter("category_id like 'n%'").join(leaf, F.col("category_id") == F.col("up"), "left").select("parent_id", F.struct("node.id", "node.name", "categories").alias("node"))
    middle = middle.groupBy(F.col("parent_id").alias("up")).agg(F.collect_list("node").alias("categories"))
    top = rows.filter("category_id like 'r%'").join(middle, F.col("category_id") == F.col("up"), "left").select(F.to_json(F.array(F.struct("node.id", "node.name", "categories"))))
    return files.flatten_categories(lines(spark, top, "tree"))


@query("S16_tips", oracle("SELECT CAST(tip_id AS VARCHAR) AS tip_id, text, tip_id % 5 AS nb_likes, CAST(author_id AS VARCHAR) AS user_id, [lang] AS entities FROM fx_tip"))
def tips(spark, d):
    t = view(spark, d, "fx_tip")
    entities = F.array(F.struct(F.col("lang").alias("text"), F.lit("l").alias("type")), F.struct(F.lit(None).cast("string").alias("text"), F.lit("n").alias("type")))
    nested = F.struct(F.col("tip_id").cast("string").alias("id"), "text", F.struct((F.col("tip_id") % 5).alias("count")).alias("likes"), F.struct(F.col("author_id").cast("string").alias("id")).alias("user"), entities.alias("entities"))
    return files.normalise_tips(lines(spark, t.select(F.to_json(nested)), "tips")).select("tip_id", "text", "nb_likes", "user_id", "entities")


@query("X8_similar_names")
def similar_names(spark, d):
    """Pairs of names of one size that resemble each other, or differ by one root word on either side."""
    name = F.concat_ws(" ", "p_name", F.lit("of"), F.lower("p_type"))
    t = table(spark, d, "part").select("p_size", name.alias("name")).distinct()
    return interests.similar_pairs(t, ["p_size"], "name", ["ring", "bolt", "gear"])


@query("X23_tags", oracle("SELECT venue_id, 'Road ' || extra_category || ' ' || nb_checkins AS address FROM fx_venue"))
def tags(spark, d):
    text = F.concat(F.lit('"addr:street"=>"Road '), "extra_category", F.lit('", "addr:housenumber"=>"'), "nb_checkins", F.lit('"'))
    t = view(spark, d, "fx_venue").select("venue_id", x.parse_tags(text).alias("t"))
    return t.select("venue_id", F.concat_ws(" ", F.element_at("t", "addr:street"), F.element_at("t", "addr:housenumber")).alias("address"))
