"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mobtrace.fixtures import oracle, table, view
from mobtrace.functions import geo
from mobtrace.functions import scalars as x
from mobtrace.plans.registry import query


@query("X1_title_case", """
SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'YES' ELSE array_to_string(list_transform(string_split(p_name || ' of THE ' || p_type || ' yes on', ' '), lambda w, i: CASE WHEN i > 1 AND w IN ('a','an','of','the','is','and','at','in','on','yes') THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ') END AS title FROM part""")
def title_case(spark, d):
    text = F.when(F.col("p_partkey") % 50 == 0, "YES").otherwise(F.concat("p_name", F.lit(" of THE "), "p_type", F.lit(" yes on")))
    return table(spark, d, "part").select("p_partkey", x.title_case(text).alias("title"))


@query("X2_numbers", """
SELECT p_partkey, try_cast(p_name AS DOUBLE) IS NOT NULL AS name_is_number, try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE) IS NOT NULL AS brand_is_number, regexp_matches(p_brand, '[0-9]') AS has_digit FROM part""")
def numbers(spark, d):
    number = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit(""))
    return table(spark, d, "part").select("p_partkey", x.is_number(F.col("p_name")).alias("name_is_number"), x.is_number(number).alias("brand_is_number"), x.has_digit(F.col("p_brand")).alias("has_digit"))


@query("X3_decode_cells", oracle("""
WITH c AS (SELECT category_id, parent_id || '[' || name || ';' || category_id || ']' AS cell FROM fx_category)
SELECT category_id, regexp_extract(cell, '^([^\\[]*)', 1) AS category, string_split(regexp_extract(cell, '\\[(.*)\\]', 1), ';') AS keys FROM c"""))
def decode_cells(spark, d):
    cell = F.concat("parent_id", F.lit("["), "name", F.lit(";"), "category_id", F.lit("]"))
    return view(spark, d, "fx_category").select("category_id", x.decode_cell(cell).alias("c")).select("category_id", "c.*")


@query("X4_tokens", """
SELECT doc_id, len(t) AS n_tokens, t[1] AS first_token, list_sort(list_distinct(t))[1] AS least_token
FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda w: w <> '') AS t FROM documents)""")
def tokens(spark, d):
    docs = table(spark, d, "documents").select("doc_id", x.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.get("t", F.lit(0)).alias("first_token"), F.array_min("t").alias("least_token"))


@query("X5_names_from_uris", """
SELECT page_id, replace(regexp_extract('<' || url || '/A_name_' || page_id || '>', '([^/#<>]*)>$', 1), '_', ' ') AS name FROM pages""")
def names_from_uris(spark, d):
    uri = F.concat(F.lit("<"), "url", F.lit("/A_name_"), "page_id", F.lit(">"))
    return table(spark, d, "pages").select("page_id", x.name_from_uri(uri).alias("name"))


TRIGRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("X6_trigram_similarity", f"""
WITH p AS (SELECT p_partkey, {TRIGRAMS.format("p_name")} AS a, {TRIGRAMS.format("p_type")} AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) AS similarity, round(len(list_intersect(a, b))::DOUBLE / len(a), 6) AS contained FROM p""")
def trigram_similarity(spark, d):
    p = table(spark, d, "part").select("p_partkey", x.trigrams(F.col("p_name")).alias("a"), x.trigrams(F.col("p_type")).alias("b"))
    return p.select("p_partkey", F.round(x.similarity(F.col("a"), F.col("b")), 6).alias("similarity"), F.round(x.containment(F.col("a"), F.col("b")), 6).alias("contained"))


@query("X10_local_and_utc", oracle("""
SELECT visit_id, arrival AS utc, arrival - utc_offset AS local, utc_offset AS offset_s FROM fx_visit"""))
def local_and_utc(spark, d):
    """Texts are built from the views' numbers and parsed back."""
    v = view(spark, d, "fx_visit")
    wall = F.date_format(F.timestamp_seconds(F.col("arrival") - F.col("utc_offset")), "yyyy-MM-dd HH:mm:ss")
    zone = F.format_string("%s%02d00", F.when(F.col("utc_offset") > 0, "-").otherwise("+"), (F.col("utc_offset") / 3600).cast("int"))
    t = v.select("visit_id", x.local_and_utc(F.concat_ws(" ", wall, zone)).alias("t"))
    return t.select("visit_id", F.col("t.utc").cast("long").alias("utc"), F.col("t.local").cast("long").alias("local"), F.col("t.offset").cast("long").alias("offset_s"))


@query("X11_days", oracle("""
SELECT visit_id, strftime(make_timestamp(arrival * 1000000), '%Y-%m-%d') AS day, arrival - arrival % 86400 AS day_start, arrival % 86400 AS second, isodow(make_timestamp(arrival * 1000000)) >= 6 AS weekend,
  strftime(make_timestamp(arrival * 1000000), '%H:%M') AS hhmm, strftime(make_timestamp((arrival - 86400) * 1000000), '%Y-%m-%d') AS previous, arrival - arrival % 86400 + 86400 AS next_start FROM fx_visit"""))
def days(spark, d):
    a = F.col("arrival")
    return view(spark, d, "fx_visit").select("visit_id", x.day_text(a).alias("day"), x.start_of_day(a).alias("day_start"), x.seconds_of_day(a).alias("second"), x.is_weekend(a).alias("weekend"), x.hour_minute(a).alias("hhmm"), x.day_text(a - 86400).alias("previous"), (x.start_of_day(a) + 86400).alias("next_start"))


@query("X12_seconds_in_hours", oracle("""
WITH v AS (SELECT *, arrival - arrival % 86400 AS d FROM fx_visit)
SELECT visit_id, greatest(0, least(departure, d + 7 * 3600 + 3599) - greatest(arrival, d)) + greatest(0, least(departure, d + 23 * 3600 + 3599) - greatest(arrival, d + 20 * 3600)) AS home_s,
  greatest(0, least(departure, d + 18 * 3600 + 3599) - greatest(arrival, d + 9 * 3600)) AS work_s FROM v"""))
def seconds_in_hours(spark, d):
    a, b = F.col("arrival"), F.col("departure")
    return view(spark, d, "fx_visit").select("visit_id", x.seconds_in_hours(a, b, [(0, 7), (20, 23)]).alias("home_s"), x.seconds_in_hours(a, b, [(9, 18)]).alias("work_s"))


@query("X13_haversine", oracle("""
SELECT venue_id, round(2 * 6378137.0 * asin(sqrt(pow(sin(radians(51.5 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(51.5)) * pow(sin(radians(-0.1 - lon) / 2), 2))), 4) AS metres FROM fx_venue"""))
def haversine(spark, d):
    return view(spark, d, "fx_venue").select("venue_id", F.round(geo.haversine(F.col("lat"), F.col("lon"), F.lit(51.5), F.lit(-0.1)), 4).alias("metres"))


@query("X14_bounding_boxes", oracle("""
WITH r AS (SELECT *, sqrt((pow(pow(6378137.0, 2) * cos(radians(lat)), 2) + pow(pow(6356752.3, 2) * sin(radians(lat)), 2)) / (pow(6378137.0 * cos(radians(lat)), 2) + pow(6356752.3 * sin(radians(lat)), 2))) AS r FROM fx_venue)
SELECT venue_id, round(r, 3) AS radius, round(lat - degrees(250 / r), 8) AS south, round(lon + degrees(250 / (r * cos(radians(lat)))), 8) AS east FROM r"""))
def bounding_boxes(spark, d):
    v = view(spark, d, "fx_venue").withColumn("b", geo.bounding_box(F.col("lat"), F.col("lon"), 250.0))
    return v.select("venue_id", F.round(geo.radius_at(F.col("lat")), 3).alias("radius"), F.round("b.south", 8).alias("south"), F.round("b.east", 8).alias("east"))


@query("X15_cell_corners", oracle("""
WITH b AS (SELECT floor(lat * 20) / 20 AS south, floor(lon * 20) / 20 AS west, count(*) AS n FROM fx_venue GROUP BY ALL)
SELECT round(south + dy * 0.025, 6) AS south, round(west + dx * 0.025, 6) AS west, round(south + dy * 0.025 + 0.025, 6) AS north, round(west + dx * 0.025 + 0.025, 6) AS east, n FROM b, (VALUES (0), (1)) y(dy), (VALUES (0), (1)) x(dx)"""))
def cell_corners(spark, d):
    """Each occupied cell is split in four."""
    cells = view(spark, d, "fx_venue").groupBy((F.floor(F.col("lat") * 20) / 20).alias("s"), (F.floor(F.col("lon") * 20) / 20).alias("w")).agg(F.count("*").alias("n"))
    quarter = cells.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("dy")).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("dx"))
    s, w = F.col("s") + F.col("dy") * 0.025, F.col("w") + F.col("dx") * 0.025
    return quarter.select(F.round(s, 6).alias("south"), F.round(w, 6).alias("west"), F.round(s + 0.025, 6).alias("north"), F.round(w + 0.025, 6).alias("east"), "n")


#: Metres from a point, here and in SQL; planar, in Web Mercator.
FROM_CENTRE = "sqrt(pow(6378137.0 * radians(lon) - 6378137.0 * radians(-0.1), 2) + pow(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)) - 6378137.0 * ln(tan(pi() / 4 + radians(51.5) / 2)), 2))"


def from_centre():
    at = lambda lat, lon: (geo.mercator_x(lon), geo.mercator_y(lat))
    return geo.planar_distance(*at(F.lit(51.5), F.lit(-0.1)), *at(F.col("lat"), F.col("lon")))


@query("X16_place_score", oracle(f"""
SELECT venue_id, round(0.1 * nb_checkins / max(nb_checkins) OVER (PARTITION BY leaf_category) + 1.5 / sqrt(CASE WHEN m = 0 THEN 1 ELSE m END), 6) AS score
FROM (SELECT *, round({FROM_CENTRE}, 3) AS m FROM fx_venue) ORDER BY score DESC, venue_id"""))
def place_score(spark, d):
    v = view(spark, d, "fx_venue").withColumn("m", F.round(from_centre(), 3))
    top = v.groupBy("leaf_category").agg(F.max("nb_checkins").alias("top"))
    score = 0.1 * F.col("nb_checkins") / F.col("top") + 1.5 / F.sqrt(F.when(F.col("m") == 0, 1).otherwise(F.col("m")))
    return v.join(top, "leaf_category").select("venue_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "venue_id")


@query("X17_search_score", oracle(f"""
WITH s AS (SELECT venue_id, (1 + 50 * pow(0.5, pow(m / 100, 2)) + 15 * log10(1 + 2 * CASE WHEN nb_checkins = 0 THEN 1 ELSE nb_checkins END)) / 2 AS raw FROM (SELECT *, round({FROM_CENTRE}, 3) AS m FROM fx_venue) WHERE starts_with(name, 'blue') AND m <= 5000)
SELECT venue_id, round(raw / (SELECT max(raw) FROM s), 6) AS score FROM s"""))
def search_score(spark, d, typed: str = "blue", reach: float = 5000.0):
    """Names with a prefix, in reach: a Gaussian decay of a half at 100 m and log popularity, averaged with the text's score of 1; normalised by the greatest."""
    v = view(spark, d, "fx_venue").withColumn("m", F.round(from_centre(), 3)).filter(F.startswith("name", F.lit(typed)) & (F.col("m") <= reach))
    n = F.when(F.col("nb_checkins") == 0, 1).otherwise(F.col("nb_checkins"))
    raw = (1 + 50 * F.pow(F.lit(0.5), F.pow(F.col("m") / 100, 2)) + 15 * F.log10(1 + 2 * n)) / 2
    s = v.select("venue_id", raw.alias("raw"))
    return s.crossJoin(F.broadcast(s.agg(F.max("raw").alias("top")))).select("venue_id", F.round(F.col("raw") / F.col("top"), 6).alias("score"))  # one row is sent


@query("X18_mercator", oracle("""
SELECT venue_id, round(6378137.0 * radians(lon), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM fx_venue"""))
def mercator(spark, d):
    return view(spark, d, "fx_venue").select("venue_id", F.round(geo.mercator_x(F.col("lon")), 3).alias("x"), F.round(geo.mercator_y(F.col("lat")), 3).alias("y"))


@query("X20_full_address", """
SELECT c_custkey, c_name || CASE WHEN trim(c_mktsegment) <> '' THEN ', ' || trim(c_mktsegment) ELSE '' END AS address FROM customer""")
def full_address(spark, d):
    return table(spark, d, "customer").select("c_custkey", x.full_address(F.col("c_name"), F.lit(" "), F.col("c_mktsegment"), F.lit(None).cast("string")).alias("address"))


PALETTE = ("#e41a1c", "#377eb8", "#4daf4a", "#984ea3", "#ff7f00")


@query("X21_colours", f"""
SELECT p_partkey, {list(PALETTE)}[(length(p_name) % 5 + 1)::INTEGER] AS colour FROM part""")
def colours(spark, d):
    return table(spark, d, "part").select("p_partkey", x.colour(F.col("p_name"), PALETTE).alias("colour"))


@query("X22_venue_icons", oracle("""
WITH leaf AS (SELECT category_id, name FROM fx_category c WHERE NOT EXISTS (SELECT 1 FROM fx_category k WHERE k.parent_id = c.category_id))
SELECT venue_id, coalesce(l.name, e.name, 'default') AS icon FROM fx_venue v LEFT JOIN leaf l ON v.leaf_category = l.category_id LEFT JOIN fx_category e ON v.extra_category = e.category_id"""))
def venue_icons(spark, d):
    """The last category that is a leaf, else the first, else a default."""
    c = view(spark, d, "fx_category")
    inner = c.select(F.col("parent_id").alias("category_id")).distinct()
    named = c.join(inner.withColumn("inner", F.lit(True)), "category_id", "left").select("category_id", F.col("name").alias("icon"), F.col("inner").isNull().alias("leaf"))
    v = view(spark, d, "fx_venue").select("venue_id", F.posexplode(F.array("extra_category", "leaf_category")).alias("place", "category_id"))
    by = v.join(named, "category_id", "left").groupBy("venue_id").agg(F.max_by(F.when(F.col("leaf"), F.col("icon")), F.when(F.col("leaf"), F.col("place"))).alias("last_leaf"), F.min_by("icon", F.when(F.col("icon").isNotNull(), F.col("place"))).alias("first"))
    return by.select("venue_id", F.coalesce("last_leaf", "first", F.lit("default")).alias("icon"))


@query("X24_leaves_and_depth", oracle("""
WITH RECURSIVE t AS (SELECT category_id, 0 AS depth FROM fx_category WHERE parent_id = '' UNION ALL SELECT c.category_id, depth + 1 FROM fx_category c JOIN t ON c.parent_id = t.category_id)
SELECT category_id, depth::BIGINT AS depth, category_id NOT IN (SELECT parent_id FROM fx_category) AS leaf FROM t""").replace("WITH fx_category", "WITH RECURSIVE fx_category").replace(",\nRECURSIVE t", ",\nt"))
def leaves_and_depth(spark, d):
    from mobtrace.operators.trees import paths

    c = view(spark, d, "fx_category")
    inner = c.select(F.col("parent_id").alias("of")).distinct()
    deep = paths(c).select("category_id", F.size("ids").cast("long").alias("n"))
    return deep.join(inner, F.col("of") == F.col("category_id"), "left").select("category_id", (F.col("n") - 1).alias("depth"), F.col("of").isNull().alias("leaf"))


@query("X25_primary_and_phrase", """
SELECT p_partkey, string_split(p_type, ' ')[1] AS first_word, replace(lower(p_type), ' ', '_') AS phrase FROM part""")
def primary_and_phrase(spark, d):
    words = F.split("p_type", " ")
    return table(spark, d, "part").select("p_partkey", F.filter(words, lambda w: w != "")[0].alias("first_word"), F.array_join(F.split(F.lower("p_type"), " "), "_").alias("phrase"))
