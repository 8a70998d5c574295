"""Readers of the files that mobility data come in. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mobtrace.functions import scalars as x

TRACE = ("user", "lat", "lon", "timestamp", "accuracy", "targetaccuracy", "speed", "nbsteps", "activity", "activityconfidence", "ssid", "batterylevel", "batterycharge")


def traces_from(raw: DataFrame) -> DataFrame:
    """Rows of trace files as points: blank users skipped, defaults for blanks, times and day derived."""
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    raw = raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in TRACE])
    number = lambda c, kind, default: F.coalesce(F.col(c).try_cast(kind), F.lit(default).cast(kind))
    t = raw.filter(F.trim("user") != "").withColumn("t", x.local_and_utc(F.col("timestamp")))
    return t.select(
        F.trim("user").alias("user_id"), number("lat", "double", 0).alias("lat"), number("lon", "double", 0).alias("lon"), F.col("t.local").alias("ts_local"), F.col("t.utc").alias("ts_utc"),
        x.day_text(F.col("t.local")).alias("day"), number("accuracy", "double", 0).alias("accuracy"), number("speed", "double", 0).alias("speed"), number("nbsteps", "long", 0).alias("nb_steps"),
        F.coalesce("activity", F.lit("")).alias("activity"), F.coalesce("ssid", F.lit("")).alias("ssid"), number("batterylevel", "long", 0).alias("battery_level"),
    )


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return traces_from(spark.read.option("header", True).csv(path)).dropDuplicates(["user_id", "ts_utc", "lat", "lon"])


def touched_days(traces: DataFrame) -> DataFrame:
    return traces.select("user_id", "day").distinct()


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("lat double, lon double, ts long").csv(path).orderBy("ts")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Event logs quoted by bars; rows with bad times go, bad arguments become an empty object.

    User and day are in the name user_day_number_log.csv, of a file or of a folder of parts of one.
    """
    raw = spark.read.option("header", True).option("quote", "|").option("recursiveFileLookup", True).csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    raw = raw.toDF(*[c.lower() for c in raw.columns])
    at = F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss"))
    name = r"([^/=]*)_(\d{4}-\d{2}-\d{2})_[^/]*_log\.csv(?:/[^/]*)?$"
    args = F.coalesce(F.try_parse_json("args"), F.parse_json(F.lit("{}")))
    return raw.withColumn("at", at).filter("at is not null").select(F.regexp_extract("file", name, 1).alias("user_id"), F.regexp_extract("file", name, 2).alias("day"), F.unix_timestamp("at").alias("ts"), "session", "type", args.alias("args"))


def read_checkins(spark: SparkSession, path: str, unit: int = 60) -> DataFrame:
    """Tab-separated check-ins; the offset counts in ``unit`` seconds; rows with bad dates go."""
    raw = spark.read.option("sep", "\t").schema("user_id string, venue_id string, date string, utc_offset string").csv(path)
    utc = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace("date", r"^\w+ ", ""), F.lit("MMM dd HH:mm:ss Z yyyy")))
    raw = raw.withColumn("ts", utc).filter("ts is not null")
    return raw.select("user_id", "venue_id", (F.col("ts") * 1000).alias("ms"), (F.col("ts") * 1000 + F.coalesce(F.col("utc_offset").try_cast("long"), F.lit(0)) * unit * 1000).alias("local_ms"))


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    """The first row of each venue; rows without a position go."""
    raw = spark.read.option("sep", "\t").schema("venue_id string, lat string, lon string, category string, country string, name string, emoji string").csv(path)
    raw = raw.withColumn("n", F.monotonically_increasing_id()).withColumns({"lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double")}).filter("lat is not null and lon is not null")
    best = raw.groupBy("venue_id").agg(F.min_by(F.struct("lat", "lon", "category", "country", "name", "emoji"), "n").alias("x"))
    return best.select("venue_id", "x.*")


def read_place_pi(spark: SparkSession, path: str) -> DataFrame:
    """Interests of each place, best first, scores as numbers."""
    raw = spark.read.schema("place_id string, type string, pi_id string, name string, score double").csv(path)
    lists = raw.groupBy("place_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "pi_id", "name"))).alias("x"))
    return lists.select("place_id", F.transform("x", lambda s: F.struct(s["pi_id"].alias("pi_id"), s["name"].alias("name"), (-s["score"]).alias("score"))).alias("interests"))


def long_lookup(wide: DataFrame, key: str = "ID") -> DataFrame:
    """A column for each category, comma lists in the cells, to one row for each value."""
    columns = [c for c in wide.columns if c != key]
    long = wide.unpivot(key, columns, "category", "cell")
    values = long.select(key, "category", F.explode(F.split("cell", ",")).alias("value")).withColumn("value", F.trim("value"))
    return values.filter("value <> ''")


def read_wide_lookup(spark: SparkSession, path: str) -> DataFrame:
    return long_lookup(spark.read.option("header", True).option("sep", ";").csv(path))


def read_lookup(spark: SparkSession, path: str, by: str) -> DataFrame:
    """Rows of a flat lookup grouped by one column."""
    raw = spark.read.option("header", True).option("sep", ";").csv(path)
    return raw.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*[c for c in raw.columns if c != by]))).alias("rows"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(subject, predicate, objects) of whitespace-separated triples."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s*\.\s*$", "")), r"\s+", 3)
    t = spark.read.text(path).filter("trim(value) <> '' and not startswith(trim(value), '#')").select(parts[0].alias("subject"), parts[1].alias("predicate"), F.get(parts, F.lit(2)).alias("object"))
    return t.groupBy("subject", "predicate").agg(F.array_sort(F.collect_list("object")).alias("objects"))


def kb_places(triples: DataFrame) -> DataFrame:
    """Subjects with latitude and longitude: their name from the URI, position and first type."""
    of = lambda end: F.max(F.when(F.col("predicate").rlike(f"{end}>?$"), F.col("objects")[0]))
    number = lambda c: F.regexp_extract(c, r'^"?([-+0-9.eE]+)', 1).try_cast("double")
    p = triples.groupBy("subject").agg(of("lat").alias("lat"), of("long").alias("lon"), of("type").alias("type"))
    p = p.select(F.regexp_replace("subject", "[<>]", "").alias("uri"), x.name_from_uri(F.col("subject")).alias("name"), number("lat").alias("lat"), number("lon").alias("lon"), F.regexp_replace("type", "[<>]", "").alias("type_uri"))
    return p.filter("lat is not null and lon is not null")


def census_tracts(lines: DataFrame, tracts: DataFrame, kind: str) -> DataFrame:
    """Attributes from a census file with two header rows, of one geography type, put on the tracts by code."""
    cells = lines.filter(~F.col("value").rlike("^(CDU_ID|,)")).select(F.split("value", ",").alias("c")).filter(F.col("c")[3] == kind)
    new = cells.select(F.col("c")[1].alias("__code"), F.col("c")[2].alias("__label"), F.col("c")[5].try_cast("double").alias("__total"))
    both = tracts.join(new, F.col("geo_code") == F.col("__code"), "left")
    return both.select("geo_code", F.coalesce("__label", "label").alias("label"), F.coalesce("__total", "total").alias("total"))


def polygons(text: Column) -> Column:
    """Rings of WKT polygons and multipolygons as arrays of struct(x, y); each ring is one polygon."""
    rings = F.regexp_extract_all(text, F.lit(r"\(([-0-9.eE ,]+)\)"), F.lit(1))
    point = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y"))
    return F.transform(rings, lambda ring: F.transform(F.split(ring, ","), point))


def parse_cells(url: Column) -> Column:
    """Bounding box of a failed search, whatever the order of its corners."""
    pair = lambda name: [F.regexp_extract(url, rf"{name}=(-?[0-9.]+),(-?[0-9.]+)", i).try_cast("double") for i in (1, 2)]
    (south, west), (north, east) = pair("sw"), pair("ne")
    return F.struct(south.alias("south"), west.alias("west"), north.alias("north"), east.alias("east"))


def taxonomy_leaves(df: DataFrame) -> DataFrame:
    """Rows that are nobody's parent, with their parent's name."""
    inner = df.select(F.col("parent_id").alias("category_id")).distinct()
    up = df.select(F.col("category_id").alias("parent_id"), F.col("name").alias("parent"))
    return df.join(inner, "category_id", "left_anti").join(up, "parent_id", "left").select("category_id", "name", "parent")


def pending(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return every.select(key).distinct().join(done.select(key).distinct(), key, "left_anti")


def feature(properties: Column, lon: Column, lat: Column) -> Column:
    """A GeoJSON point feature as text."""
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties")))


def collection(order: Column, features: Column) -> Column:
    """Aggregate: a GeoJSON collection of a group's features."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), features.alias("f")))), lambda s: s["f"])
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}"))


VENUE = "struct<id:string,name:string,location:struct<address:string,city:string,lat:double,lng:double>,categories:array<struct<id:string,name:string>>,stats:struct<checkinsCount:bigint,tipCount:bigint>,page:struct<id:string>,redirect:string,chains:array<struct<id:string,name:string,logo:struct<prefix:string,name:string>>>>"


def normalise_venues(raw: DataFrame) -> DataFrame:
    """Nested venue JSON (column value) to flat rows with defaults; a redirected venue also stands under its old id."""
    v = raw.select(F.from_json("value", VENUE).alias("v")).filter("v.id is not null")
    ids = lambda c: F.coalesce(F.transform(c, lambda e: e["id"]), F.array().cast("array<string>"))
    flat = v.select(
        F.col("v.id").alias("venue_id"), F.coalesce("v.name", F.lit("")).alias("name"), F.coalesce("v.location.address", F.lit("")).alias("address"), F.coalesce("v.location.city", F.lit("")).alias("city"),
        F.col("v.location.lat").alias("lat"), F.col("v.location.lng").alias("lon"), ids(F.col("v.categories")).alias("categories"), ids(F.col("v.chains")).alias("chains"),
        F.coalesce("v.stats.checkinsCount", F.lit(0)).alias("nb_checkins"), F.coalesce("v.stats.tipCount", F.lit(0)).alias("nb_tips"), F.col("v.redirect").alias("redirect"),
    )
    again = flat.filter("redirect is not null").withColumn("venue_id", F.col("redirect"))
    return flat.drop("redirect").withColumn("redirect_venue_id", F.lit("")).unionByName(again.drop("redirect").withColumn("redirect_venue_id", F.lit("copy"))).dropDuplicates(["venue_id"])


def venue_chains(raw: DataFrame) -> DataFrame:
    v = raw.select(F.from_json("value", VENUE).alias("v")).select(F.explode("v.chains").alias("c"))
    return v.select(F.col("c.id").alias("chain_id"), F.col("c.name").alias("name"), F.concat("c.logo.prefix", "c.logo.name").alias("logo_url")).dropDuplicates(["chain_id"])


def flatten_categories(raw: DataFrame) -> DataFrame:
    """Edges of a nested category tree (column value), level by level to the last one; what is nested stays text until its turn."""
    from mobtrace.sources.scratch import cut

    kind = "array<struct<id:string,name:string,categories:string>>"
    level, out = raw.select("value", F.lit("").alias("parent_id")), None
    while True:
        level = level.select("parent_id", F.explode(F.from_json("value", kind)).alias("c")).filter("c.id is not null")
        level = cut(level.select(F.col("c.id").alias("category_id"), "parent_id", F.col("c.name").alias("name"), F.col("c.categories").alias("value")), "tree")
        if out is not None and level.isEmpty():
            return out
        rows = level.drop("value")
        out = rows if out is None else out.unionByName(rows)
        level = level.filter("value is not null").select("value", F.col("category_id").alias("parent_id"))


TIP = "struct<id:string,text:string,createdAt:bigint,agreeCount:bigint,lang:string,likes:struct<count:bigint>,user:struct<id:string,firstName:string>,entities:array<struct<text:string,type:string>>>"


def normalise_tips(raw: DataFrame) -> DataFrame:
    """Nested tip JSON (column value) to rows with their author and entity texts."""
    t = raw.select(F.from_json("value", TIP).alias("t")).filter("t.id is not null")
    texts = F.coalesce(F.transform(F.filter("t.entities", lambda e: e["text"].isNotNull()), lambda e: e["text"]), F.array().cast("array<string>"))
    return t.select(F.col("t.id").alias("tip_id"), F.coalesce("t.text", F.lit("")).alias("text"), F.col("t.createdAt").alias("created_at"), F.coalesce("t.likes.count", F.lit(0)).alias("nb_likes"), F.coalesce("t.agreeCount", F.lit(0)).alias("nb_agree"), F.coalesce("t.lang", F.lit("")).alias("lang"), F.col("t.user.id").alias("user_id"), F.coalesce("t.user.firstName", F.lit("")).alias("user_name"), texts.alias("entities"))
