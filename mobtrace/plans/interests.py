"""Interest, text and vector jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mobtrace.fixtures import oracle, table, view
from mobtrace.functions import scalars as x
from mobtrace.operators import interests as op
from mobtrace.operators import rows as r
from mobtrace.plans.registry import query
from mobtrace.plans.scalars import TRIGRAMS
from mobtrace.sources import files
from mobtrace.sources.scratch import cut, spread


@query("C1_interests_of_categories", oracle("WITH l AS (SELECT p_brand, unnest(['INT', 'ACT', 'SOC']) AS kind, unnest([p_brand, p_brand || ' a', p_brand || ' s']) AS pi FROM (SELECT DISTINCT p_brand FROM part)) SELECT v.venue_id, kind, pi FROM fx_venue v JOIN fx_category c ON v.leaf_category = c.category_id JOIN l ON c.name = l.p_brand"))
def interests_of_categories(spark, d):
    """A wide table, a column for each kind, made long and joined; INT takes the category's own name."""
    wide = table(spark, d, "part").select(F.col("p_brand").alias("ID")).distinct().select("ID", F.col("ID").alias("INT"), F.concat("ID", F.lit(" a")).alias("ACT"), F.concat("ID", F.lit(" s")).alias("SOC"))
    long = wide.unpivot("ID", ["INT", "ACT", "SOC"], "kind", "pi")
    c = view(spark, d, "fx_category").select(F.col("category_id").alias("leaf_category"), F.col("name").alias("ID"))
    return view(spark, d, "fx_venue").select("venue_id", "leaf_category").join(c, "leaf_category").join(long, "ID").select("venue_id", "kind", "pi")


ROOTS = ["ring", "bolt", "gear", "widget", "gizmo", "plate", "anvil", "steel", "tin"]


@query("C2_interests_of_types")
def interests_of_types(spark, d):
    """Interests by the type of a place: a lookup whose mark YES is skipped, and for INT the names that the type links to, without near-duplicates and names without a root."""
    c = view(spark, d, "fx_category").select(F.col("category_id").alias("extra_category"), F.col("name").alias("type"))
    wide = c.select("type").distinct().select("type", F.when(F.length("type") % 2 == 0, "YES").otherwise("dine").alias("ACT"), F.concat(F.lit("people of "), F.lower("type"), F.lit(", YES")).alias("SOC"))
    lookup = files.long_lookup(wide, "type").filter("value <> 'YES'").select("type", F.col("category").alias("kind"), F.col("value").alias("pi"))
    v = view(spark, d, "fx_venue").join(c, "extra_category").select("venue_id", "type", "name")
    linked = op.without_similar(v.groupBy("type", "name").agg(F.count("*").alias("n")), ["type"], "name", "n", ROOTS)
    links = linked.select("type", F.lit("INT").alias("kind"), F.col("name").alias("pi"))
    return v.select("venue_id", "type").join(lookup.unionByName(links), "type").select("venue_id", "kind", "pi")


@query("C3_without_similar_names")
def without_similar_names(spark, d):
    """Names of parts by brand, in order of frequency, without near-duplicates and names without a root or with digits."""
    name = F.when(F.col("p_partkey") % 9 == 0, F.concat("p_name", F.lit(" "), F.col("p_partkey") % 3)).otherwise(F.col("p_name"))
    n = table(spark, d, "part").groupBy("p_brand", name.alias("p_name")).agg(F.count("*").alias("n"))
    return op.without_similar(n, ["p_brand"], "p_name", "n", ROOTS)


@query("C4_merged_sources")
def merged_sources(spark, d):
    """Part names of each brand and size, with the types that they come from; of similar names that of the earliest part stays."""
    p = table(spark, d, "part").groupBy("p_brand", "p_size", "p_name").agg(F.array_sort(F.collect_set("p_type")).alias("sources"), F.min("p_partkey").alias("first"))
    return op.merged_sources(p, ["p_brand", "p_size"], "p_name", "sources", F.col("first"))


@query("C5_aggregated_interests", oracle("SELECT r.session_id AS user_id, lower(n_name) AS name, list_sort(list(DISTINCT r.place_id)) AS places, max(rating) AS rating FROM fx_rating r JOIN nation ON pi_id = n_nationkey GROUP BY r.session_id, lower(n_name)"))
def aggregated_interests(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("pi_id"), F.lower("n_name").alias("name"))
    return view(spark, d, "fx_rating").join(n, "pi_id").groupBy(F.col("session_id").alias("user_id"), "name").agg(F.array_sort(F.collect_set("place_id")).alias("places"), F.max("rating").alias("rating"))


MATCHED = f"WITH a AS (SELECT DISTINCT p_brand, p_name AS name, {TRIGRAMS.format('p_name')} AS t FROM part), b AS (SELECT DISTINCT p_brand, p_type || ' ' || p_name AS id, {TRIGRAMS.format(chr(40) + 'p_type || chr(32) || p_name' + chr(41))} AS t FROM part WHERE p_partkey % 2 = 0), s AS (SELECT a.p_brand, a.name, b.id, round(len(list_intersect(a.t, b.t))::DOUBLE / len(a.t), 6) AS s FROM a JOIN b ON a.p_brand = b.p_brand) SELECT p_brand, name, arg_min(id, (-s, id)) AS id, max(s) AS score FROM s WHERE s >= 0.6 GROUP BY p_brand, name"


@query("C6_matched_names", MATCHED)
def matched_names(spark, d, least: float = 0.6):
    """For each name the catalogue's name of the same category that holds most of its trigrams, from a least share on.

    A name is looked up by its rarest trigrams only: if the share is reached, one of the first
    (size less what is needed, plus one) is shared.
    """
    p = table(spark, d, "part")
    a = p.select("p_brand", F.col("p_name").alias("name")).distinct().withColumn("t", x.trigrams(F.col("name")))
    b = p.filter("p_partkey % 2 = 0").select("p_brand", F.concat_ws(" ", "p_type", "p_name").alias("id")).distinct().withColumn("u", x.trigrams(F.col("id")))
    grams = b.select("p_brand", "id", F.explode("u").alias("g"))
    often = grams.groupBy("g").agg(F.count("*").alias("n"))
    asked = a.select("p_brand", "name", F.explode("t").alias("g")).join(often, "g", "left").groupBy("p_brand", "name").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g"))).alias("o"))
    first = asked.select("p_brand", "name", F.explode(F.slice("o", F.lit(1), (F.size("o") - F.ceil(F.size("o") * least) + 1).cast("int"))).alias("x")).select("p_brand", "name", F.col("x.g").alias("g"))
    pairs = first.join(grams, ["p_brand", "g"]).select("p_brand", "name", "id").distinct()
    s = pairs.join(a, ["p_brand", "name"]).join(b, ["p_brand", "id"]).withColumn("s", F.round(x.containment(F.col("t"), F.col("u")), 6)).filter(F.col("s") >= least)
    return s.groupBy("p_brand", "name").agg(F.min(F.struct(-F.col("s"), "id")).alias("x")).select("p_brand", "name", "x.id", (-F.col("x.col1")).alias("score"))


@query("C8_review_questions", oracle("SELECT visit_id, q AS question, kind FROM fx_visit, (VALUES (1, 'visit'), (2, 'pi'), (3, 'pi'), (4, 'pi')) t(q, kind) WHERE visited"))
def review_questions(spark, d):
    """One question for each visit and three for its interests: a fixed array, so no join."""
    questions = F.array(*[F.struct(F.lit(i).alias("question"), F.lit(k).alias("kind")) for i, k in ((1, "visit"), (2, "pi"), (3, "pi"), (4, "pi"))])
    return view(spark, d, "fx_visit").filter("visited").select("visit_id", F.inline(questions))


STOP = ("the", "of", "and", "to", "in", "a", "is", "that", "with", "for", "on", "was", "by", "as", "at")
WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda w: w <> '')"
STOPPED = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"


PLACED = f"p0 AS (SELECT tip_id AS id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM (SELECT tip_id, {WORDS} AS w FROM fx_tip))"


def learned_sql(words: str, name: str) -> str:
    return f"{name}u AS (SELECT word, count(*) AS n FROM {words} GROUP BY word), {name}b AS (SELECT word AS a, b, count(*) AS n FROM (SELECT word, lead(word) OVER (PARTITION BY id ORDER BY pos) AS b FROM {words}) WHERE b IS NOT NULL GROUP BY word, b), {name} AS (SELECT {name}b.a, {name}b.b, {name}b.n, round(({name}b.n - 2.0) / (u.n * v.n), 9) AS score FROM {name}b JOIN {name}u u ON {name}b.a = u.word JOIN {name}u v ON {name}b.b = v.word WHERE {name}b.n > 5 AND ({name}b.n - 2.0) / (u.n * v.n) > 0.0005)"


def joined_sql(words: str, phrases: str, name: str) -> str:
    w = "OVER (PARTITION BY id ORDER BY pos)"
    return f"{name}a AS (SELECT w.*, ph.a IS NOT NULL AS hit FROM (SELECT *, lead(word) {w} AS nxt FROM {words}) w LEFT JOIN {phrases} ph ON w.word = ph.a AND w.nxt = ph.b), {name}c AS (SELECT *, sum(fresh) {w} AS run FROM (SELECT *, CASE WHEN hit AND NOT coalesce(lag(hit) {w}, false) THEN 1 ELSE 0 END AS fresh FROM {name}a)), {name}d AS (SELECT *, hit AND row_number() OVER (PARTITION BY id, run ORDER BY pos) % 2 = 1 AS joins FROM {name}c), {name}e AS (SELECT *, coalesce(lag(joins) {w}, false) AS taken FROM {name}d), {name} AS (SELECT id, row_number() {w} AS pos, CASE WHEN joins THEN word || '_' || nxt ELSE word END AS word FROM {name}e WHERE NOT taken)"


def worded(tips):
    """Tips as arrays of words (id, words)."""
    return spread(tips.filter("text is not null").select(F.col("tip_id").alias("id"), "text")).select("id", x.tokens(F.col("text")).alias("words"))


def phrased(spark, d):
    """Words of all tips with learned phrases joined twice, so of up to four words; each step is written, as it is read again."""
    first = cut(worded(view(spark, d, "fx_tip")), "words")
    second = cut(op.joined_phrases(first, cut(op.learned_phrases(first), "phrases")), "phrased")
    return cut(op.joined_phrases(second, cut(op.learned_phrases(second), "phrases")), "phrased")


def placed(texts):
    """The words of texts, a row each."""
    return texts.select("id", F.explode("words").alias("word"))


PHRASED = f"{PLACED}, {learned_sql('p0', 'f1')}, {joined_sql('p0', 'f1', 'p1')}, {learned_sql('p1', 'f2')}, {joined_sql('p1', 'f2', 'p2')}"


@query("M1_tip_words", oracle(f"WITH {PHRASED}, t AS (SELECT venue_id, word AS w FROM p2 JOIN fx_tip ON id = tip_id WHERE lang = 'en'), c AS (SELECT venue_id, w, count(*) AS tf FROM t WHERE contains(w, '_') OR w NOT IN {STOPPED} GROUP BY venue_id, w), n AS (SELECT w, count(*) AS df FROM c GROUP BY w), k AS (SELECT count(DISTINCT venue_id) AS n FROM c), s AS (SELECT c.venue_id, c.w AS word, round(tf * ln((k.n + 1.0) / (df + 1)), 6) AS score FROM c JOIN n ON c.w = n.w, k) SELECT venue_id, word, score FROM (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY score DESC, word) AS r FROM s) WHERE r <= 10", "fx_tip"))
def tip_words(spark, d):
    """The ten words of a venue's English tips with the greatest tf-idf; phrases are joined before, and are never stop words."""
    return top_words(placed(phrased(spark, d)), spark, d)


def top_words(words, spark, d):
    tips = view(spark, d, "fx_tip").filter("lang = 'en'").select(F.col("tip_id").alias("id"), "venue_id")
    t = words.filter(F.contains("word", F.lit("_")) | ~F.col("word").isin(*STOP)).join(tips, "id")
    c = cut(t.groupBy("venue_id", "word").agg(F.count("*").alias("tf")), "words-of-venues")
    n = c.groupBy("word").agg(F.count("*").alias("df"))
    total = c.select("venue_id").distinct().count()
    s = c.join(n, "word").withColumn("score", F.round(F.col("tf") * F.log((F.lit(total) + 1.0) / (F.col("df") + 1)), 6))
    return r.top(s, ["venue_id"], [F.desc("score"), F.col("word")], 10).select("venue_id", "word", "score")


NAMED = "SELECT venue_id, 'name' AS source, name FROM fx_venue UNION ALL SELECT v.venue_id, 'category', c.name FROM fx_venue v JOIN fx_category c ON c.category_id IN (v.leaf_category, v.extra_category)"


def name_words(spark, d):
    """Words of names and of category names, as they are and as phrases where the whole name is a known phrase."""
    v, c = view(spark, d, "fx_venue"), view(spark, d, "fx_category").select("category_id", F.col("name").alias("category"))
    categories = v.select("venue_id", F.explode(F.array("leaf_category", "extra_category")).alias("category_id")).join(c, "category_id")
    n = v.select("venue_id", F.lit("name").alias("source"), F.lower("name").alias("name")).unionByName(categories.select("venue_id", F.lit("category").alias("source"), F.lower("category").alias("name")))
    known = n.groupBy("name").agg(F.count("*").alias("n")).filter("n >= 5").select("name", F.lit(True).alias("known"))
    n = n.join(known, "name", "left").withColumn("phrase", F.explode(F.array(F.lit(False), F.lit(True))))
    parts = F.split("name", " ")
    found = F.when(F.col("phrase") & F.col("known"), F.array(F.array_join(parts, "_"))).otherwise(parts)
    return n.select("venue_id", "source", "phrase", F.explode(found).alias("word")).distinct()


@query("M2_name_features", oracle(f"WITH n AS (SELECT venue_id, source, lower(name) AS name FROM ({NAMED})), k AS (SELECT name FROM n GROUP BY name HAVING count(*) >= 5), m AS (SELECT n.*, phrase, k.name IS NOT NULL AS known FROM n LEFT JOIN k ON n.name = k.name, (VALUES (false), (true)) t(phrase)) SELECT DISTINCT venue_id, source, phrase, unnest(CASE WHEN phrase AND known THEN [replace(name, ' ', '_')] ELSE string_split(name, ' ') END) AS word FROM m", "fx_venue", "fx_category"))
def name_features(spark, d):
    return name_words(spark, d)


@query("M3_phrases", oracle(f"WITH {PHRASED} SELECT word, count(*) AS n, count(DISTINCT id) AS tips FROM p2 WHERE contains(word, '_') GROUP BY word", "fx_tip"))
def phrases(spark, d):
    """Phrases of two to four words as they are joined in the tips."""
    return placed(phrased(spark, d)).filter(F.contains("word", F.lit("_"))).groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("id").alias("tips"))


@query("M4_tag_vectors", oracle("SELECT t.pi_id::BIGINT AS pi_id, t.word_id, list_transform(e.embedding, lambda x: round(x::DOUBLE, 6)) AS vector FROM fx_tag t JOIN embeddings e ON t.word_id = e.vec_id WHERE t.pi_id < 6"))
def tag_vectors(spark, d):
    """The vectors of the tags of interests of six categories; tags out of the vocabulary have none."""
    t = view(spark, d, "fx_tag").filter(F.col("pi_id") < 6)
    return t.join(vectors(spark, d), "word_id").select(F.col("pi_id").cast("long").alias("pi_id"), "word_id", F.transform("embedding", lambda e: x.rounded(e.cast("double"), 6)).alias("vector"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("word_id"), "embedding")


def tag_means(spark, d):
    return op.mean_vectors(view(spark, d, "fx_tag").join(vectors(spark, d), "word_id"), ["pi_id"], "embedding").select(F.col("pi_id").cast("long").alias("pi_id"), F.col("embedding").alias("of_pi"))


TAGS = "g AS (SELECT pi_id, i, avg(x::DOUBLE) AS x FROM (SELECT pi_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM fx_tag JOIN embeddings ON word_id = vec_id) GROUP BY pi_id, i), p AS (SELECT pi_id, list(x ORDER BY i) AS v FROM g GROUP BY pi_id)"


@query("M5_matched_features", oracle(f"WITH {TAGS}, s AS (SELECT f.venue_id, f.word_id, p.pi_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM fx_feature f JOIN embeddings e ON f.word_id = e.vec_id, p) SELECT venue_id, word_id, pi_id::BIGINT AS pi_id, score FROM (SELECT *, row_number() OVER (PARTITION BY venue_id, word_id ORDER BY score DESC, pi_id) AS n FROM s) WHERE n <= 3"))
def matched_features(spark, d):
    """Each feature's three nearest interests."""
    f = view(spark, d, "fx_feature").join(vectors(spark, d), "word_id").select("venue_id", "word_id", "embedding")
    return op.best_matches(f, "embedding", tag_means(spark, d), "pi_id", "of_pi", 3).select("venue_id", "word_id", "pi_id", "score")


VENUES = "h AS (SELECT venue_id, i, avg(x::DOUBLE) AS x FROM (SELECT venue_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM fx_feature JOIN embeddings ON word_id = vec_id) GROUP BY venue_id, i), q AS (SELECT venue_id, list(x ORDER BY i) AS u FROM h GROUP BY venue_id)"


@query("M6_matched_sets", oracle(f"WITH {TAGS}, {VENUES}, s AS (SELECT venue_id, pi_id, round(list_cosine_similarity(u, v), 6) AS score FROM q, p) SELECT venue_id, pi_id::BIGINT AS pi_id, score FROM (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY score DESC, pi_id) AS n FROM s) WHERE n <= 3"))
def matched_sets(spark, d):
    f = op.mean_vectors(view(spark, d, "fx_feature").join(vectors(spark, d), "word_id"), ["venue_id"], "embedding")
    return op.best_matches(f, "embedding", tag_means(spark, d), "pi_id", "of_pi", 3).select("venue_id", "pi_id", "score")


@query("M7_combined_scores", oracle("WITH c AS (SELECT venue_id, pi_id, feature_type, CASE WHEN feature_type = 'tips' THEN avg(score) ELSE max(score) END AS score FROM fx_score GROUP BY venue_id, pi_id, feature_type), s AS (SELECT venue_id, pi_id, round(sum(score), 6) AS score FROM c GROUP BY venue_id, pi_id) SELECT venue_id, pi_id, score FROM (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY score DESC, pi_id) AS n FROM s) WHERE n <= 5"))
def combined_scores(spark, d):
    c = view(spark, d, "fx_score").groupBy("venue_id", "pi_id", "feature_type").agg(F.avg("score").alias("mean"), F.max("score").alias("top"))
    c = c.withColumn("score", F.when(F.col("feature_type") == "tips", F.col("mean")).otherwise(F.col("top")))
    s = c.groupBy("venue_id", "pi_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return r.top(s, ["venue_id"], [F.desc("score"), F.col("pi_id")], 5)


VECTOR_SETS = ("sg", "cbow", "cn")


def word_vectors(spark, d):
    """Three sets of vectors for words: a word has the vector that its hash picks, in each set another one."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.count()
    return e, lambda word, i: F.pmod(F.xxhash64(word, F.lit(i)), F.lit(n))


@query("M8_variants")
def variants(spark, d, singles: int = 4, most: int = 10):
    """The thirty variants in one plan: three vector sets; words of tips with and without phrases; names and categories with and without phrases, word by word and as a mean."""
    tips = top_words(placed(worded(view(spark, d, "fx_tip"))), spark, d).select("venue_id", "word", F.lit(False).alias("phrase"))
    tips = tips.unionByName(top_words(placed(phrased(spark, d)), spark, d).select("venue_id", "word", F.lit(True).alias("phrase")))
    f = tips.withColumn("source", F.lit("tips")).unionByName(name_words(spark, d))
    e, of = word_vectors(spark, d)
    f = f.withColumn("at", F.explode(F.array(*[F.struct(F.lit(m).alias("model_type"), of(F.col("word"), i).alias("vec_id")) for i, m in enumerate(VECTOR_SETS)])))
    f = cut(f.select("venue_id", "word", "phrase", "source", "at.*"), "features")
    means = cut(tag_means(spark, d), "means")
    by = ["venue_id", "model_type", "source", "phrase"]
    # a vector's interests, and those of a mean of the same vectors, are worked out once, whichever features have them
    known = cut(op.best_matches(e.join(f.select("vec_id").distinct(), "vec_id", "left_semi"), "embedding", means, "pi_id", "of_pi", singles), "matched")
    single = f.join(known, "vec_id").groupBy(*by, "pi_id").agg(F.avg("score").alias("mean"), F.max("score").alias("top"))
    single = single.select(*by, "pi_id", F.lit(False).alias("avg"), F.when(F.col("source") == "tips", F.col("mean")).otherwise(F.col("top")).alias("score"))
    sets = cut(f.filter("source <> 'tips'").groupBy(*by).agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "sets")
    mean = sets.select("ids").distinct().select("ids", F.explode("ids").alias("vec_id")).join(e, "vec_id")
    whole = op.best_matches(op.mean_vectors(mean, ["ids"], "embedding"), "embedding", means, "pi_id", "of_pi", singles)
    whole = sets.join(whole, "ids").select(*by, "pi_id", F.lit(True).alias("avg"), "score")
    w = Window.partitionBy(*by, "avg").orderBy(F.desc("score"), "pi_id")
    both = single.unionByName(whole).withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(w).cast("long") - 1)
    return both.filter(F.col("rank") < most).withColumnRenamed("source", "feature_type")


@query("M11_language_votes", oracle("WITH s(lang, word) AS (VALUES " + ", ".join(f"('{lang}', '{w}')" for lang, ws in (("en", "the of and to in"), ("de", "der die und das ein"), ("fr", "le la les et un"), ("es", "el la los y que")) for w in ws.split()) + f"), t AS (SELECT tip_id, unnest({WORDS}) AS w FROM fx_tip), h AS (SELECT tip_id, s.lang, count(*) AS n FROM t JOIN s ON t.w = s.word GROUP BY tip_id, s.lang) SELECT tip_id, arg_min(lang, (-n, lang)) AS voted FROM h GROUP BY tip_id"))
def language_votes(spark, d):
    return op.voted(view(spark, d, "fx_tip")).filter("lang is not null").select("tip_id", F.col("lang").alias("voted"))


@query("T6_nearest_vectors", oracle("WITH s AS (SELECT a.vec_id AS word_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT word_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 10"))
def nearest_vectors(spark, d, n: int = 10):
    """Ten nearest vectors by cosine of a stated query set (ids divisible by 100) against all rows, in blocks."""
    e = vectors(spark, d)
    found = op.best_matches(e.filter("word_id % 100 = 0"), "embedding", e.withColumnsRenamed({"word_id": "vec_id", "embedding": "v"}), "vec_id", "v", n + 1)
    return r.top(found.filter("vec_id <> word_id"), ["word_id"], [F.desc("score"), F.col("vec_id")], n).select("word_id", "vec_id", "score")


@query("X7_name_ratios")
def name_ratios(spark, d):
    """Ratios of part names and types that share a brand's first name."""
    p = table(spark, d, "part")
    lead = p.groupBy("p_brand").agg(F.min("p_name").alias("lead"))
    return p.join(lead, "p_brand").select("p_partkey", F.round(op.name_ratio(F.col("p_name"), F.col("lead")), 6).alias("ratio"))


@query("X9_ngrams", oracle("WITH t AS (SELECT venue_id, list_filter(string_split(lower(name || ' of the ' || leaf_category || ' blue by ' || extra_category), ' '), lambda w: w NOT IN ('blue', 'small', 'of', 'the')) AS w FROM fx_venue) SELECT venue_id, list_concat(list_concat(list_concat(w, list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))), list_concat(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')), list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))), list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS grams FROM t"))
def ngrams(spark, d, most: int = 5):
    from pyspark.ml.feature import NGram, StopWordsRemover

    text = F.concat(F.col("name"), F.lit(" of the "), F.col("leaf_category"), F.lit(" blue by "), F.col("extra_category"))
    v = view(spark, d, "fx_venue").select("venue_id", F.split(F.lower(text), " ").alias("words"))
    v = StopWordsRemover(inputCol="words", outputCol="n1", stopWords=["blue", "small", "of", "the"]).transform(v)
    for n in range(2, most + 1):
        v = NGram(n=n, inputCol="n1", outputCol=f"n{n}").transform(v)
    return v.select("venue_id", F.concat(*[f"n{n}" for n in range(1, most + 1)]).alias("grams"))
