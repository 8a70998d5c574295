"""Model jobs: stacking, evaluation, baselines, topics and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mobtrace.fixtures import oracle, view
from mobtrace.functions import scalars as x
from mobtrace.operators import models as m
from mobtrace.operators import rows as r
from mobtrace.plans.registry import query
from mobtrace.sources.scratch import cut, scratch

MODELS = ("sg", "cbow", "cn")
KEY = ("venue_id", "pi_id")


def scores(spark, d):
    return view(spark, d, "fx_score").groupBy(*KEY, F.col("model_type").alias("model")).agg(F.max("score").alias("score"))


def matrix(spark, d):
    return m.stacking_matrix(scores(spark, d), view(spark, d, "fx_rating"), MODELS)


@query("M12_stacking_matrix", oracle("WITH r AS (SELECT place_id, pi_id, avg(rating) AS rating FROM fx_rating GROUP BY place_id, pi_id), s AS (SELECT venue_id, pi_id, max(score) FILTER (WHERE model_type = 'sg') AS sg, max(score) FILTER (WHERE model_type = 'cbow') AS cbow, max(score) FILTER (WHERE model_type = 'cn') AS cn FROM fx_score GROUP BY venue_id, pi_id) SELECT r.place_id AS venue_id, r.pi_id, coalesce(sg, 0.0) AS sg, coalesce(cbow, 0.0) AS cbow, coalesce(cn, 0.0) AS cn, CASE WHEN rating >= 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM r LEFT JOIN s ON r.place_id = s.venue_id AND r.pi_id = s.pi_id"))
def stacking_matrix(spark, d):
    return matrix(spark, d)


@query("M13_oversampled")
def oversampled(spark, d):
    return m.oversampled(matrix(spark, d), MODELS, KEY)


@query("M14_coefficients")
def coefficients(spark, d):
    """The weights of the model that was trained, saved and read again."""
    model = m.saved(m.train(matrix(spark, d), MODELS), scratch(spark, "meta-classifier"))
    rows = [(n, float(c)) for n, c in zip((*MODELS, "intercept"), [*model.coefficients, model.intercept], strict=True)]
    return spark.createDataFrame(rows, "feature string, weight double")


def fold(by: int):
    return F.pmod(F.col("venue_id") * 31 + F.col("pi_id") * 7, F.lit(by))


@query("M15_cross_validation")
def cross_validation(spark, d, folds: int = 5):
    """Each fold is predicted by a model of the others; over-sampling happens within the training folds."""
    rows = matrix(spark, d).withColumn("fold", fold(folds))
    out = None
    for i in range(folds):
        model = m.train(m.oversampled(rows.filter(F.col("fold") != i).drop("fold"), MODELS, KEY), MODELS)
        part = m.predicted(model, rows.filter(F.col("fold") == i), MODELS)
        out = part if out is None else out.unionByName(part)
    return m.confusion(out, ["fold"])


@query("M15_hold_out")
def hold_out(spark, d, share: int = 5):
    """Confusion of a model on the fifth of the rows that it hasn't seen."""
    rows = matrix(spark, d).withColumn("fold", fold(share))
    model = m.train(m.oversampled(rows.filter("fold <> 0").drop("fold"), MODELS, KEY), MODELS)
    return m.confusion(m.predicted(model, rows.filter("fold = 0"), MODELS))


JUDGED = "WITH s AS (SELECT venue_id, pi_id, model_type AS model, max(score) AS score FROM fx_score GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY model, venue_id ORDER BY score DESC, pi_id) AS rank FROM s), r AS (SELECT place_id, pi_id, avg(rating) AS rating FROM fx_rating GROUP BY place_id, pi_id), j AS (SELECT k.*, CASE WHEN r.rating >= 4 THEN 1 ELSE 0 END AS relevant FROM k LEFT JOIN r ON k.venue_id = r.place_id AND k.pi_id = r.pi_id)"


def judged(spark, d):
    mean = view(spark, d, "fx_rating").groupBy(F.col("place_id").alias("venue_id"), "pi_id").agg(F.avg("rating").alias("rating"))
    k = m.ranked(scores(spark, d)).join(mean, list(KEY), "left")
    return k.withColumn("relevant", F.when(F.col("rating") >= 4, 1).otherwise(0)).drop("rating")


FULL = "WITH r AS (SELECT place_id, pi_id, CASE WHEN avg(rating) >= 4 THEN 1 ELSE 0 END AS y FROM fx_rating GROUP BY place_id, pi_id), s AS (SELECT model_type AS model, venue_id, pi_id, max(score) / 1000 AS score FROM fx_score GROUP BY ALL), f AS (SELECT b.model, b.venue_id, c.pi_id, coalesce(s.score, 0.0) AS score, coalesce(r.y, 0) AS y FROM (SELECT DISTINCT model, venue_id FROM s) b, (SELECT DISTINCT pi_id FROM s) c LEFT JOIN s ON s.model = b.model AND s.venue_id = b.venue_id AND s.pi_id = c.pi_id LEFT JOIN r ON r.place_id = b.venue_id AND r.pi_id = c.pi_id), g AS (SELECT *, CASE WHEN score >= 0.01 THEN 1 ELSE 0 END AS p, row_number() OVER (PARTITION BY model, venue_id ORDER BY score DESC, pi_id) AS rank FROM f)"


@query("M16_top_n_errors", oracle(f"{FULL} SELECT model, venue_id, round(count(*) FILTER (WHERE rank <= 5 AND p <> y) / 5.0, 6)::DOUBLE AS top_error, round(count(*) FILTER (WHERE p <> y)::DOUBLE / count(*), 6) AS error, round(CASE WHEN count(*) FILTER (WHERE y = 1 OR score > 0) > 0 THEN count(*) FILTER (WHERE (y = 1 OR score > 0) AND p <> y)::DOUBLE / count(*) FILTER (WHERE y = 1 OR score > 0) ELSE 1.0 END, 6) AS error_of_some, round(CASE WHEN count(*) FILTER (WHERE y = 1 OR score > 0) > 0 THEN count(*) FILTER (WHERE y = p AND y = 1)::DOUBLE / count(*) FILTER (WHERE y = 1 OR score > 0) ELSE 0.0 END, 6) AS overlap, list_sort(list(pi_id) FILTER (WHERE rank <= 5)) AS top FROM g GROUP BY model, venue_id", "fx_score", "fx_rating"))
def top_n_errors(spark, d, n: int = 5, least: float = 0.01):
    """Errors of scores rounded at a threshold, over the whole catalogue (an interest without a score has 0): of the first n, of all, of those scored or relevant, and the overlap with what is relevant.

    Absent interests are right by their absence, so only their number counts and no row stands
    for them. Where fewer than n have a score above 0, the first n are filled up with the
    catalogue's first interests that have none, looked up by their number.
    """
    s = cut(scores(spark, d).withColumn("score", F.col("score") / 1000), "scores")
    catalogue = cut(r.numbered(s.select("pi_id").distinct(), [F.col("pi_id")], "no"), "catalogue")
    size = catalogue.count()
    mean = view(spark, d, "fx_rating").groupBy(F.col("place_id").alias("venue_id"), "pi_id").agg((F.avg("rating") >= 4).alias("y"))
    mean = mean.filter("y").join(catalogue.select("pi_id"), "pi_id", "left_semi")
    key = ["model", "venue_id"]
    wanted = s.select(*key).distinct().join(mean, "venue_id").select(*key, "pi_id", F.lit(0.0).alias("score"), F.lit(1).alias("y"))
    g = s.select(*key, "pi_id", "score", F.lit(0).alias("y")).unionByName(wanted).groupBy(*key, "pi_id").agg(F.max_by("score", F.abs("score")).alias("score"), (F.max("y") == 1).alias("y"))
    g = cut(g.withColumns({"p": F.col("score") >= least, "some": F.col("y") | (F.col("score") > 0)}), "present")
    wrong = F.col("p") != F.col("y")
    by = g.groupBy(*key).agg(F.count_if(wrong).alias("wrong"), F.count_if("some").alias("some"), F.count_if(F.col("some") & wrong).alias("some_wrong"), F.count_if(F.col("p") & F.col("y")).alias("hit"), F.count_if(F.col("score") > 0).alias("above"), F.count_if(F.col("score") != 0).alias("scored"))
    # of the catalogue's first (n + scored) interests at least n have no score
    fill = by.filter(F.col("above") < n).select(*key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("scored") + n)).alias("no")).join(catalogue, "no")
    fill = fill.join(g.select(*key, "pi_id"), [*key, "pi_id"], "left_anti").select(*key, "pi_id", F.lit(0.0).alias("score"), F.lit(False).alias("wrong"))
    first = r.top(g.select(*key, "pi_id", "score", wrong.alias("wrong")).unionByName(fill), key, [F.desc("score"), F.col("pi_id")], n)
    first = first.groupBy(*key).agg(F.count_if("wrong").alias("top_wrong"), F.array_sort(F.collect_list("pi_id")).alias("top"))
    share = lambda a, b, default: F.round(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(default)), 6)
    return by.join(first, key).select(*key, F.round(F.col("top_wrong") / n, 6).alias("top_error"), F.round(F.col("wrong") / size, 6).alias("error"), share("some_wrong", "some", 1.0).alias("error_of_some"), share("hit", "some", 0.0).alias("overlap"), "top")


@query("M17_average_precision", oracle(f"{JUDGED}, h AS (SELECT *, sum(relevant) OVER (PARTITION BY model, venue_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM j) SELECT model, venue_id, round(avg(CASE WHEN relevant = 1 THEN hits::DOUBLE / rank END), 6) AS average_precision FROM h GROUP BY model, venue_id", "fx_score", "fx_rating"))
def average_precision(spark, d):
    return m.average_precision(judged(spark, d))


@query("M18_precision_at_k", oracle(f"{JUDGED}, t AS (SELECT model, venue_id, k, count(*) FILTER (WHERE rank <= k AND relevant = 1) AS hit, count(*) FILTER (WHERE relevant = 1) AS good FROM j, range(1, 6) n(k) GROUP BY model, venue_id, k) SELECT model, k, round(avg(hit::DOUBLE / k), 6) AS precision, round(avg(CASE WHEN good > 0 THEN hit::DOUBLE / good END), 6) AS recall FROM t GROUP BY model, k", "fx_score", "fx_rating"))
def precision_at_k(spark, d):
    """Hits up to each k are counted in one pass over the ranked rows."""
    good = F.col("relevant") == 1
    hits = F.array(*[F.count_if(good & (F.col("rank") <= k)) for k in range(1, 6)])
    by = judged(spark, d).groupBy("model", "venue_id").agg(hits.alias("hits"), F.count_if(good).alias("good"))
    t = by.select("model", "good", F.posexplode("hits").alias("k", "hit")).withColumn("k", (F.col("k") + 1).cast("long"))
    return t.groupBy("model", "k").agg(F.round(F.avg(F.col("hit") / F.col("k")), 6).alias("precision"), F.round(F.avg(F.try_divide("hit", "good")), 6).alias("recall"))


@query("M19_balanced_metrics", oracle(f"{JUDGED}, p AS (SELECT venue_id FROM j WHERE relevant = 1 GROUP BY venue_id HAVING count(DISTINCT pi_id) >= 3), c AS (SELECT model, count(*) FILTER (WHERE rank <= 3 AND relevant = 1) AS tp, count(*) FILTER (WHERE rank > 3 AND relevant = 1) AS fn, count(*) FILTER (WHERE rank <= 3 AND relevant = 0) AS fp, count(*) FILTER (WHERE rank > 3 AND relevant = 0) AS tn FROM j WHERE venue_id IN (SELECT venue_id FROM p) GROUP BY model) SELECT model, tp, fp, fn, tn, round((CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END + CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) END) / 2, 6) AS balanced FROM c", "fx_score", "fx_rating"))
def balanced_metrics(spark, d, least: int = 3):
    """Metrics with both classes weighing the same, over venues with enough positives."""
    j = judged(spark, d)
    rich = j.filter("relevant = 1").groupBy("venue_id").agg(F.count_distinct("pi_id").alias("n")).filter(F.col("n") >= least).select("venue_id")
    rows = j.join(rich, "venue_id", "left_semi").select("model", F.col("relevant").alias("label"), (F.col("rank") <= 3).cast("int").alias("prediction"))
    c = m.confusion(rows, ["model"])
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b))
    return c.select("model", "tp", "fp", "fn", "tn", F.round((share("tp", "fn") + share("tn", "fp")) / 2, 6).alias("balanced"))


BASELINE = """WITH c AS (SELECT DISTINCT pi_id FROM fx_score), k AS (SELECT pi_id, count(*) AS n FROM (SELECT DISTINCT place_id, pi_id FROM fx_rating) GROUP BY pi_id),
w AS (SELECT c.pi_id, coalesce(k.n, 1) AS n FROM c LEFT JOIN k ON c.pi_id = k.pi_id), z AS (SELECT pi_id, sum(n) OVER (ORDER BY pi_id) AS upto, sum(n) OVER () AS total FROM w),
v AS (SELECT DISTINCT venue_id FROM fx_score), u AS (SELECT venue_id, i, ('0x' || substr(md5(venue_id || ':' || i || ':5'), 1, 8))::BIGINT::DOUBLE / 4294967296 AS u FROM v, range(1, 11) n(i)),
d AS (SELECT DISTINCT venue_id, (SELECT min(pi_id) FROM z WHERE upto > u.u * total) AS pi_id FROM u),
r AS (SELECT place_id, pi_id, CASE WHEN avg(rating) >= 4 THEN 1 ELSE 0 END AS y FROM fx_rating GROUP BY place_id, pi_id),
f AS (SELECT v.venue_id, c.pi_id, coalesce(r.y, 0) AS y, CASE WHEN d.pi_id IS NULL THEN 0 ELSE 1 END AS p FROM v, c LEFT JOIN r ON r.place_id = v.venue_id AND r.pi_id = c.pi_id LEFT JOIN d ON d.venue_id = v.venue_id AND d.pi_id = c.pi_id),
t AS (SELECT venue_id, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn FROM f GROUP BY venue_id HAVING sum(y) >= 3)"""


@query("M20_frequency_baseline", oracle(f"{BASELINE}, b AS (SELECT *, tp::DOUBLE / (tp + fn) AS recall, CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) END AS other FROM t) SELECT venue_id, tp, fp, fn, tn, round(recall, 6) AS recall, round((recall + other) / 2, 6) AS accuracy, round(CASE WHEN recall + 1 - other > 0 THEN recall / (recall + 1 - other) END, 6) AS precision, round(CASE WHEN recall + 1 - other + 1 > 0 THEN 2 * recall / (recall + 1 - other + 1) END, 6) AS f1 FROM b", "fx_score", "fx_rating"))
def frequency_baseline(spark, d, draws: int = 10, seed: int = 5, least: int = 3):
    """Interests drawn ten times for each venue, by their frequency (1 for unseen ones), and how well that does where enough is relevant; both classes weigh the same.

    The catalogue's weights are laid end to end and cut into as many equal stretches as it has interests; a
    draw looks only at those that reach into its stretch. Interests neither drawn nor
    relevant are counted, not written out.
    """
    s = cut(view(spark, d, "fx_score").select("venue_id", "pi_id").distinct(), "scored")
    k = view(spark, d, "fx_rating").select("place_id", "pi_id").distinct().groupBy("pi_id").agg(F.count("*").alias("n"))
    w = s.select("pi_id").distinct().join(k, "pi_id", "left").select("pi_id", F.coalesce("n", F.lit(1)).cast("long").alias("n"))
    w = cut(r.running_sum(w, [F.col("pi_id")], "n", "upto"), "weights")
    total, size = w.agg(F.coalesce(F.max("upto"), F.lit(1)), F.count("*")).first()
    stretch = lambda at: F.floor(at * size / total)
    laid = w.select("pi_id", "n", "upto", F.explode(F.sequence(stretch(F.col("upto") - F.col("n")), stretch(F.col("upto")))).alias("stretch"))
    draw = s.select("venue_id").distinct().select("venue_id", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("i"))
    draw = draw.withColumn("at", m.uniform(F.col("venue_id"), F.col("i"), seed=seed) * total).withColumn("stretch", stretch(F.col("at"))).select("venue_id", "at", "stretch")
    drawn = draw.join(laid, "stretch").filter("at >= upto - n and at < upto").select("venue_id", "pi_id", F.lit(1).alias("p"), F.lit(0).alias("y"))
    mean = view(spark, d, "fx_rating").groupBy(F.col("place_id").alias("venue_id"), "pi_id").agg(F.avg("rating").alias("rating")).filter("rating >= 4")
    good = mean.join(w.select("pi_id"), "pi_id", "left_semi").join(s.select("venue_id").distinct(), "venue_id", "left_semi").select("venue_id", "pi_id", F.lit(0).alias("p"), F.lit(1).alias("y"))
    f = drawn.unionByName(good).groupBy("venue_id", "pi_id").agg(F.max("p").alias("p"), F.max("y").alias("y"))
    t = f.groupBy("venue_id").agg(F.count_if(F.expr("p = 1 and y = 1")).alias("tp"), F.count_if(F.expr("p = 1 and y = 0")).alias("fp"), F.count_if(F.expr("p = 0 and y = 1")).alias("fn"))
    t = t.filter(F.col("tp") + F.col("fn") >= least).select("venue_id", "tp", "fp", "fn", (size - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))
    recall, other = F.col("tp") / (F.col("tp") + F.col("fn")), F.try_divide(F.col("tn").cast("double"), F.col("tn") + F.col("fp"))
    t = t.withColumns({"r": recall, "o": other})
    wrong = 1 - F.col("o")
    return t.select("venue_id", "tp", "fp", "fn", "tn", F.round("r", 6).alias("recall"), F.round((F.col("r") + F.col("o")) / 2, 6).alias("accuracy"), F.round(F.try_divide(F.col("r"), F.col("r") + wrong), 6).alias("precision"), F.round(F.try_divide(2 * F.col("r"), F.col("r") + wrong + 1), 6).alias("f1"))


@query("M21_predictions")
def predictions(spark, d):
    """Rated pairs give their mean rating as a share, the others the model's probability."""
    model = m.train(matrix(spark, d), MODELS)
    wide = scores(spark, d).groupBy(*KEY).pivot("model", list(MODELS)).agg(F.max("score")).fillna(0.0, list(MODELS))
    mean = view(spark, d, "fx_rating").groupBy(F.col("place_id").alias("venue_id"), "pi_id").agg(F.count("*").alias("n"), F.avg("rating").alias("rating"))
    out = m.predicted(model, wide, MODELS).join(mean, list(KEY), "left")
    score = F.when(F.col("n") >= 2, F.col("rating") / 5).otherwise(F.col("probability"))
    return out.select(*KEY, F.when(F.col("n") >= 2, "user").otherwise("predict").alias("type"), F.round(score, 6).alias("score"))


def english(spark, d):
    from mobtrace.plans.interests import STOP

    words = F.filter(x.tokens(F.col("text")), lambda w: ~w.isin(*STOP))
    return view(spark, d, "fx_tip").filter("lang = 'en'").select("tip_id", "venue_id", words.alias("words")).filter(F.size("words") > 0)


def by_topic(spark, d, topics: int = 20, least: int = 20):
    """A model of the English tips of each category that has ``least`` (the operator's default of 100 leaves none of the small tables): weights of terms, and each tip's shares."""
    c = view(spark, d, "fx_category").select(F.col("category_id").alias("extra_category"), F.col("parent_id").alias("category_id"))
    v = view(spark, d, "fx_venue").join(c, "extra_category").select("venue_id", "category_id")
    v = cut(v.join(view(spark, d, "fx_tip").select("venue_id").distinct(), "venue_id", "left_semi"), "tipped")  # few venues have tips, and texts needn't move to them
    tips = cut(english(spark, d).join(v, "venue_id").select("tip_id", "category_id", "words"), "tips")
    weights, mixes = m.topics(tips, topics, least)
    return weights, mixes.select("category_id", "tip_id", F.posexplode("mix").alias("topic", "share"))


@query("M9_topics")
def topics(spark, d):
    """The mean mix of the topics of each category that has enough tips, under its own model, best topics first."""
    _, mix = by_topic(spark, d)
    by = mix.groupBy("category_id", "topic").agg(F.avg("share").alias("share"))
    w = Window.partitionBy("category_id").orderBy(F.desc("share"), "topic")
    return by.select("category_id", F.col("topic").cast("long").alias("topic"), F.round("share", 4).alias("share"), F.row_number().over(w).cast("long").alias("rank"))


@query("T5_topic_words")
def topic_words(spark, d, n: int = 10, docs: int = 5):
    """The first words of each category's topics, and the tips that have most of them."""
    weights, mix = by_topic(spark, d)
    return described_topics(weights, mix, n, docs)


def described_topics(weights, mix, n: int, docs: int):
    own = r.top(weights.select("category_id", "term", F.posexplode("weights").alias("topic", "weight")), ["category_id", "topic"], [F.desc("weight"), F.col("term")], n)
    own = own.groupBy("category_id", "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term"))), lambda x_: x_["term"]).alias("words"))
    best = r.top(mix, ["category_id", "topic"], [F.desc("share"), F.col("tip_id")], docs).groupBy("category_id", "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "tip_id"))), lambda x_: x_["tip_id"]).alias("tips"))
    return own.join(best, ["category_id", "topic"]).select("category_id", F.col("topic").cast("long").alias("topic"), "words", "tips")


@query("M10_factor_topics")
def factor_topics(spark, d, terms: int = 1000):
    """Non-negative factors of tips by terms, weighted by tf-idf; the model has a fixed number of terms, the commonest; the first words of each topic."""
    words = english(spark, d).select("tip_id", F.explode("words").alias("word"))
    tf = words.groupBy("tip_id", "word").agg(F.count("*").alias("tf"))
    known = tf.groupBy("word").agg(F.count("*").alias("df")).filter("df >= 2").orderBy(F.desc("df"), "word").limit(terms)
    known = r.numbered(known, [F.desc("df"), F.col("word")], "term").withColumn("term", (F.col("term") - 1).cast("int"))
    total = words.agg(F.count_distinct("tip_id").alias("n"))
    weights = tf.join(known, "word").crossJoin(F.broadcast(total)).select(F.col("tip_id").cast("int").alias("doc"), "term", (F.col("tf") * F.log((F.col("n") + 1.0) / (F.col("df") + 1))).cast("float").alias("weight")).filter("weight > 0")  # one row is sent
    model = m.factor_topics(weights)
    found = model.itemFactors.select(F.col("id").alias("term"), F.posexplode("features").alias("topic", "weight")).join(known, "term")
    return r.top(found, ["topic"], [F.desc("weight"), F.col("word")], 10).select(F.col("topic").cast("long").alias("topic"), "word", F.round("weight", 4).alias("weight"))


@query("M22_place_embeddings")
def place_embeddings(spark, d, size: int = 300, first: int = 5, near: int = 3, least: int = 5):
    """Vectors of interests from the sequences of users' check-ins, each place standing for its first interests; with each interest's nearest ones."""
    from mobtrace.operators import interests

    s = view(spark, d, "fx_score").groupBy("venue_id", "pi_id").agg(F.max("score").alias("score"))
    own = r.top(s, ["venue_id"], [F.desc("score"), F.col("pi_id")], first).groupBy("venue_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pi_id"))), lambda x_: x_["pi_id"].cast("string")).alias("words"))
    c = view(spark, d, "fx_checkin").withColumn("venue_id", F.col("venue_id") % 50)
    steps = c.join(own, "venue_id").withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).filter(F.col("n") >= least)
    v = cut(m.sequence_vectors(steps, "user_id", ["ts", "venue_id"], "words", size).select(F.col("word").cast("long").alias("pi_id"), "vector"), "vectors")
    best = interests.best_matches(v.withColumnRenamed("pi_id", "of"), "vector", v, "pi_id", "vector", near + 1).filter("pi_id <> of")
    best = best.groupBy("of").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pi_id"))), 1, near), lambda x_: x_["pi_id"]).alias("nearest"))
    return v.join(best, F.col("pi_id") == F.col("of"), "left").select("pi_id", "vector", "nearest")


@query("C7_topics_of_category")
def topics_of_category(spark, d, n: int = 10, docs: int = 5):
    """The topics of each category in the order of their rank, with their first words and the category's tips that have most of them."""
    weights, mix = by_topic(spark, d)
    by = mix.groupBy("category_id", "topic").agg(F.avg("share").alias("share"))
    rank = F.row_number().over(Window.partitionBy("category_id").orderBy(F.desc("share"), "topic")).cast("long")
    out = by.select("category_id", F.col("topic").cast("long").alias("topic"), rank.alias("rank")).join(described_topics(weights, mix, n, docs), ["category_id", "topic"])
    return out.select("category_id", "rank", "topic", "words", "tips").orderBy("category_id", "rank")


@query("X19_random_points", oracle("WITH u AS (SELECT venue_id, lat, lon, ('0x' || substr(md5(venue_id || ':1'), 1, 8))::BIGINT::DOUBLE / 4294967296 AS a, ('0x' || substr(md5(venue_id || ':2'), 1, 8))::BIGINT::DOUBLE / 4294967296 AS b FROM fx_venue) SELECT venue_id, round(lat + degrees(100 * sqrt(a) * sin(2 * pi() * b) / 6378137.0), 8) AS lat, round(lon + degrees(100 * sqrt(a) * cos(2 * pi() * b) / (6378137.0 * cos(radians(lat)))), 8) AS lon FROM u"))
def random_points(spark, d, radius: float = 100.0):
    """A point within a radius of each venue, drawn by its key and a seed."""
    a, b = m.uniform(F.col("venue_id"), seed=1), m.uniform(F.col("venue_id"), seed=2)
    far, turn = radius * F.sqrt(a), 2 * F.pi() * b
    lat = F.col("lat") + F.degrees(far * F.sin(turn) / 6378137.0)
    lon = F.col("lon") + F.degrees(far * F.cos(turn) / (6378137.0 * F.cos(F.radians("lat"))))
    return view(spark, d, "fx_venue").select("venue_id", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


@query("A19_instances_of_types", oracle("SELECT t.leaf_category, t.subject, t.venue_id AS instance, n.n FROM (SELECT DISTINCT leaf_category, extra_category AS subject, venue_id FROM fx_venue WHERE leaf_category NOT IN (SELECT parent_id FROM fx_category)) t JOIN (SELECT extra_category, count(*) AS n FROM fx_venue GROUP BY extra_category) n ON t.subject = n.extra_category", "fx_venue", "fx_category"))
def instances_of_types(spark, d):
    """The sets of instances and subjects of each leaf type, a row for each member, with the subject's count."""
    v = view(spark, d, "fx_venue")
    inner = view(spark, d, "fx_category").select(F.col("parent_id").alias("leaf_category")).distinct()
    n = v.groupBy(F.col("extra_category").alias("subject")).agg(F.count("*").alias("n"))
    t = v.join(inner, "leaf_category", "left_anti").select("leaf_category", F.col("extra_category").alias("subject"), F.col("venue_id").alias("instance")).distinct()
    return t.join(n, "subject").select("leaf_category", "subject", "instance", "n")
