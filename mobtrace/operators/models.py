"""Stacking, resampling, evaluation and topic models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobtrace.sources.scratch import cut

#: Rows of a block in which neighbours are sought.
BLOCK = 20_000


def uniform(*keys: Column, seed: int) -> Column:
    """A number in [0, 1) that hangs on the keys and a seed only."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(seed))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def stacking_matrix(scores: DataFrame, ratings: DataFrame, models: Sequence[str]) -> DataFrame:
    """A row for each (venue, interest): a column for each model's score, 0 where it has none; label: mean rating of 4 or more."""
    wide = scores.groupBy("venue_id", "pi_id").pivot("model", list(models)).agg(F.max("score"))
    mean = ratings.groupBy(F.col("place_id").alias("venue_id"), "pi_id").agg(F.avg("rating").alias("rating"))
    both = mean.join(wide, ["venue_id", "pi_id"], "left").fillna(0.0, list(models))
    return both.select("venue_id", "pi_id", *models, (F.col("rating") >= 4).cast("double").alias("label"))


def nearest(rows: DataFrame, features: Sequence[str], key: Sequence[str], n: int, k: int, block: int = BLOCK) -> DataFrame:
    """key, features, near: the features of the k nearest other rows, the nearest first, over all ``n`` rows.

    Every block of rows meets every shard of the rows, so a group holds two blocks at most.
    """
    blocks = max(1, -(-n // block))
    names = [*key, *features]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = rows.select(*key, *[F.col(f).cast("double").alias(f) for f in features])
    at = F.pmod(F.xxhash64(*key), F.lit(blocks))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = rows.withColumn("__q", at.cast("int")).withColumn("__s", each).withColumn("__asks", F.lit(True))
    shards = rows.withColumn("__s", at.cast("int")).withColumn("__q", each).withColumn("__asks", F.lit(False))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        q, s = group[group["__asks"]], group[~group["__asks"]]
        if not len(s):
            return q[names].assign(near=pd.Series([[]] * len(q), q.index, object))
        x, y, found = q[list(features)].to_numpy(float), s[list(features)].to_numpy(float), []
        order = np.lexsort(y.T[::-1])  # equal distances go by features
        s, y = s.iloc[order], y[order]
        ids = pd.concat([q[list(key)], s[list(key)]]).groupby(list(key), sort=False, dropna=False).ngroup().to_numpy()
        mine, theirs = ids[: len(q)], ids[len(q) :]
        for i in range(0, len(x), 256):
            d = sum((x[i : i + 256, j, None] - y[None, :, j]) ** 2 for j in range(len(features)))
            d[mine[i : i + 256, None] == theirs[None]] = np.inf
            last = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
            for row, most in zip(d, last, strict=True):
                c = np.flatnonzero((row <= most) & (row < np.inf))
                c = c[np.argsort(row[c], kind="stable")[:k]]
                found.append([{"d": float(row[j]), "x": y[j].tolist()} for j in c])
        return q[names].assign(near=pd.Series(found, q.index, object))

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in key), *(f"{f} double" for f in features), "near array<struct<d:double,x:array<double>>>"])
    parts = own.unionByName(shards).groupBy("__q", "__s").applyInPandas(run, schema)
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    return parts.groupBy(*names).agg(F.transform(best, lambda c: c["x"]).alias("near"))


def oversampled(rows: DataFrame, features: Sequence[str], key: Sequence[str], k: int = 5, seed: int = 3) -> DataFrame:
    """Adds synthetic rows of the rarer label until both are about as many.

    Each lies between a row and one of its k nearest of the same label, drawn anew for each
    synthetic row. A label of one row only has no neighbours and stays alone.
    """
    n = {r.label: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return rows
    rare, often = sorted(n, key=lambda v: (n[v], v))
    times, rest = divmod(n[often] - n[rare], n[rare])
    own = rows.filter(F.col("label") == rare)
    share = F.lit(times)
    if rest:  # one row more for some, those of the smallest keyed numbers
        error = 0.0 if n[rare] < 100_000 else 1e-4
        chance = uniform(*[F.col(c) for c in key], F.lit("more"), seed=seed)
        if (at := (rest - 0.5) / n[rare] - error) > 0:
            most = own.select(chance.alias("u")).approxQuantile("u", [at], error)[0]
            share = share + (chance <= most).cast("int")
    near = nearest(own, features, key, n[rare], k).withColumn("__times", share).filter((F.col("__times") > 0) & (F.size("near") > 0))
    near = near.withColumn("__n", F.explode(F.sequence(F.lit(1), "__times")))
    drawn = lambda what: uniform(*[F.col(c) for c in key], F.col("__n"), F.lit(what), seed=seed)
    near = near.withColumn("__u", drawn("u")).withColumn("__to", F.col("near")[F.floor(drawn("to") * F.size("near")).cast("int")])
    made = near.select(*key, *[(F.col(f) + F.col("__u") * (F.col("__to")[i] - F.col(f))).alias(f) for i, f in enumerate(features)], F.lit(rare).alias("label"))
    return rows.select(*key, *features, "label").unionByName(made)


def assembled(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)


def train(rows: DataFrame, features: Sequence[str]):
    """Logistic regression on the given columns."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(maxIter=20, regParam=0.01).fit(assembled(rows, features))


def saved(model, path: str):
    """The model as it is read again from ``path``, where it is kept for later runs; a model there is replaced."""
    from pyspark.ml.classification import LogisticRegressionModel

    model.write().overwrite().save(path)
    return LogisticRegressionModel.load(path)


def predicted(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(assembled(rows, features))
    return out.select(*rows.columns, F.col("prediction"), vector_to_array("probability")[1].alias("probability"))


def confusion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True and false positives and negatives, with the usual ratios; null where nothing is divided."""
    t, p = F.col("label") == 1, F.col("prediction") == 1
    c = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 6)
    return c.select(*by, "tp", "fp", "fn", "tn", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def ranked(scores: DataFrame) -> DataFrame:
    w = Window.partitionBy("model", "venue_id").orderBy(F.desc("score"), "pi_id")
    return scores.withColumn("rank", F.row_number().over(w).cast("long"))


def average_precision(judged: DataFrame) -> DataFrame:
    """Mean precision at the ranks of relevant interests of each (model, venue); null without any."""
    w = Window.partitionBy("model", "venue_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = judged.withColumn("hits", F.sum("relevant").over(w))
    at = F.when(F.col("relevant") == 1, F.col("hits") / F.col("rank"))
    return hits.groupBy("model", "venue_id").agg(F.round(F.avg(at), 6).alias("average_precision"))


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma for positive numbers: moved up by six, then the asymptotic series."""
    y = x + 6
    return np.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) - sum(1 / (x + i) for i in range(6))


def topic_mix(n: np.ndarray, terms: np.ndarray, alpha: float, most: int = 20, near: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """A text's variational mix of topics, and its counts ``n`` dealt to topics; ``terms`` (term by topic) are expected log weights.

    Ends after ``most`` steps at the latest; each step betters the bound, so those of early rounds needn't converge.
    """
    beta, gamma = np.exp(terms), np.ones(terms.shape[1])
    for _ in range(most):
        theta = np.exp(digamma(gamma) - digamma(gamma.sum()))
        part = n / (beta @ theta + 1e-100)
        last, gamma = gamma, alpha + theta * (beta.T @ part)
        if np.abs(gamma - last).mean() < near:
            break
    return gamma, theta * beta * part[:, None]


def topic_mixes(n: np.ndarray, terms: np.ndarray, alpha: float, most: int = 20, near: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """``topic_mix`` of many texts at once, a row of ``n`` (text by term) each: the mixes, and the counts dealt to topics in sum over the texts."""
    beta, gamma = np.exp(terms), np.ones((len(n), terms.shape[1]))
    theta, part, left = np.empty_like(gamma), np.empty(n.shape), np.arange(len(n))
    for _ in range(most):
        last = gamma[left]
        t = np.exp(digamma(last) - digamma(last.sum(axis=1, keepdims=True)))
        p = n[left] / (t @ beta.T + 1e-100)
        gamma[left], theta[left], part[left] = alpha + t * (p @ beta), t, p
        left = left[np.abs(gamma[left] - last).mean(axis=1) >= near]
        if not len(left):
            break
    return gamma, beta * (part.T @ theta)


#: Tips whose counts are one row of a bag, texts whose mixes are worked out at once, and words that are counted at once.
PACKED, AT_ONCE, WORDS = 1000, 256, 1_000_000


def counted_grams(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The terms of one and two words of texts: for each text and different term the text's number, the term's and how often it is there (by text, then term), and the terms. No term holds a null or goes over one."""
    flat = words.flatten().cast(pa.string()).dictionary_encode()
    code, names = flat.indices.fill_null(-1).to_numpy().astype(np.int64), flat.dictionary
    text = np.repeat(np.arange(len(words)), words.value_lengths().fill_null(0).to_numpy())
    size = max(1, len(names))
    pair = (text[1:] == text[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0)
    grams = np.concatenate([code[code >= 0], size + code[:-1][pair] * size + code[1:][pair]])
    found, own = np.unique(grams, return_inverse=True)
    key, n = np.unique(np.concatenate([text[code >= 0], text[:-1][pair]]) * max(1, len(found)) + own, return_counts=True)
    one, two = found[found < size], found[found >= size] - size
    terms = pa.concat_arrays([names.take(pa.array(one)), pc.binary_join_element_wise(names.take(pa.array(two // size)), names.take(pa.array(two % size)), " ")])
    return key // max(1, len(found)), key % max(1, len(found)), n, terms


def slices(batch: pa.RecordBatch, words: str) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about WORDS words, a text at least."""
    upto = np.cumsum(batch.column(batch.schema.get_field_index(words)).value_lengths().fill_null(0).to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WORDS, side="right")))
        yield batch.slice(at, end - at)
        at = end


def topics(tips: DataFrame, k: int = 20, least: int = 100, terms: int = 1000, rounds: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """A topic model for each category with ``least`` tips, of tips (tip_id, category_id, words): all are fitted in the same rounds.

    Variational Bayes over whole categories. Words and pairs are counted where their tip lies, a
    column of many tips at a time, and tips are packed with their counts of the model's terms, some PACKED a row. In a round
    such a row meets its category's weights (``terms`` by ``k`` numbers), its tips are worked
    out together, and what they deal to topics leaves the task as one sum; the sums are added up by
    category and term. Terms of a model are those of one and two words that at least two and
    at most 95 of a hundred of its tips hold, the ``terms`` most frequent ones. Gives the
    weights (category_id, term, weights: by topic, of all terms adding up to 1 where divided
    by their sum) and the mixes (tip_id, category_id, mix: by topic, adding up to 1). A tip
    without any of the terms has an even mix; a tip of several categories counts in each.
    """
    tip = ["category_id", "tip_id"]
    size = tips.groupBy("category_id").agg(F.count_distinct("tip_id").alias("size"), F.count("*").alias("rows")).filter(F.col("size") >= least)
    size = cut(size, "sizes")
    used = tips.join(size.select("category_id"), "category_id", "left_semi").select(*tip, "words")
    if not size.filter("rows > size").isEmpty():  # what a tip has in several rows is one list, with nulls between
        used = used.groupBy(*tip).agg(F.flatten(F.collect_list(F.concat("words", F.array(F.lit(None).cast("string"))))).alias("words"))
    kinds = dict(used.dtypes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, "words")):
            of = batch.column(0).dictionary_encode()
            text, term, n, names = counted_grams(batch.column(1))
            key, own = np.unique(of.indices.to_numpy()[text].astype(np.int64) * max(1, len(names)) + term, return_inverse=True)
            category, term = key // max(1, len(names)), key % max(1, len(names))
            sums = [pa.array(np.bincount(own, w, len(key)).astype(np.int64)) for w in (None, n)]
            yield pa.RecordBatch.from_arrays([of.dictionary.take(pa.array(category)), names.take(pa.array(term)), *sums], names=["category_id", "term", "df", "all"])

    often = used.select("category_id", "words").mapInArrow(counted, f"category_id {kinds['category_id']}, term string, df long, all long")
    often = often.groupBy("category_id", "term").agg(F.sum("df").alias("df"), F.sum("all").alias("all")).filter("df >= 2")
    often = often.join(size, "category_id").filter(F.col("df") <= 0.95 * F.col("size"))
    order = Window.partitionBy("category_id").orderBy(F.desc("all"), F.col("term"))
    vocabulary = cut(often.withColumn("at", F.row_number().over(order) - 1).filter(F.col("at") < terms).select("category_id", "term", "at"), "vocabulary")
    parts = F.ceil(F.col("size") / PACKED)
    dealt_out = used.join(size, "category_id").select(*tip, "words", F.pmod(F.xxhash64("tip_id"), parts).alias("part"))
    known = vocabulary.join(size, "category_id").select("category_id", "term", "at", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))

    schema = f"category_id {kinds['category_id']}, part long, tips array<struct<tip_id:{kinds['tip_id']},terms:array<struct<at:int,n:int>>>>"

    def bagged(key: tuple[pa.Scalar, ...], own: pa.Table, terms: pa.Table) -> pa.Table:
        own, pair = own.combine_chunks(), pa.struct([("at", pa.int32()), ("n", pa.int32())])
        ids, held = [own["tip_id"].slice(0, 0).combine_chunks()], [pa.array([], pa.list_(pair))]
        for piece in (p for batch in own.to_batches() for p in slices(batch, "words")):
            text, term, n, names = counted_grams(piece.column(piece.schema.get_field_index("words")))
            at = pc.index_in(names, terms["term"].combine_chunks()).fill_null(-1).to_numpy()[term]
            text, at, n = text[at >= 0], terms["at"].to_numpy()[at[at >= 0]], n[at >= 0]
            some, first = np.unique(text, return_index=True)
            pairs = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int32())], fields=list(pair))
            held.append(pa.ListArray.from_arrays(pa.array([*first, len(text)], pa.int32()), pairs))
            ids.append(piece.column(piece.schema.get_field_index("tip_id")).take(pa.array(some)))
        every = pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(held)], names=["tip_id", "terms"])
        lists = pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every)
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key), lists], names=["category_id", "part", "tips"])

    bag = dealt_out.groupBy("category_id", "part").cogroup(known.groupBy("category_id", "part")).applyInArrow(bagged, schema)
    bag = cut(bag, "bag")
    start = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: 0.5 + F.pmod(F.xxhash64("term", i, F.lit(seed)), F.lit(1_000_000)) / 1_000_000)
    weights = cut(vocabulary.select("category_id", "at", start.alias("weights")), "weights")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Category, ids of tips, counts (tip by term) and expected log weights, for some tips at a time."""
        for batch in batches:
            for category, held, model in zip(*batch.columns, strict=True):
                w = model.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                e = digamma(w) - digamma(w.sum(axis=0))
                for i in range(0, len(held.values), AT_ONCE):
                    some = held.values.slice(i, AT_ONCE)
                    own = some.field("terms")
                    n, flat = np.zeros((len(some), len(w))), own.flatten()
                    n[np.repeat(np.arange(len(some)), own.value_lengths().to_numpy()), flat.field("at").to_numpy()] = flat.field("n").to_numpy()
                    yield category, some.field("tip_id"), n, e

    def listed(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(np.arange(0, values.size + 1, k, dtype=np.int32), values.ravel())

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for category, _, n, e in packed(batches):
            if total is not None and category != last:
                yield sums(last, total)
                total = None
            own = topic_mixes(n, e, 1 / k)[1]
            last, total = category, own if total is None else total + own
        if total is not None:
            yield sums(last, total)

    def sums(category: pa.Scalar, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(category, len(total)), pa.array(np.arange(len(total), dtype=np.int32)), listed(total)], names=["category_id", "at", "dealt"])

    def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for category, ids, n, e in packed(batches):
            gamma = topic_mixes(n, e, 1 / k)[0]
            yield pa.RecordBatch.from_arrays([pa.repeat(category, len(ids)), ids, listed(gamma / gamma.sum(axis=1, keepdims=True))], names=["category_id", "tip_id", "mix"])

    def met(weights: DataFrame) -> DataFrame:
        """Each row of the bag with its category's weights in the order of the terms."""
        models = weights.groupBy("category_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "weights"))), lambda x: x["weights"]).alias("weights"))
        own = bag.select("category_id", "part").join(models, "category_id")
        return bag.join(own, ["category_id", "part"]).select("category_id", "tips", "weights")

    for _ in range(rounds):
        flat = met(weights).mapInArrow(dealt, f"category_id {kinds['category_id']}, at int, dealt array<double>")
        summed = F.array(*[F.sum(F.col("dealt")[i]) + 1 / k for i in range(k)])
        weights = cut(flat.groupBy("category_id", "at").agg(summed.alias("weights")), "weights")
    own = met(weights).mapInArrow(mixed, f"category_id {kinds['category_id']}, tip_id {kinds['tip_id']}, mix array<double>")
    mix = tips.select("tip_id", "category_id").distinct().join(size.select("category_id"), "category_id", "left_semi").join(own, tip, "left")
    mix = cut(mix.withColumn("mix", F.coalesce("mix", F.array_repeat(F.lit(1 / k), k))), "mixes")
    return vocabulary.join(weights, ["category_id", "at"]).select("category_id", "term", "weights"), mix


def factor_topics(weights: DataFrame, k: int = 5, seed: int = 1, share: int = 1_000_000):
    """Non-negative factors of (doc, term, weight): documents by topics and terms by topics. Documents go in blocks of some ``share`` weights, ten at least, so a task's part is bounded."""
    from pyspark.ml.recommendation import ALS

    weights = cut(weights, "term-weights")
    blocks = max(10, -(-weights.count() // share))
    return ALS(rank=k, nonnegative=True, implicitPrefs=True, maxIter=5, seed=seed, numUserBlocks=blocks, userCol="doc", itemCol="term", ratingCol="weight").fit(weights)


def sequence_vectors(steps: DataFrame, user: str, order: list[str], words: str, size: int, window: int = 2, least: int = 2, rounds: int = 5, stretch: int = 200, share: int = 200_000) -> DataFrame:
    """(word, vector) of the words of users' steps in their order; words that come fewer than ``least`` times have none.

    A user's steps go to the training as stretches of ``stretch`` steps, so no history is one
    list. Contexts don't reach over the ends of a stretch; the training cuts its sentences at
    1,000 words anyway. Steps without words don't count. In each round some ``share`` words
    are one task's, and the tasks' vectors are averaged.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    w = Window.partitionBy(user).orderBy(*order)
    rows = steps.filter(F.size(words) > 0).select(F.col(user).alias("__user"), F.row_number().over(w).alias("__at"), F.col(words).alias("__words"))
    listed = rows.groupBy("__user", F.floor((F.col("__at") - 1) / stretch).alias("__stretch")).agg(F.array_sort(F.collect_list(F.struct("__at", "__words"))).alias("__steps"))
    sentences = listed.select(F.flatten(F.transform("__steps", lambda e: e["__words"])).alias("words"))
    sentences = cut(sentences, "sentences")
    n = sentences.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=least, maxIter=rounds, numPartitions=max(1, n // share), seed=1, inputCol="words", outputCol="v").fit(sentences)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))
