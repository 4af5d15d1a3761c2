"""Balanced logistic classifiers per label: in the dual from one kernel for few queries, over sparse rows for many."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vector, Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import normalize_lexical_text
from lodestone.operators import tfidf
from lodestone.operators.scores import row_scale
from lodestone.sources.io import positions, settled

COST, PRIOR, CHAR_WEIGHT = 0.3, 0.1, 4.0
#: Most training queries that are fitted by a kernel, which is n * n doubles; more are fitted over their rows.
MAX_TRAIN = 4000
#: Classifiers that are fitted at a time over rows, and when one has converged.
AT_ONCE, STEPS, TOLERANCE = 4, 1000, 1e-13
#: Target queries that one task scores at once, and kernel weights that are sent to the tasks at once.
BLOCK, WEIGHTS = 500, 5_000_000


def kfold(n: int, seed: int, splits: int = 5) -> np.ndarray:
    """Fold of each row: a seeded shuffle cut into blocks, the first ones larger by one."""
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    folds = np.empty(n, int)
    for fold, rows in enumerate(np.array_split(order, splits)):
        folds[rows] = fold
    return folds


def numbered_folds(queries: DataFrame, seed: int, splits: int = 5) -> DataFrame:
    """(query_id, pos, fold): `kfold` of the queries by ascending id. The driver holds the permutation, but no ids."""
    by_id = settled(queries.select("query_id").repartitionByRange("query_id").sortWithinPartitions("query_id"))
    placed = positions(by_id)
    n = by_id.count()
    dealt = queries.sparkSession.createDataFrame(pd.DataFrame({"pos": np.arange(n), "fold": kfold(n, seed, splits).astype(np.int32)}), "pos long, fold int")
    return placed.join(dealt, "pos").select("query_id", "pos", "fold")


def kernel(train: DataFrame, target: DataFrame) -> DataFrame:
    """(query_id, ref_id, k): inner products of word and weighted character features, plus the bias.

    The vocabulary and its weights are the training queries'; pairs that share nothing are absent.
    """
    parts = []
    for analyzer, min_df, weight in (("word", 1, 1.0), ("char", 2, CHAR_WEIGHT**2)):
        corpus = train.select(F.col("query_id").alias("article_id"), normalize_lexical_text(F.col("text")).alias("text"))
        asked = target.select("query_id", normalize_lexical_text(F.col("text")).alias("text"))
        parts.append(tfidf.tfidf_scores(corpus, asked, analyzer, min_df, True).withColumn("score", F.col("score") * weight))
    return parts[0].unionByName(parts[1]).groupBy("query_id", F.col("article_id").alias("ref_id")).agg((F.sum("score") + 1.0).alias("k"))


def solve(gram: np.ndarray, positive: np.ndarray, cost: float = COST, steps: int = 200) -> np.ndarray:
    """Kernel weights of the balanced L2 logistic loss with a penalised bias, by Newton's method."""
    n, y = len(positive), np.where(positive, 1.0, -1.0)
    c = cost * np.where(positive, n / (2 * positive.sum()), n / (2 * (~positive).sum()))
    beta = np.zeros(n)
    for _ in range(steps):
        f = gram @ beta
        s = 1 / (1 + np.exp(np.clip(y * f, -500, 500)))
        d = c * s * (1 - s)
        # stationary point of beta = c * y * s(K beta), linearised
        step = np.linalg.solve(np.eye(n) + d[:, None] * gram, c * y * s - beta)
        beta += step
        if np.abs(step).max() < 1e-12:
            break
    return beta


def _one_label(ids: np.ndarray, gram):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        positive = np.zeros(len(ids), bool)
        positive[np.searchsorted(ids, rows["ref_id"].to_numpy())] = True
        beta = np.zeros(len(ids)) if positive.all() else solve(gram.value, positive)
        return pd.DataFrame({"article_id": rows["article_id"].iloc[:1], "freq": [float(positive.sum())], "always": [bool(positive.all())], "beta": [beta]})

    return run


def _one_block(ids: np.ndarray, fitted):
    """Probabilities of all labels for one block of targets; kernel rows hold what is above the bias."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        articles, freq, always, beta = fitted.value
        queries, at = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
        near = rows["ref_id"].notna().to_numpy()
        k = np.zeros((len(queries), len(ids)))
        k[at[near], np.searchsorted(ids, rows["ref_id"][near].to_numpy(np.int64))] = rows["k"][near] - 1.0
        logit = k @ beta.T + beta.sum(1)
        p = np.where(always, 1.0, 1 / (1 + np.exp(-np.clip(logit, -500, 500))))
        return pd.DataFrame({"query_id": np.repeat(queries, len(articles)), "article_id": np.tile(articles, len(queries)), "score": p.ravel(), "freq": np.tile(freq, len(queries))})

    return run


def _with_prior(raw: DataFrame, top: float) -> DataFrame:
    scaled = row_scale(raw).withColumn("score", F.col("score") + PRIOR * F.col("freq") / F.lit(float(top or 1.0)))
    return row_scale(scaled.select("query_id", "article_id", "score"))


def _vector(size: int):
    def of(terms, sign) -> Vector:
        return Vectors.sparse(size, sorted((t["at"], sign * t["w"]) for t in terms))

    return F.udf(of, VectorUDT())


def vectors(train: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, x, sign) of both: sparse word and weighted character features and the bias, whose inner products are the kernel.

    The vocabulary is the training queries', numbered in the order of its saved table. Every other
    training row is turned round (sign -1): with its class turned, too, its loss is the same, and no
    feature is constant, which the solver would leave out.
    """
    parts = []
    for analyzer, min_df, weight in (("word", 1, 1.0), ("char", 2, CHAR_WEIGHT)):
        lexical = lambda df, key: df.select(F.col("query_id").alias(key), normalize_lexical_text(F.col("text")).alias("text"))
        space = tfidf.Space(lexical(train, "article_id"), analyzer, min_df, True)
        own = space.entries().select(F.col("article_id").alias("query_id"), "term", (F.col("w") * weight).alias("w"))
        asked = space.asked(lexical(target, "query_id")).select("query_id", "term", (F.col("qw") * weight).alias("w"))
        parts.append([df.withColumn("analyzer", F.lit(analyzer)) for df in (own, asked, space.weights.select("term"))])
    vocabulary = positions(settled(parts[0][2].union(parts[1][2]))).withColumnRenamed("pos", "at")
    size = vocabulary.count() + 1
    make = _vector(size)
    out = []
    for side, queries in ((0, train), (1, target)):
        rows = parts[0][side].union(parts[1][side]).join(vocabulary, ["term", "analyzer"]).select("query_id", "at", "w")
        rows = rows.union(queries.select("query_id", F.lit(size - 1).cast("long"), F.lit(1.0)))
        out.append(settled(rows.groupBy("query_id").agg(F.collect_list(F.struct("at", "w")).alias("terms"))))
    known = positions(out[0]).select("query_id", "terms", F.when(F.col("pos") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    return tuple(settled(df.select("query_id", make("terms", "sign").alias("x"), "sign")) for df in (known, out[1].withColumn("sign", F.lit(1.0))))


def logistic_rows(train: DataFrame, target: DataFrame, labels: DataFrame) -> DataFrame:
    """`logistic_scores` by L-BFGS over all training rows: no kernel, and no sample of them.

    Each label's loss and gradient are sums over the partitions' sparse rows, aggregated by a tree;
    weights of one label have the vocabulary's size. AT_ONCE labels are fitted at a time.
    """
    known, asked = vectors(train, target)
    own = settled(labels.select(F.col("ref_id").alias("query_id"), "article_id").join(known.select("query_id"), "query_id", "left_semi").distinct())
    n, freq = known.count(), {r[0]: r[1] for r in own.groupBy("article_id").agg(F.count("*")).collect()}  # one row a label
    solver = LogisticRegression(featuresCol="x", labelCol="y", weightCol="c", regParam=1 / (COST * n) if n else 0.0, fitIntercept=False, standardization=False, maxIter=STEPS, tol=TOLERANCE)

    def fitted(article: int) -> DataFrame:
        m = freq[article]
        if m == n:
            return asked.select("query_id", F.lit(article).alias("article_id"), F.lit(1.0).alias("score"), F.lit(float(m)).alias("freq"))
        mine = own.where(F.col("article_id") == article).select("query_id", F.lit(1.0).alias("hit"))
        rows = known.join(mine, "query_id", "left").select("x", F.expr("double((hit is null) = (sign < 0))").alias("y"), F.when(F.col("hit").isNull(), n / (2 * (n - m))).otherwise(n / (2 * m)).alias("c"))
        found = solver.fit(rows).transform(asked)
        return found.select("query_id", F.lit(article).alias("article_id"), vector_to_array("probability")[1].alias("score"), F.lit(float(m)).alias("freq"))

    with ThreadPool(AT_ONCE) as pool:
        parts = pool.map(inheritable_thread_target(train.sparkSession)(fitted), sorted(freq))
    if not parts:
        return train.sparkSession.createDataFrame([], "query_id long, article_id long, score double")
    return _with_prior(reduce(DataFrame.unionByName, parts), max(freq.values()))


def logistic_scores(train: DataFrame, target: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """score(query_id, article_id) of every label that training queries (query_id, text) have.

    Labels (ref_id, article_id) are fitted in parallel, one group each, over the kernel of at most
    `max_train` training queries; with more, over all their rows (`logistic_rows`). Targets are scored by blocks of BLOCK queries on the executors, and the fitted weights reach
    them WEIGHTS numbers at a time.
    """
    if train.count() > max_train:
        return logistic_rows(train, target, labels)
    spark = train.sparkSession
    ids = np.array(sorted(r[0] for r in train.select("query_id").collect()), np.int64)
    train = train.persist()
    gram, k = np.ones((len(ids), len(ids))), kernel(train, train).toPandas()
    if len(k):
        gram[np.searchsorted(ids, k["query_id"]), np.searchsorted(ids, k["ref_id"])] = k["k"]
    own = labels.join(F.broadcast(train.select(F.col("query_id").alias("ref_id"))), "ref_id", "left_semi").select("ref_id", "article_id").distinct()
    fitted = own.groupBy("article_id").applyInPandas(_one_label(ids, spark.sparkContext.broadcast(gram)), "article_id long, freq double, always boolean, beta array<double>").persist()
    top = fitted.agg(F.greatest(F.max("freq"), F.lit(1.0)).alias("m")).first()["m"]
    articles = [r[0] for r in fitted.select("article_id").orderBy("article_id").collect()]
    blocks = 1 + target.count() // BLOCK
    rows = target.select("query_id").join(kernel(train, target), "query_id", "left").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    raw, each = None, max(1, WEIGHTS // max(len(ids), 1))
    for at in range(0, max(len(articles), 1), each):
        some = fitted.where(F.col("article_id").between(articles[at], articles[min(at + each, len(articles)) - 1])).orderBy("article_id").collect() if articles else []
        sent = spark.sparkContext.broadcast((np.array([r["article_id"] for r in some], np.int64), np.array([r["freq"] for r in some]), np.array([r["always"] for r in some], bool), np.array([r["beta"] for r in some]).reshape(len(some), len(ids))))
        part = rows.groupBy("block").applyInPandas(_one_block(ids, sent), "query_id long, article_id long, score double, freq double")
        raw = part if raw is None else raw.unionByName(part)
    return _with_prior(raw, top)


def logistic_oof(queries: DataFrame, labels: DataFrame, seed: int, splits: int = 5) -> DataFrame:
    """Scores of each query by classifiers of the other folds."""
    rows = settled(queries.join(numbered_folds(queries, seed, splits).drop("pos"), "query_id"))
    out = None
    for f in range(splits):
        one = logistic_scores(rows.where(f"fold <> {f}"), rows.where(f"fold = {f}"), labels)
        out = one if out is None else out.unionByName(one)
    return out
