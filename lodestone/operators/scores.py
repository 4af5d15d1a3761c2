"""Score algebra, memory of labelled queries, fusion, ranking and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from functools import reduce

from lodestone.operators.pairs import all_pairs, label_products

# fixed values: weights of the retrieval task
EPS = 1e-8
MEMORY = {"neighbors": 30, "power": 2.0, "threshold": 0.0, "frequency_power": 0.2}
DENSE = {"neighbors": 30, "power": 3.0, "threshold": 0.4, "frequency_power": 0.25}
ROBUST = {"neighbors": 35, "power": 3.5, "threshold": 0.45, "frequency_power": 0.2}
COOCCURRENCE = 0.15
GATE = {"start": 0.55, "width": 0.25}
#: Scores so near to each other may tie when fused and rounded.
TIE = 1e-7


def row_scale(scores: DataFrame, key: str = "query_id") -> DataFrame:
    """Divide by the row's maximum; rows are completed elsewhere when scores may be negative."""
    return scores.withColumn("score", F.col("score") / F.greatest(F.max("score").over(Window.partitionBy(key)), F.lit(EPS)))


def dense_scores(targets: DataFrame, references: DataFrame) -> DataFrame:
    """score(query_id, article_id): `dense_similarity` by row_scale; the maxima are taken in blocks, so pairs are not sorted."""
    most = label_products(targets, references.withColumn("article_id", F.lit(0))).select("target_id", F.greatest("best", F.lit(EPS)).alias("most"))
    pairs = dense_similarity(targets, references).join(F.broadcast(most), "target_id", "left")
    return pairs.select(F.col("target_id").alias("query_id"), F.col("ref_id").alias("article_id"), (F.col("sim") / F.coalesce("most", F.lit(EPS))).alias("score"))


def minmax(scores: DataFrame) -> DataFrame:
    """Candidates' logits to 0..1 within their query."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("score", (F.col("score") - low) / F.greatest(high - low, F.lit(EPS)))


def dot(a: str, b: str) -> Column:
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0d, (t, v) -> t + v)")


def dense_similarity(targets: DataFrame, references: DataFrame) -> DataFrame:
    """sim(target_id, ref_id, sim): every target (target_id, v) against every reference (ref_id, u).

    The result is all pairs by definition; they come as products of blocks.
    """
    return all_pairs(targets, references)


def neighbors(sim: DataFrame, k: int) -> DataFrame:
    """The k references most similar to each target; ties by id."""
    w = Window.partitionBy("target_id").orderBy(F.desc(F.round("sim", 9)), "ref_id")
    return sim.withColumn("r", F.row_number().over(w)).where(f"r <= {k}").drop("r")


def _transfer(sim: DataFrame, labels: DataFrame, p: dict) -> DataFrame:
    near = neighbors(sim, p["neighbors"]).withColumn("w", F.pow(F.greatest(F.col("sim") - p["threshold"], F.lit(0.0)), F.lit(p["power"])))
    return near.join(labels, "ref_id").groupBy(F.col("target_id").alias("query_id"), "article_id").agg(F.sum("w").alias("score"))


def memory_scores(sim: DataFrame, labels: DataFrame, p: dict = MEMORY) -> DataFrame:
    """Labels (ref_id, article_id) of the nearest references, damped by their frequency, scaled."""
    freq = labels.groupBy("article_id").agg(F.count("*").alias("freq"))
    raw = _transfer(sim, labels, p).join(freq, "article_id")
    return row_scale(raw.select("query_id", "article_id", (F.col("score") / F.pow(F.greatest("freq", F.lit(1.0)), F.lit(p["frequency_power"]))).alias("score")))


def label_pairs(labels: DataFrame, most: int = 1000) -> DataFrame:
    """(ref_id, a, b): the ordered pairs of different labels (ref_id, article_id) of each reference.

    References with at most `most` labels are joined with themselves by their id. Labels of the
    others are dealt into blocks of about that many, and a join key is a pair of blocks, so no task
    makes all pairs of a hub.
    """
    n = F.count("*").over(Window.partitionBy("ref_id"))
    counted = labels.select("ref_id", "article_id", n.alias("n"))
    light, heavy = counted.where(f"n <= {most}"), counted.where(f"n > {most}")
    one = light.select("ref_id", F.col("article_id").alias("a")).join(light.select("ref_id", F.col("article_id").alias("b")), "ref_id")
    blocks = F.ceil(F.col("n") / most).cast("int")
    own, every = F.pmod(F.xxhash64("article_id"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    left = heavy.select("ref_id", F.col("article_id").alias("a"), own.alias("at"), every.alias("to"))
    right = heavy.select("ref_id", F.col("article_id").alias("b"), own.alias("to"), every.alias("at"))
    both = left.join(right, ["ref_id", "at", "to"])
    return one.select("ref_id", "a", "b").union(both.select("ref_id", "a", "b")).where("a <> b")


def _cooccurrence(labels: DataFrame) -> DataFrame:
    return label_pairs(labels).groupBy("a", "b").agg(F.count("*").alias("n"))


def _expand(base: DataFrame, cosine: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    """base + weight * scaled spread of base; cosine: a, b, c and what it depends on, query_id or the query's fold (folds: query_id, fold)."""
    on = [c for c in ("query_id", "fold") if c in cosine.columns] + ["a"]
    start = base if folds is None else base.join(folds, "query_id")
    spread = start.withColumnRenamed("article_id", "a").join(cosine, on).groupBy("query_id", F.col("b").alias("article_id")).agg(F.sum(F.col("score") * F.col("c")).alias("score"))
    spread = row_scale(spread).withColumn("score", F.col("score") * COOCCURRENCE)
    return row_scale(base.select("query_id", "article_id", "score").unionByName(spread.select("query_id", "article_id", "score")).groupBy("query_id", "article_id").agg(F.sum("score").alias("score")))


def cooccurrence_scores(sim: DataFrame, labels: DataFrame, p: dict = MEMORY) -> DataFrame:
    freq = labels.groupBy("article_id").agg(F.count("*").alias("f"))
    c = _cooccurrence(labels).join(freq.toDF("a", "fa"), "a").join(freq.toDF("b", "fb"), "b")
    return _expand(memory_scores(sim, labels, p), c.select("a", "b", (F.col("n") / F.greatest(F.sqrt(F.col("fa") * F.col("fb")), F.lit(EPS))).alias("c")))


def fold_memory(sim: DataFrame, labels: DataFrame, folds: DataFrame, p: dict = MEMORY, cooccurrence: bool = False) -> DataFrame:
    """Each target's fold (id, fold) learns from the other folds only, in one pass over all folds."""
    f = folds.select("id", "fold")
    pairs = sim.join(f.toDF("target_id", "tf"), "target_id").join(f.toDF("ref_id", "rf"), "ref_id").where("tf <> rf")
    raw = _transfer(pairs.select("target_id", "ref_id", "sim"), labels, p).join(f.toDF("query_id", "fold"), "query_id")
    total = labels.groupBy("article_id").agg(F.count("*").alias("n"))
    own = labels.join(f.toDF("ref_id", "fold"), "ref_id").groupBy("fold", "article_id").agg(F.count("*").alias("m"))
    raw = raw.join(total, "article_id").join(own, ["fold", "article_id"], "left").withColumn("f", F.col("n") - F.coalesce("m", F.lit(0)))
    base = row_scale(raw.select("query_id", "article_id", (F.col("score") / F.pow(F.greatest("f", F.lit(1.0)), F.lit(p["frequency_power"]))).alias("score")))
    if not cooccurrence:
        return base
    both = label_pairs(labels).join(f.toDF("ref_id", "fold"), "ref_id").groupBy("fold", "a", "b").agg(F.count("*").alias("m"))
    whole = both.groupBy("a", "b").agg(F.sum("m").alias("n"))
    # label pairs are needed for the articles of a fold's base scores only
    asked = base.join(f.toDF("query_id", "fold"), "query_id").select("fold", F.col("article_id").alias("a")).distinct()
    c = asked.join(whole, "a").join(both, ["fold", "a", "b"], "left").withColumn("n", F.col("n") - F.coalesce("m", F.lit(0))).where("n > 0").drop("m")
    for x in ("a", "b"):
        c = c.join(total.toDF(x, "t"), x).join(own.toDF("fold", x, "o"), ["fold", x], "left").withColumn(f"f{x}", F.col("t") - F.coalesce("o", F.lit(0))).drop("t", "o")
    c = c.select("fold", "a", "b", (F.col("n") / F.greatest(F.sqrt(F.col("fa") * F.col("fb")), F.lit(EPS))).alias("c"))
    return _expand(base, c, f.toDF("query_id", "fold"))


def leave_one_out(sim: DataFrame, labels: DataFrame, p: dict = MEMORY, cooccurrence: bool = True) -> DataFrame:
    """Every query against all others: counts of all queries less its own labels, in one pass."""
    mine = labels.select(F.col("ref_id").alias("query_id"), "article_id", F.lit(1).alias("own"))
    total = labels.groupBy("article_id").agg(F.count("*").alias("n"))
    raw = _transfer(sim.where("target_id <> ref_id"), labels, p).join(total, "article_id").join(mine, ["query_id", "article_id"], "left").withColumn("f", F.col("n") - F.coalesce("own", F.lit(0)))
    base = row_scale(raw.select("query_id", "article_id", (F.col("score") / F.pow(F.greatest("f", F.lit(1.0)), F.lit(p["frequency_power"]))).alias("score")))
    if not cooccurrence:
        return base
    less = lambda c, name: mine.select("query_id", F.col("article_id").alias(c), F.col("own").alias(name))
    c = base.select("query_id", F.col("article_id").alias("a")).join(_cooccurrence(labels), "a").join(total.toDF("a", "ta"), "a").join(total.toDF("b", "tb"), "b")
    c = c.join(less("a", "oa"), ["query_id", "a"], "left").join(less("b", "ob"), ["query_id", "b"], "left").na.fill(0, ["oa", "ob"])
    c = c.select("query_id", "a", "b", ((F.col("n") - F.col("oa") * F.col("ob")) / F.greatest(F.sqrt((F.col("ta") - F.col("oa")) * (F.col("tb") - F.col("ob"))), F.lit(EPS))).alias("c"))
    return _expand(base, c)


def weighted(*channels: tuple[float, DataFrame]) -> DataFrame:
    """Weighted sum of sparse channels; what a channel lacks counts 0."""
    parts = [c.select("query_id", "article_id", (F.col("score") * w).alias("score")) for w, c in channels]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "article_id").agg(F.sum("score").alias("score"))


def direct(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    return row_scale(weighted((0.15, lexical), (0.85, dense)))


def reachable(first: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Rows of `direct` scores that can be among the k best of a fusion; labels (article_id): what any other channel can score.

    An article without a label gains by `first` alone, the same share of it as any other, so only
    the k best of those count, with scores so near that rounding may tie them. Where fewer than k of
    them are positive all rows stay, since zeros rank above negative scores.
    """
    known = F.broadcast(labels.select("article_id").distinct())
    others = first.join(known, "article_id", "left_anti")
    floors = rank(others.where("score > 0"), k).where(f"rank = {k}").select("query_id", F.col("score").alias("floor"))
    kept = others.join(F.broadcast(floors), "query_id", "left").where(f"floor is null or score >= floor - {TIE}").select("query_id", "article_id", "score")
    return first.join(known, "article_id", "left_semi").select("query_id", "article_id", "score").unionByName(kept)


def hybrid(lexical: DataFrame, dense: DataFrame, dense_memory: DataFrame, lexical_memory: DataFrame, classifier: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """`first`: the `direct` scores, or their `reachable` rows, if they are there already."""
    return row_scale(weighted((0.35, direct(lexical, dense) if first is None else first), (0.45, dense_memory), (0.05, lexical_memory), (0.15, classifier)))


def _confidence(sim: DataFrame, gate: dict) -> DataFrame:
    return sim.groupBy(F.col("target_id").alias("query_id")).agg(F.least(F.greatest((F.max("sim") - gate["start"]) / gate["width"], F.lit(0.0)), F.lit(1.0)).alias("conf"))


def _robust(first: DataFrame, dense_memory: DataFrame, lexical_memory: DataFrame, classifier: DataFrame, conf: DataFrame, unseen: DataFrame) -> DataFrame:
    gated = dense_memory.join(conf, "query_id").select("query_id", "article_id", (F.col("score") * F.col("conf")).alias("score"))
    shift = weighted((0.275, first), (-0.275, gated)).join(unseen.select("query_id"), "query_id", "left_semi")
    return row_scale(weighted((0.35, first), (0.45, gated), (0.05, lexical_memory), (0.15, classifier), (1.0, shift)))


def robust(lexical: DataFrame, dense: DataFrame, dense_memory: DataFrame, lexical_memory: DataFrame, classifier: DataFrame, sim: DataFrame, labels: DataFrame, gate: dict = GATE) -> DataFrame:
    """Dense memory counts by the gate of the nearest labelled query; unseen best articles shift."""
    first = direct(lexical, dense)
    unseen = rank(first, 1).join(labels.select("article_id").distinct(), "article_id", "left_anti")
    return _robust(first, dense_memory, lexical_memory, classifier, _confidence(sim, gate), unseen)


def fold_robust(lexical: DataFrame, dense: DataFrame, lexical_memory: DataFrame, classifier: DataFrame, sim: DataFrame, labels: DataFrame, folds: DataFrame, p: dict = ROBUST, gate: dict = GATE, first: DataFrame | None = None) -> DataFrame:
    """`robust` for each fold (id, fold) with the labelled queries of the other folds, in one pass over all folds; `first` as in `hybrid`."""
    f = folds.select("id", "fold")
    others = sim.join(f.toDF("target_id", "tf"), "target_id").join(f.toDF("ref_id", "rf"), "ref_id").where("tf <> rf").select("target_id", "ref_id", "sim")
    first = direct(lexical, dense) if first is None else first
    total = labels.groupBy("article_id").agg(F.count("*").alias("n"))
    own = labels.join(f.toDF("ref_id", "fold"), "ref_id").groupBy("fold", "article_id").agg(F.count("*").alias("m"))
    best = rank(first, 1).join(f.toDF("query_id", "fold"), "query_id").join(total, "article_id", "left").join(own, ["fold", "article_id"], "left")
    unseen = best.where("coalesce(n, 0) = coalesce(m, 0)")
    return _robust(first, fold_memory(sim, labels, folds, p), lexical_memory, classifier, _confidence(others, gate), unseen)


def high_score(base: DataFrame, reranked: DataFrame) -> DataFrame:
    return weighted((0.84, base), (0.16, reranked))


def complete(scores: DataFrame, queries: DataFrame, articles: DataFrame, k: int = 10) -> DataFrame:
    """Add the zero scores that a ranking of k articles can need.

    A query with fewer than k positive scores lacks zeros, and they come in the order of article
    ids: among the first k + (its number of rows) ids there are enough that it has no row for. So
    only that many ids are read, and joined with those queries alone.
    """
    rows = scores.groupBy("query_id").agg(F.count("*").alias("rows"), F.count_if(F.col("score") > 0).alias("positive"))
    short = queries.select("query_id").distinct().join(rows, "query_id", "left").na.fill(0, ["rows", "positive"]).where(f"positive < {k}").select("query_id", (F.col("rows") + k).alias("upto")).persist()
    most = short.agg(F.max("upto")).first()[0]
    if most is None:
        return scores
    first = articles.select("article_id").distinct().orderBy("article_id").limit(most).withColumn("at", F.row_number().over(Window.orderBy("article_id")))
    zeros = short.join(first, F.col("at") <= F.col("upto")).select("query_id", "article_id").join(scores, ["query_id", "article_id"], "left_anti")
    return scores.select("query_id", "article_id", "score").unionByName(zeros.withColumn("score", F.lit(0.0)))


def rank(scores: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, article_id, score): the k best; rounded scores, ties by article id."""
    s = scores.withColumn("score", F.round("score", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "article_id")
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where(f"rank <= {k}").select("query_id", "rank", "article_id", "score")


def submission(ranking: DataFrame) -> DataFrame:
    return ranking.groupBy("query_id").agg(F.expr("array_join(transform(array_sort(collect_list(struct(rank, article_id))), x -> cast(x.article_id as string)), ' ')").alias("answer"))


def average_precision(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, ap) at 10 of every query in `relevant` (query_id, article_id); repeats hit once."""
    size = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    first = ranking.where("rank <= 10").groupBy("query_id", "article_id").agg(F.min("rank").alias("rank"))
    hits = first.join(relevant.distinct(), ["query_id", "article_id"])
    hits = hits.withColumn("h", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return size.join(hits.groupBy("query_id").agg(F.sum(F.col("h") / F.col("rank")).alias("s")), "query_id", "left").select("query_id", (F.coalesce("s", F.lit(0.0)) / F.least("n", F.lit(10))).alias("ap"))


def mean_average_precision(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    return average_precision(ranking, relevant).agg(F.coalesce(F.avg("ap"), F.lit(0.0)).alias("map"))


def recall_at(ranking: DataFrame, relevant: DataFrame, ks=(1, 3, 5, 10, 15, 30)) -> DataFrame:
    size = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    hits = ranking.join(relevant.distinct(), ["query_id", "article_id"], "left_semi").groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"k{k}") for k in ks])
    wide = size.join(hits, "query_id", "left").na.fill(0).agg(*[F.avg(F.col(f"k{k}") / F.col("n")).alias(f"k{k}") for k in ks])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"k{k}").alias("recall")) for k in ks])).alias("x")).select("x.*")
