"""The retrieval pipeline, its evaluation and command line."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.html_text import rendered
from lodestone.functions.text import article_passages, instructed, normalize_lexical_text, normalize_text, parse_ground_truth, rerank_prompt, reranker_chunks
from lodestone.operators import scores as S
from lodestone.operators.classifier import logistic_oof, logistic_scores, numbered_folds
from lodestone.operators.nearest import nearest
from lodestone.operators.rerank import CANDIDATES, candidate_logits, encode, fuse, hashing_encoder, pair_logits
from lodestone.operators.tfidf import query_similarity, tfidf_scores
from lodestone.sources import io

MODES = ("fast", "high-score", "robust")
ARTICLE_TASK = "Given a customer support question, retrieve all help articles that answer it"
MEMORY_TASK = "Given a customer support question, retrieve other questions with the same articles"
RERANK_TASK = "Given a customer support question, decide whether this passage is needed to answer it"


@dataclass(frozen=True)
class Models:
    """Where encoder and reranker come from, and where their results are kept.

    `encoder` and `scorer` get device and batch size; the defaults are stand-ins without weights.
    `token_encoder` and `token_scorer` make them from a tokenizer and a model. The tasks are what a
    model is told to do; a change of one is another model to the caches. Without cache_dir nothing
    is kept.
    """

    encoder: Callable[[str], Callable] = lambda device: hashing_encoder
    scorer: Callable[[str, int], Callable[[DataFrame], DataFrame]] | None = None
    name: str = "stand-in"
    dimension: int = 256
    device: str = "cpu"
    batch_size: int = 4
    cache_dir: str | None = None
    version: int = 1
    article_task: str = ARTICLE_TASK
    memory_task: str = MEMORY_TASK
    rerank_task: str = RERANK_TASK


def prepare_articles(articles: DataFrame) -> DataFrame:
    """One parse for the clean and the dense text; an empty clean body is an error. Kept until unpersist()."""
    out = articles.withColumn("r", rendered(F.col("body"))).select("*", normalize_text(F.col("title")).alias("clean_title"), F.col("r.clean").alias("clean_body"), F.col("r.dense").alias("dense")).drop("r").persist()
    if empty := empty_bodies(out):
        out.unpersist()
        raise ValueError(f"{empty} articles without text after cleaning")
    return out


def empty_bodies(prepared: DataFrame) -> int:
    return prepared.agg(F.count_if(F.col("clean_body") == "")).first()[0]


def label_matrix(calibration: DataFrame) -> DataFrame:
    return calibration.select(F.col("query_id").alias("ref_id"), F.explode(parse_ground_truth(F.col("ground_truth"))).alias("article_id")).distinct()


def embedding_channels(articles: DataFrame, refs: DataFrame, targets: DataFrame, models: Models) -> dict[str, DataFrame]:
    """(id, embedding) of passages, references and targets with each task: from the cache, or encoded and kept there."""
    passages = article_passages(articles)
    of = lambda df, task: df.select("query_id", (instructed(F.col("query_text"), task) if task else F.col("query_text")).alias("text"))
    wanted = {"passages": (passages, "article_id", "passage"), "references": (of(refs, None), "query_id", "text"), "article_queries": (of(targets, models.article_task), "query_id", "text"), "memory_queries": (of(targets, models.memory_task), "query_id", "text")}
    make = lambda df, key, text: encode(df, key, text, models.encoder(models.device), models.batch_size).withColumnRenamed(key, "id")
    if not models.cache_dir:
        return {name: make(*w) for name, w in wanted.items()}
    spark = articles.sparkSession
    settings = (models.version, models.name, models.dimension, models.article_task, models.memory_task)
    key = io.embedding_key(passages, refs.select("query_id", "query_text"), targets.select("query_id", "query_text"), settings, models.device)
    out = {}
    for name, w in wanted.items():
        path = f"{models.cache_dir}/embeddings/{key}"
        out[name] = io.cached_embeddings(spark, path, name, w[0].count(), models.dimension)
        if out[name] is None:
            out[name] = io.write_cache(make(*w), path, name)
    return out


def channels(articles: DataFrame, refs: DataFrame, targets: DataFrame, models: Models, neighbors: int | None = None) -> dict[str, DataFrame]:
    """Lexical and dense scores of articles, and similarities to labelled queries, dense ones to the nearest `neighbors` alone if given."""
    corpus = articles.select("article_id", F.col("clean_body").alias("text"))
    asked = targets.select("query_id", normalize_text(F.col("query_text")).alias("text"))
    lexical = S.row_scale(tfidf_scores(corpus, asked, "word"))
    lex = lambda df, name: df.select(F.col("query_id").alias(name), normalize_lexical_text(F.col("query_text")).alias("text"))
    lex_sim = query_similarity(lex(refs, "ref_id"), lex(targets, "target_id"))
    e = embedding_channels(articles, refs, targets, models)
    dense = S.dense_similarity(e["article_queries"].toDF("target_id", "v"), e["passages"].toDF("ref_id", "u"))
    dense = S.row_scale(dense.select(F.col("target_id").alias("query_id"), F.col("ref_id").alias("article_id"), F.col("sim").alias("score")))
    asking, known = e["memory_queries"].toDF("target_id", "v"), e["references"].toDF("ref_id", "u")
    dense_sim = nearest(asking, known, neighbors) if neighbors else S.dense_similarity(asking, known)
    return {"lexical": lexical, "lex_sim": lex_sim, "dense": dense, "dense_sim": dense_sim}


def reranked(base: DataFrame, articles: DataFrame, queries: DataFrame, models: Models) -> DataFrame:
    """`base` fused with logits of its candidates; only pairs that the cache lacks are scored and added to it.

    `base` is used several times and so settled first.
    """
    base = io.settled(base)
    asked = queries.select("query_id", normalize_lexical_text(F.col("query_text")).alias("text"))
    chunks = reranker_chunks(articles.select("article_id", "title", "dense")).withColumn("text", normalize_lexical_text(F.col("text")))
    score = models.scorer(models.device, models.batch_size) if models.scorer else None
    with_prompt = (lambda df: score(df.withColumn("prompt", rerank_prompt(F.col("query"), F.col("passage"), models.rerank_task)))) if score else None
    if not models.cache_dir:
        return fuse(base, candidate_logits(base, chunks, asked, None, with_prompt))
    spark, path = articles.sparkSession, f"{models.cache_dir}/logits"
    key = io.reranker_key(articles.select("article_id", "title", "body"), queries.select("query_id", "query_text"), (models.version, models.name, models.rerank_task), models.device)
    cached = io.cached_logits(spark, path, key)
    pairs = S.rank(base, CANDIDATES).select("query_id", "article_id")
    missing = pairs if cached is None else pairs.join(cached, ["query_id", "article_id"], "left_anti")
    if not missing.isEmpty():
        io.add_logits(pair_logits(missing, chunks, asked, with_prompt), path, key)
        cached = io.cached_logits(spark, path, key)
    return base if cached is None else fuse(base, pairs.join(cached, ["query_id", "article_id"]))


def final_scores(articles: DataFrame, refs: DataFrame, test: DataFrame, mode: str = "fast", models: Models | None = None) -> DataFrame:
    """score(query_id, article_id) of prepared articles for test queries in one of MODES.

    The channels are used several times and so settled first.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    models, labels = models or Models(), label_matrix(refs)
    memory = S.ROBUST if mode == "robust" else S.DENSE
    c = {name: io.settled(df) for name, df in channels(articles, refs, test, models, memory["neighbors"]).items()}
    lexical_memory = S.cooccurrence_scores(c["lex_sim"], labels)
    classifier = logistic_scores(refs.select("query_id", F.col("query_text").alias("text")), test.select("query_id", F.col("query_text").alias("text")), labels)
    if mode == "robust":
        base = S.robust(c["lexical"], c["dense"], S.memory_scores(c["dense_sim"], labels, memory), lexical_memory, classifier, c["dense_sim"], labels)
    else:
        base = S.hybrid(c["lexical"], c["dense"], S.memory_scores(c["dense_sim"], labels, memory), lexical_memory, classifier)
    return base if mode == "fast" else reranked(base, articles, test, models)


def answers(scores: DataFrame, test: DataFrame, articles: DataFrame) -> DataFrame:
    """(pos, query_id, answer) in the test's order."""
    ranking = S.rank(S.complete(scores, test, articles))
    return S.submission(ranking).join(test.select("query_id", "pos"), "query_id").select("pos", "query_id", "answer")


def build_submission(spark: SparkSession, data_dir: str, mode: str = "fast", models: Models | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(submission with pos, test, prepared articles)."""
    articles, refs, test = io.load_data(spark, data_dir)
    articles = prepare_articles(articles)
    return answers(final_scores(articles, refs, test, mode, models), test, articles), test, articles


def evaluate(articles: DataFrame, refs: DataFrame, seeds: Sequence[int] = (7, 42, 2026), models: Models | None = None) -> DataFrame:
    """(protocol, channel, map, seconds) of prepared articles, best first, under leave-one-out and five-fold splits.

    The leave-one-out fusion holds the classifier of the folds of one seed, the middle one of the
    list. `seconds` is what the row took to compute.
    """
    spark, models, labels = articles.sparkSession, models or Models(), label_matrix(refs)
    c = {k: io.settled(v) for k, v in channels(articles, refs, refs, models).items()}
    truth = labels.withColumnRenamed("ref_id", "query_id")
    texts = refs.select("query_id", F.col("query_text").alias("text"))
    rows = []

    def add(protocol: str, channel: str, scores: DataFrame) -> None:
        began = time.perf_counter()
        found = S.mean_average_precision(S.rank(S.complete(scores, refs, articles)), truth).first()[0]
        rows.append((protocol, channel, found, time.perf_counter() - began))

    labels = io.settled(labels)
    lexical_memory, dense_memory = io.settled(S.leave_one_out(c["lex_sim"], labels)), io.settled(S.leave_one_out(c["dense_sim"], labels, S.DENSE, False))
    classifiers = {s: io.settled(logistic_oof(texts, labels, s)) for s in seeds}
    middle = classifiers[seeds[len(seeds) // 2]]
    # of all pairs only those that can be ranked or reranked go through the fusions
    first = io.settled(S.reachable(io.settled(S.direct(c["lexical"], c["dense"])), labels, CANDIDATES))
    fusion = S.hybrid(c["lexical"], c["dense"], dense_memory, lexical_memory, middle, first)
    fusion = io.settled(fusion)
    for name, scores in (("lexical", c["lexical"]), ("lexical_memory", lexical_memory), ("classifier", middle), ("dense", c["dense"]), ("dense_memory", dense_memory), ("fusion", fusion), ("high_score", reranked(fusion, articles, refs, models))):
        add("leave-one-out", name, scores)
    for s in seeds:
        folds = io.settled(numbered_folds(refs, s).select(F.col("query_id").alias("id"), "fold"))
        lexical_memory, dense_memory = io.settled(S.fold_memory(c["lex_sim"], labels, folds, S.MEMORY, True)), io.settled(S.fold_memory(c["dense_sim"], labels, folds, S.DENSE))
        add(f"five-fold {s}", "fusion", S.hybrid(c["lexical"], c["dense"], dense_memory, lexical_memory, classifiers[s], first))
        add(f"five-fold {s}", "robust", S.fold_robust(c["lexical"], c["dense"], lexical_memory, classifiers[s], c["dense_sim"], labels, folds, first=first))
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[0], -r[2], r[1])), "protocol string, channel string, map double, seconds double")


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Rank articles for test queries and write the answers.")
    parser.add_argument("--data-dir", default="data")
    parser.add_argument("--output", default="answer.csv")
    parser.add_argument("--cache-dir", default=None, help="where embeddings and logits are kept between runs")
    parser.add_argument("--mode", choices=MODES, default="fast")
    parser.add_argument("--batch-size", type=int, default=4)
    parser.add_argument("--device", default="cpu")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    models = Models(device=a.device, batch_size=a.batch_size, cache_dir=a.cache_dir)
    submission, test, articles = build_submission(spark, a.data_dir, a.mode, models)
    submission = submission.persist()
    io.validate_submission(submission, test, articles)
    io.save_submission(submission, a.output)
    spark.catalog.clearCache()
    print(f"wrote {a.output}")


if __name__ == "__main__":
    main()
