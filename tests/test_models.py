"""Models behind the encoder and reranker interfaces; folds of queries by their order."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators.classifier import kfold, numbered_folds
from lodestone.operators.rerank import encode, padded, token_encoder, token_scorer
from lodestone.plans import pipeline as P
from lodestone.plans.registry import QUERIES


def _codes(texts):
    return [[ord(c) for c in t] for t in texts]


def _running_sums(ids, mask):
    """A vector a token that depends on all tokens before it, and on none of the padding."""
    sums = np.cumsum(ids * mask, axis=1)
    return np.stack([sums, np.cumsum(mask, axis=1), ids], axis=2).astype(float)


def test_padding_is_on_the_left_and_texts_end_at_the_limit():
    ids, mask = padded([[1, 2, 3, 4], [5], []], 3, 9)
    assert ids.tolist() == [[1, 2, 3], [9, 9, 5], [9, 9, 9]] and mask.tolist() == [[1, 1, 1], [0, 0, 1], [0, 0, 0]]
    assert padded([], 3)[0].shape == (0, 0) and padded([[]], 3)[0].shape == (1, 0)


def test_an_encoder_gives_the_same_vectors_in_any_batch(spark):
    texts = ["abc", "", "a", "x" * 700, None, "hello world", "zz"]
    expected = np.zeros((len(texts), 3))
    for k, t in enumerate(texts):
        codes = [ord(c) for c in t or ""][:512]
        if codes:
            v = np.array([sum(codes), len(codes), codes[-1]], float)
            expected[k] = v / np.linalg.norm(v)
    for batch_size in (1, 3, 64):
        assert np.allclose(token_encoder(_codes, _running_sums, 3, batch_size)(texts), expected, atol=1e-6)
    assert token_encoder(_codes, _running_sums, 3)([]).shape == (0, 3) and not token_encoder(_codes, _running_sums, 3)(["", None]).any()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = encode(df, "id", "text", lambda: token_encoder(_codes, _running_sums, 3), 2).orderBy("id").collect()
    assert np.allclose([r.embedding for r in got], expected, atol=1e-6)


def test_a_pairwise_model_reads_so_many_tokens_of_each_prompt(spark):
    def load():
        return _codes, lambda ids, mask: (ids * mask).sum(axis=1)

    prompts = ["ab", "b" * 300, "", None]
    df = spark.createDataFrame([(k, k + 10, "q", "p", t) for k, t in enumerate(prompts)], "query_id long, article_id long, query string, passage string, prompt string")
    got = token_scorer(load, 2)(df).orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [(0, 10, 195.0), (1, 11, 98.0 * 256), (2, 12, 0.0), (3, 13, 0.0)]
    assert token_scorer(load)(df.limit(0)).count() == 0


def test_another_task_is_another_model_to_the_caches(spark, tmp_path):
    articles = spark.createDataFrame([(k, f"t{k}", f"<p>text {k}</p>") for k in range(12)], "article_id long, title string, body string")
    queries = spark.createDataFrame([(k, f"text {k}") for k in range(3)], "query_id long, query_text string")
    prepared, seen = P.prepare_articles(articles), {}
    for task in ("find", "find", "compare"):
        models = P.Models(cache_dir=f"file://{tmp_path}/c", article_task=task)
        e = P.embedding_channels(prepared, queries, queries, models)
        seen.setdefault(task, []).append([r.embedding for r in e["article_queries"].orderBy("id").collect()])
    prepared.unpersist()
    assert seen["find"][0] == seen["find"][1] != seen["compare"][0]
    assert len(list((tmp_path / "c" / "embeddings").iterdir())) == 2


def test_folds_follow_the_order_of_ids(spark):
    ids = [40, -3, 7, 1000, 22, 5, 6, 1, 0, 99, 98]
    df = spark.createDataFrame([(i,) for i in ids], "query_id long").repartition(4)
    for seed in (7, 42):
        got = {r.query_id: (r.pos, r.fold) for r in numbered_folds(df, seed).collect()}
        assert got == {q: (k, f) for k, (q, f) in enumerate(zip(sorted(ids), kfold(len(ids), seed).tolist()))}
    assert numbered_folds(df.limit(0), 7).count() == 0
    rows = QUERIES["kfold_assignment"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").count()
    assert rows.groupBy("seed").agg(F.count_distinct("query_id").alias("n")).collect() and rows.count() == 3 * n
