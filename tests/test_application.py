"""The retrieval application: input, caches, modes, evaluation, and operators against brute force."""

import csv
import inspect
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import classifier as C
from lodestone.operators import scores as S
from lodestone.operators.matching import containing
from lodestone.operators.tfidf import tfidf_scores
from lodestone.plans import pipeline as P
from lodestone.plans import registry
from lodestone.sources import io

WORDS = "alpha beta gamma delta parcel refund order seller buyer card photo price delivery return".split()


def _tables():
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    articles = [(100 + 3 * k, f"title {WORDS[k]}", f"<p>{text(12)}</p><script>x</script>") for k in range(13)]
    refs = [(50 - k, text(5), f" {100 + 3 * (k % 13)}  {100 + 3 * (k * 5 % 13)}") for k in range(10)]
    test = [(7, text(4)), (3, text(6)), (5, text(5))]
    return articles, refs, test


@pytest.fixture(scope="module")
def data_dir(tmp_path_factory):
    out = tmp_path_factory.mktemp("data")
    for name, columns, rows in zip(("articles", "calibration", "test"), (io.ARTICLES, io.CALIBRATION, io.TEST), _tables()):
        table = pa.table({c: list(v) for c, v in zip(columns, zip(*rows))})
        with pa.OSFile(str(out / f"{name}.f"), "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
    return out


def test_load_data(spark, data_dir, tmp_path):
    articles, refs, test = io.load_data(spark, str(data_dir))
    assert [r.query_id for r in test.orderBy("pos").collect()] == [7, 3, 5]
    for name, df in (("articles", articles), ("calibration", refs), ("test", test)):
        df.orderBy("pos").drop("pos").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    again = io.load_data(spark, str(tmp_path))
    assert [r.query_id for r in again[2].orderBy("pos").collect()] == [7, 3, 5]
    assert again[0].orderBy("pos").drop("pos").collect() == articles.orderBy("pos").drop("pos").collect()
    bad = refs.where("query_id <> 50").drop("pos").unionByName(spark.createDataFrame([(50, "q", "1 100")], "query_id long, query_text string, ground_truth string"))
    bad.write.mode("overwrite").parquet(f"{tmp_path}/calibration.parquet")
    with pytest.raises(ValueError, match=r"unknown articles: \[1\]"):
        io.load_data(spark, str(tmp_path))


@pytest.mark.parametrize("rows, columns, match", [([(1, "a"), (1, "b")], "query_id long, query_text string", "repeats"), ([(1, None)], "query_id long, query_text string", "nulls"), ([("a", 1)], "query_text string, query_id long", "columns")])
def test_check_refuses(spark, rows, columns, match):
    with pytest.raises(ValueError, match=match):
        io.check(spark.createDataFrame(rows, columns), "test", io.TEST, "query_id")


def test_modes_and_caches(spark, data_dir, tmp_path):
    def scorer(device, batch_size):
        def score(df):
            assert df.columns == ["query_id", "article_id", "query", "passage", "prompt"]
            return df.select("query_id", "article_id", (F.length("passage") % 7 + F.col("article_id") / 1000.0).alias("logit"))

        return score

    def fails(*_):
        raise RuntimeError("the cache was not used")

    first = P.Models(scorer=scorer, cache_dir=f"file://{tmp_path}/cache")
    submission, test, articles = P.build_submission(spark, str(data_dir), "robust", first)
    io.validate_submission(submission.persist(), test, articles)
    found = submission.orderBy("pos").collect()
    again = P.Models(scorer=lambda *_: fails, encoder=lambda device: fails, cache_dir=first.cache_dir)
    submission, *_ = P.build_submission(spark, str(data_dir), "robust", again)
    assert submission.orderBy("pos").collect() == found
    spark.catalog.clearCache()
    with pytest.raises(ValueError, match="mode"):
        P.build_submission(spark, str(data_dir), "slow")


def test_command_line(spark, data_dir, tmp_path):
    P.main(["--data-dir", str(data_dir), "--output", str(tmp_path / "o" / "answer.csv"), "--mode", "fast", "--batch-size", "3", "--cache-dir", f"file://{tmp_path}/c"])
    rows = list(csv.reader(open(tmp_path / "o" / "answer.csv")))
    assert rows[0] == ["query_id", "answer"] and [r[0] for r in rows[1:]] == ["7", "3", "5"]
    assert all(len(set(r[1].split())) == 10 for r in rows[1:])


def test_evaluation(spark, data_dir):
    articles, refs, _ = io.load_data(spark, str(data_dir))
    rows = P.evaluate(P.prepare_articles(articles), refs, (7,)).collect()
    loo = [r for r in rows if r.protocol == "leave-one-out"]
    assert len(loo) == 7 and [r.map for r in loo] == sorted((r.map for r in loo), reverse=True)
    assert {r.channel for r in rows if r.protocol == "five-fold 7"} == {"fusion", "robust"}
    assert all(0 <= r.map <= 1 and r.seconds > 0 for r in rows)


def test_evaluation_query_splits_by_every_seed(monkeypatch):
    """The query left out one of the three seeds before."""
    asked = inspect.signature(P.evaluate)
    seen = []

    def evaluate(*given, **named):
        bound = asked.bind(*given, **named)
        bound.apply_defaults()
        seen.append(bound.arguments["seeds"])
        return SimpleNamespace(drop=lambda column: None)

    monkeypatch.setattr(P, "evaluate", evaluate)
    monkeypatch.setattr(registry, "_task", lambda *_: (None, None, None))
    registry.QUERIES["evaluation"](None, "")
    assert seen == [(7, 42, 2026)]


def test_prepare_refuses_empty_bodies(spark):
    with pytest.raises(ValueError, match="1 articles"):
        P.prepare_articles(spark.createDataFrame([(1, "t", "<script>x</script>"), (2, "t", "x")], "article_id long, title string, body string"))


def test_parts_of_cached_logits_are_whole(spark, tmp_path):
    path, make = f"file://{tmp_path}", lambda *r: spark.createDataFrame(list(r), io.LOGITS)
    assert io.add_logits(make((1, 1, 0.5), (1, 2, 0.1), (2, 1, 0.2)), path, "k") == 3
    assert io.add_logits(make((3, 1, 0.7), (3, 1, 0.1)), path, "k") == 2  # a pair twice: this part is not used
    assert io.cached_logits(spark, path, "k").count() == 3
    lost = next(p for p in (tmp_path / "k").rglob("part-*.parquet") if spark.read.parquet(f"file://{p}").where("query_id = 2").count())
    lost.unlink()
    assert io.cached_logits(spark, path, "k") is None
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(ValueError, match="1 of 2 logits"):
            io.add_logits(make((1, 1, bad), (1, 2, 0.0)), path, "l")
    assert io.cached_logits(spark, path, "l") is None


def test_keys_follow_what_they_name(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "article_id long, passage string")
    q = spark.createDataFrame([(1, "q")], "query_id long, query_text string")
    key = io.embedding_key(a, q, q, (1, "m"), "cpu")
    assert key == io.embedding_key(a.orderBy(F.desc("article_id")), q, q, (1, "m"), "cpu")
    assert len({key, io.embedding_key(a, q, q, (1, "m"), "cuda"), io.embedding_key(a, q, q, (2, "m"), "cpu"), io.embedding_key(a.limit(1), q, q, (1, "m"), "cpu"), io.reranker_key(a, q, (1, "m"), "cpu")}) == 5


def test_containing_is_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", "a  b  c  d  e  f", None]
    passages = ["", "a", "ta gamma", None, " b  c ", "b  c  d  e", "xyz"]
    for t in texts[:40]:
        if len(t) > 20:
            a = rng.randrange(len(t) - 10)
            passages.append(t[a : a + rng.randint(5, 60)])
    expected = {(p, k) for p, q in enumerate(passages) for k, t in enumerate(texts) if q is not None and t is not None and q in t}
    got = containing(spark.createDataFrame(list(enumerate(texts)), "article_id long, text string"), spark.createDataFrame(list(enumerate(passages)), "query_id long, text string"))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == expected and len(rows) == len(expected)


def test_containing_of_few_passages_shuffles_nothing(spark, monkeypatch):
    """Sent to the tasks or joined, the pairs are the same, repeats too; before, runs and texts were joined in both cases."""
    from lodestone.operators import matching

    texts = spark.createDataFrame([(1, "a bb c d e f"), (2, "xa bb c d ex"), (2, "bb c d"), (3, None), (4, "")], "article_id long, text string")
    passages = spark.createDataFrame([(7, "a bb c d e"), (7, "bb c"), (8, "a bb c d e"), (8, None), (9, "b c d e f"), (10, "")], "query_id long, text string")
    sent = matching.containing(texts, passages)
    assert "Exchange" not in sent._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, sent.collect()))
    monkeypatch.setattr(matching, "BROADCAST_ROWS", 0)
    assert got == sorted(map(tuple, matching.containing(texts, passages).collect()))
    assert got == sorted((q, a) for q, p in passages.collect() for a, t in texts.collect() if p is not None and t is not None and p in t)


def test_complete_gives_the_ranking_of_all_pairs(spark):
    rng = random.Random(5)
    rows = [(q, a, round(rng.uniform(-1, 1), 3)) for q, n in ((1, 20), (2, 12), (3, 3), (4, 0), (5, 9)) for a in rng.sample(range(20), n)]
    rows += [(6, a, 1.0 + a) for a in range(15)]
    scores = spark.createDataFrame(rows, "query_id long, article_id long, score double")
    queries, articles = spark.range(1, 7).toDF("query_id"), spark.range(20).toDF("article_id")
    have = {(q, a): s for q, a, s in rows}
    got = {}
    for r in S.rank(S.complete(scores, queries, articles, 10), 10).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.article_id)
    for q in range(1, 7):
        assert got[q] == sorted(range(20), key=lambda a: (-have.get((q, a), 0.0), a))[:10]


def test_blocks_of_classifiers_agree(spark, monkeypatch):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(5))
    train = spark.createDataFrame([(k, text()) for k in range(12)], "query_id long, text string")
    target = spark.createDataFrame([(k, text()) for k in range(20, 26)] + [(30, "?")], "query_id long, text string")
    labels = spark.createDataFrame([(k, k % 3) for k in range(12)] + [(k, 9) for k in range(12)] + [(99, 4)], "ref_id long, article_id long")
    whole = {(r.query_id, r.article_id): r.score for r in C.logistic_scores(train, target, labels).collect()}
    monkeypatch.setattr(C, "BLOCK", 2)
    monkeypatch.setattr(C, "WEIGHTS", 24)
    parts = {(r.query_id, r.article_id): r.score for r in C.logistic_scores(train, target, labels).collect()}
    assert whole.keys() == parts.keys() and len(whole) == 7 * 4
    assert all(parts[k] == pytest.approx(v, abs=1e-9) for k, v in whole.items())
    assert all(whole[q, 9] == 1.0 for q in (20, 30))
    rows = {(r.query_id, r.article_id): r.score for r in C.logistic_scores(train, target, labels, max_train=5).collect()}  # over rows
    assert rows.keys() == whole.keys() and all(rows[k] == pytest.approx(v, abs=1e-6) for k, v in whole.items())
    assert C.logistic_rows(train, target, labels.where("false")).collect() == []


def test_fold_robust_is_robust_by_fold(spark):
    rng = np.random.default_rng(4)
    n = 9
    frame = lambda rows, cols: spark.createDataFrame(rows, cols)
    sim = frame([(t, r, float(rng.uniform(0.3, 1))) for t in range(n) for r in range(n)], "target_id long, ref_id long, sim double")
    labels = frame([(0, 5), (3, 5)] + [(q, q % 4) for q in range(n)], "ref_id long, article_id long")
    score = lambda: frame([(q, a, float(rng.random())) for q in range(n) for a in range(6)], "query_id long, article_id long, score double")
    lexical, dense, memory, clf = score(), score(), score(), score()
    folds = frame([(q, q % 3) for q in range(n)], "id long, fold int")
    got = {(r.query_id, r.article_id): r.score for r in S.fold_robust(lexical, dense, memory, clf, sim, labels, folds).collect()}
    for f in range(3):
        own = lambda df, c="query_id": df.where(f"{c} % 3 = {f}")  # noqa: E731,B023
        near, train = sim.where(f"target_id % 3 = {f} and ref_id % 3 <> {f}"), labels.where(f"ref_id % 3 <> {f}")
        one = S.robust(own(lexical), own(dense), S.memory_scores(near, train, S.ROBUST), own(memory), own(clf), near, train)
        for r in one.collect():
            assert got[r.query_id, r.article_id] == pytest.approx(r.score, abs=1e-12)


def test_encoder_gets_batches(spark):
    from lodestone.operators.rerank import encode

    def load():
        def model(texts):
            assert len(texts) <= 2
            return np.ones((len(texts), 3), np.float32)

        return model

    assert encode(spark.createDataFrame([(k, "x") for k in range(7)], "id long, t string"), "id", "t", load, 2).count() == 7


def test_reranking_starts_from_candidates(spark, monkeypatch):
    """All scores of all articles were ranked and fused before."""
    seen, d = [], "/root/testdata/sf0.001"
    monkeypatch.setattr(registry, "rerank", lambda base, *_: seen.append(base) or base)
    got = registry.QUERIES["reranked_scores"](spark, d).orderBy("query_id", "rank").collect()
    every = S.row_scale(tfidf_scores(registry._docs(spark, d), registry._bench(spark, d), "word"))
    want = S.rank(every).orderBy("query_id", "rank").collect()
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r.score for r in got] == pytest.approx([r.score for r in want], abs=2e-9)
    most = S.rank(every, registry.CANDIDATES)
    assert most.join(seen[0], ["query_id", "article_id"], "left_anti").isEmpty() and seen[0].count() < 1.2 * most.count() < every.count()


def test_rows_that_a_fusion_can_rank(spark):
    """Each fusion of the evaluation took all pairs before."""
    rng = random.Random(5)
    frame = lambda rows: spark.createDataFrame(rows, "query_id long, article_id long, score double")
    value = lambda q: -rng.random() if q == 3 and rng.random() < 0.95 else rng.choice([0.5, 0.5 + 2e-10, rng.random()])
    lexical, dense = (frame([(q, a, value(q)) for q in range(4) for a in range(200) if rng.random() < p]) for p in (0.4, 1.0))
    labelled = list(range(0, 200, 16))
    labels = spark.createDataFrame([(100 + a, a) for a in labelled], "ref_id long, article_id long")
    memory, lexmem, clf = (frame([(q, a, rng.random()) for q in range(4) for a in labelled]) for _ in range(3))
    queries, articles = spark.range(4).toDF("query_id"), spark.range(200).toDF("article_id")
    first = S.direct(lexical, dense).localCheckpoint()
    some = S.reachable(first, labels, P.CANDIDATES).localCheckpoint()
    ranked = lambda s, k=10: S.rank(S.complete(s, queries, articles), k).orderBy("query_id", "rank").collect()
    for k in (10, P.CANDIDATES):
        got, want = (ranked(S.hybrid(lexical, dense, memory, lexmem, clf, f), k) for f in (some, None))
        assert got == want
    count = lambda df, q: df.where(f"query_id = {q}").count()
    assert count(some, 0) < 0.5 * count(first, 0) and count(some, 3) == count(first, 3)
