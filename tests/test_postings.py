"""The best articles from posting lists against all scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import postings, tfidf
from lodestone.operators.postings import Postings
from lodestone.operators.scores import rank

WORDS = [f"w{i}" for i in range(120)]


def _texts(rng, n, most):
    return [(i, " ".join(rng.choice(WORDS[: rng.choice([4, 20, 120])]) for _ in range(rng.randint(1, most)))) for i in range(n)]


@pytest.mark.parametrize("analyzer,block", [("word", 32_768), ("word", 20), ("char", 50)])
def test_best_articles_equal_all_scores(spark, analyzer, block):
    rng = random.Random(7)
    rows = _texts(rng, 500, 80) + [(500 + i, "w7 w7 w90") for i in range(12)] + [(600, ""), (601, None), (602, "w8 w9")]
    corpus = spark.createDataFrame(rows, "article_id long, text string")
    asked = spark.createDataFrame([(1, "w90"), (2, "w7 w90"), (3, "w100 w101 w102"), (4, "w0 w1"), (5, "nothing"), (6, ""), (7, "w8 w9 w8")], "query_id long, text string")
    want = [tuple(r) for r in rank(tfidf.tfidf_scores(corpus, asked, analyzer), 10).orderBy("query_id", "rank").collect()]
    space = tfidf.Space(corpus, analyzer)
    lists = Postings(space, block=block)  # of all terms, for any questions
    terms = space.asked(asked)
    got = [tuple(r) for r in rank(lists.top(terms, 10), 10).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-9)
    count = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    needed = lists.needed(terms, 10).join(lists.blocks.select("term", "level", "part", "n"), ["term", "level", "part"])
    whole = count(lists.bounds(terms))
    assert count(needed) < 0.9 * whole if analyzer == "word" else count(needed) <= whole  # blocks were skipped
    assert lists.blocks.agg(F.max("n")).first()[0] <= 4 * block


@pytest.mark.parametrize("frequent", [1_000_000, 30])
def test_many_questions_pass_on_few_rows(spark, monkeypatch, frequent):
    """Sums over lists were a shuffled row for each posting of each question before."""
    rng = random.Random(11)
    corpus = spark.createDataFrame(_texts(rng, 400, 40) + [(900 + i, "w7 w7 w90") for i in range(12)], "article_id long, text string")
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6)))) for i in range(150)]
    asked = spark.createDataFrame(texts + [(500 + i, t) for i, t in texts[:50]] + [(700, "w7 w90"), (701, "nothing"), (702, None)], "query_id long, text string")
    want = [tuple(r) for r in rank(tfidf.tfidf_scores(corpus, asked, "word"), 10).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(postings, "FEW", 0)
    monkeypatch.setattr(tfidf, "HELD", 300)  # many compactions
    monkeypatch.setattr(tfidf, "FREQUENT", frequent)
    monkeypatch.setattr(tfidf.Space.__init__, "__defaults__", (1, False, None, frequent))
    monkeypatch.setattr(tfidf, "BROADCAST_ROWS", 400)  # several passes
    monkeypatch.setattr(postings, "Postings", None)  # no lists
    made = postings.best_articles(corpus, asked, "word", 10)
    got = [tuple(r) for r in rank(made, 10).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [r[:3] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=2e-9)


def test_empty_corpus(spark):
    corpus = spark.createDataFrame([], "article_id long, text string")
    space = tfidf.Space(corpus, "word")
    asked = space.asked(spark.createDataFrame([(1, "w1")], "query_id long, text string"))
    assert Postings(space).top(asked, 10).collect() == []


def test_a_task_keeps_the_best_of_each_question(monkeypatch):
    monkeypatch.setattr(tfidf, "HELD", 500)
    rng, k = np.random.default_rng(3), 4
    keeper, every, passed = tfidf._Best(k), [], []
    for place in range(300):
        query = np.flatnonzero(rng.random(20) < 0.7)
        if len(query):
            low = rng.random(len(query))
            every += zip(query, low, [place] * len(query))
            keeper.add(place, query, low, low, low * 1.02)
            if (found := keeper.take(False)) is not None:
                passed += zip(found[1], found[3], found[0])
    found = keeper.take(True)
    passed += zip(found[1], found[3], found[0])
    assert len(set(passed)) == len(passed) < 0.1 * len(every)
    for q in range(20):
        best = sorted((r for r in every if r[0] == q), key=lambda r: -r[1])
        assert {r for r in best if r[1] * 1.02 >= best[k - 1][1]} == {r for r in passed if r[0] == q}
