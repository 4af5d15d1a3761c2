"""TF-IDF scores against counting in plain Python, with few and with all weights in the tasks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.operators import tfidf
from lodestone.operators.terms import char_hashes


def _terms(text, analyzer):
    if analyzer == "word":
        t = re.findall(r"\w{2,}", text.lower())
        return t + [f"{a} {b}" for a, b in zip(t, t[1:])]
    words = [f" {w} " for w in text.lower().split()]
    return [w[i : i + n] for w in words for n in (3, 4, 5) if n == 3 or len(w) >= n for i in range(max(len(w) - n + 1, 1))]


def _scores(corpus, asked, analyzer, min_df, sublinear):
    tf = lambda rows: {k: Counter(t for x in texts for t in _terms(x, analyzer)) for k, texts in rows.items()}
    c, q = tf(corpus), tf(asked)
    df = Counter(t for terms in c.values() for t in terms)
    n = sum(map(len, corpus.values()))
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items() if k >= min_df}
    w = lambda terms: {t: ((1 + math.log(k)) if sublinear else k) * idf[t] for t, k in terms.items() if t in idf}
    unit = lambda x: {t: v / math.sqrt(sum(y * y for y in x.values())) for t, v in x.items()}
    c, q = ({k: unit(w(terms)) for k, terms in side.items()} for side in (c, q))
    return {(i, j): s for i, a in q.items() for j, b in c.items() if (s := sum(v * b.get(t, 0) for t, v in a.items())) > 0}


@pytest.mark.parametrize("analyzer,min_df,sublinear", [("word", 1, False), ("char", 2, True), ("char", 1, True)])
@pytest.mark.parametrize("frequent", [1_000_000, 4])
def test_scores_for_any_number_of_frequent_terms(spark, analyzer, min_df, sublinear, frequent):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abё𝒳") for _ in range(rng.randint(1, 6)))
    corpus = {i: [" ".join(word() for _ in range(rng.randint(0, 30)))] for i in range(40)}
    corpus[7].append("second text of one id")  # one article, no bigram across
    asked = {i: [" ".join(word() for _ in range(12))] for i in range(5)} | {9: ["text of"], 10: [""]}
    rows = lambda side, key: spark.createDataFrame([(k, x) for k, texts in side.items() for x in texts], f"{key} long, text string")
    space = tfidf.Space(rows(corpus, "article_id").union(spark.createDataFrame([(90, None)], "article_id long, text string")), analyzer, min_df, sublinear, None, frequent)
    got = {(r.query_id, r.article_id): r.score for r in space.scores(space.asked(rows(asked, "query_id"))).collect()}
    want = _scores(corpus | {90: [""]}, asked, analyzer, min_df, sublinear)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())


def test_terms_are_not_rows_before_they_are_counted(spark):
    """A task dealt whole texts made a row of each term before, whose table grew with the corpus."""
    space = tfidf.Space(spark.createDataFrame([(1, "some words here")], "article_id long, text string"), "word")
    plan = space.texts.frequencies()._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Generate" not in plan


def test_grams_keep_to_words():
    assert len(np.unique(char_hashes("ab ab c"))) == len(set(_terms("ab ab c", "char"))) and len(char_hashes("ab ab c")) == len(_terms("ab ab c", "char"))


def test_tasks_that_count_terms_have_few_texts(spark, monkeypatch):
    """One of a fixed number of tasks held a part of the corpus that grew with it."""
    monkeypatch.setattr(tfidf, "PART_TEXTS", 10)
    texts = spark.range(300).selectExpr("id as article_id", "concat('word ', id) as text")
    counted = tfidf.counts(texts, "article_id", "word")
    assert counted.count() == 300 * 3 - 2 * 10  # one-digit numbers are no words
    assert "hashpartitioning(article_id" in (plan := counted._jdf.queryExecution().executedPlan().toString()) and ", 38)" in plan
