import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.html_text import render
from lodestone.operators import scores as S
from lodestone.operators.classifier import kfold, solve
from lodestone.operators.rerank import hashing_encoder
from lodestone.operators.tfidf import char_terms, word_terms
from lodestone.sources import io


def _ranking(spark, ids):
    return spark.createDataFrame([(1, r + 1, a) for r, a in enumerate(ids)], "query_id long, rank long, article_id long")


@pytest.mark.parametrize(
    "ids, relevant, expected",
    [
        ([1, 2, 3, *range(10, 17)], [1, 2, 3, 4], 0.75),
        (list(range(1, 11)), list(range(1, 13)), 1.0),
        (list(range(1, 12)), [11], 0.0),
        ([3, 1, 2, 4], [1, 2], 7 / 12),
        ([1, 1, 2, 3], [1, 2], 5 / 6),
    ],
)
def test_average_precision(spark, ids, relevant, expected):
    truth = spark.createDataFrame([(1, a) for a in relevant], "query_id long, article_id long")
    assert S.average_precision(_ranking(spark, ids), truth).first()["ap"] == pytest.approx(expected)


def test_map_over_queries(spark):
    ranking = spark.createDataFrame([(q, r + 1, a) for q, ids in ((1, [1, 2, 3]), (2, [3, 2, 1])) for r, a in enumerate(ids)], "query_id long, rank long, article_id long")
    truth = spark.createDataFrame([(1, 1), (2, 1)], "query_id long, article_id long")
    assert S.mean_average_precision(ranking, truth).first()[0] == pytest.approx(2 / 3)


def test_submission(spark):
    articles = spark.createDataFrame([(i,) for i in range(1, 11)], "article_id long")
    test = spark.createDataFrame([(0, 2), (1, 1)], "pos long, query_id long")
    answer = " ".join(map(str, range(1, 11)))
    good = spark.createDataFrame([(0, 2, answer), (1, 1, answer)], "pos long, query_id long, answer string")
    io.validate_submission(good, test, articles)
    with pytest.raises(ValueError, match="order"):
        io.validate_submission(good.withColumn("pos", 1 - F.col("pos")), test, articles)
    with pytest.raises(ValueError, match="different"):
        io.validate_submission(good.withColumn("answer", F.lit("1 1 2 3 4 5 6 7 8 9")), test, articles)
    with pytest.raises(ValueError, match="unknown"):
        io.validate_submission(good, test, articles.where("article_id < 10"))


def test_split_text(spark):
    def loop(words):
        out, start = [], 0
        while len(words) - start > 180:
            out.append(" ".join(words[start : start + 150]))
            start += 115
        return out + [" ".join(words[start:])] if words else []

    sizes = (0, 1, 180, 181, 295, 296, 1000)
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in sizes]
    got = X.split_text(spark.createDataFrame(rows, "id long, text string"), "text").orderBy("id", "chunk_id").collect()
    for n, text in rows:
        assert [r["chunk"] for r in got if r["id"] == n] == loop(text.split())


def test_html_rules():
    assert render("<table><tr><td>a<td>b</table>")[0] == "a | b |"
    assert render('<headline name="Top"></headline>x')[0] == "Top x"
    assert render('<headline name="Top">own</headline>x')[0] == "own x"
    assert render('<chunk title="Part">x</chunk>')[0] == "Part. x"
    assert render('a<img alt="b%20c">d<img>e')[0] == "a b c d e"
    assert render("he<b>ll</b>o<script>x</script><noscript>y</noscript><input>") == ("he ll o", "he ll o")
    assert render(None) == (None, None)


def test_normalisation(spark):
    df = spark.createDataFrame([("ﬁn​  Ёж x",), ("plain  text ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(X.normalize_text(F.col("t"))).collect()] == ["fin Еж x", "plain text", None, ""]
    assert df.select(X.normalize_lexical_text(F.lit("Ёж-2 café"))).first()[0] == "еж 2 caf"


def test_terms(spark):
    df = spark.createDataFrame([(1, "ab c def"), (2, ""), (3, "abcd")], "id long, text string")
    assert sorted(r.term for r in word_terms(df, "id", "text").where("id = 1").collect()) == ["ab", "ab def", "def"]
    assert sorted(r.term for r in char_terms(df, "id", "text").where("id = 3").collect()) == sorted([" ab", "abc", "bcd", "cd ", " abc", "abcd", "bcd ", " abcd", "abcd "])


def test_leave_one_out_is_brute_force(spark):
    rng = np.random.default_rng(0)
    n, sim = 8, rng.random((8, 8))
    labels = [(q, int(a)) for q in range(n) for a in set(rng.integers(0, 4, 2))]
    pairs = spark.createDataFrame([(t, r, float(sim[t, r])) for t in range(n) for r in range(n)], "target_id long, ref_id long, sim double")
    lab = spark.createDataFrame(labels, "ref_id long, article_id long")
    got = {(r.query_id, r.article_id): r.score for r in S.leave_one_out(pairs, lab).collect()}
    for q in (0, 5):
        one = S.cooccurrence_scores(pairs.where(f"target_id = {q} and ref_id <> {q}"), lab.where(f"ref_id <> {q}")).collect()
        for r in one:
            assert got[q, r.article_id] == pytest.approx(r.score, abs=1e-12)


def test_logistic_dual_is_primal():
    rng = np.random.default_rng(1)
    x, positive = np.hstack([rng.normal(size=(20, 5)), np.ones((20, 1))]), rng.random(20) < 0.4
    y, c = np.where(positive, 1.0, -1.0), 0.3 * np.where(positive, 20 / (2 * positive.sum()), 20 / (2 * (~positive).sum()))
    w = np.zeros(6)
    for _ in range(50):
        s = 1 / (1 + np.exp(y * (x @ w)))
        w -= np.linalg.solve(np.eye(6) + x.T @ ((c * s * (1 - s))[:, None] * x), w - x.T @ (c * y * s))
    assert np.allclose(x @ w, (x @ x.T) @ solve(x @ x.T, positive), atol=1e-9)


def test_folds_keys_encoder():
    assert np.bincount(kfold(12, 7)).tolist() == [3, 3, 2, 2, 2]
    assert io.cache_key([["ab"], ["c"]]) != io.cache_key([["a"], ["bc"]])
    v = hashing_encoder()(["hello world", ""])
    assert np.linalg.norm(v[0]) == pytest.approx(1) and not v[1].any()


def test_caches(spark, tmp_path):
    path = str(tmp_path)
    assert io.cached_embeddings(spark, path, "k", 1, 2) is None
    io.write_cache(spark.createDataFrame([(1, [0.6, 0.8])], "id long, embedding array<float>"), path, "k")
    assert io.cached_embeddings(spark, path, "k", 1, 2) is not None
    assert io.cached_embeddings(spark, path, "k", 2, 2) is None


def test_robust_gate(spark):
    s = lambda rows: spark.createDataFrame(rows, "query_id long, article_id long, score double")
    sim = spark.createDataFrame([(1, 9, 0.5), (2, 9, 0.675), (3, 9, 0.9)], "target_id long, ref_id long, sim double")
    direct, memory, none = s([(q, 1, 1.0) for q in (1, 2, 3)]), s([(q, 2, 1.0) for q in (1, 2, 3)]), s([])
    seen = spark.createDataFrame([(9, 1)], "ref_id long, article_id long")
    got = {(r.query_id, r.article_id): r.score for r in S.robust(direct, direct, memory, none, none, sim, seen).collect()}
    assert got[1, 2] == 0 and got[2, 2] == pytest.approx(0.225 / 0.35) and got[3, 2] == 1.0
    unseen = spark.createDataFrame([(9, 2)], "ref_id long, article_id long")
    got = {(r.query_id, r.article_id): r.score for r in S.robust(direct, direct, memory, none, none, sim, unseen).collect()}
    assert got[3, 1] == 1.0 and got[3, 2] == pytest.approx((0.45 - 0.275) / 0.625)


def test_query_similarity_compares_all_user_turns(spark, tmp_path):
    from lodestone.plans.registry import QUERIES

    spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(3, 0, "user", "alpha beta"), (3, 1, "assistant", "alpha"), (3, 2, "user", "alpha gamma"), (3, 4, "user", "delta"), (4, 0, "assistant", "delta")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.target_id for r in QUERIES["query_similarity"](spark, str(tmp_path)).collect()}
    assert got == {3000, 3002, 3004}


def test_lexical_channels_returns_every_score(spark, tmp_path):
    from lodestone.plans.registry import QUERIES

    spark.createDataFrame([(1, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pages = [(k, f"<h1>alpha t{k}</h1><p>beta common{k} alpha</p>") for k in range(8)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["lexical_channels"](spark, str(tmp_path)).collect()
    assert sorted((r.channel, r.article_id) for r in got) == sorted((c, k) for c in ("body_word", "body_char", "title_word", "title_char") for k in range(8))


def test_dense_queries_score_every_pair(spark, tmp_path):
    from lodestone.plans.registry import QUERIES

    spark.createDataFrame([(k, [1.0, float(k)], 0) for k in range(7)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("dense_similarity", "dense_scores"):
        assert sorted(tuple(r)[:2] for r in QUERIES[name](spark, str(tmp_path)).collect()) == [(a, b) for a in range(7) for b in range(7)]


def test_encoder_hashes_words_once_and_counts_all_grams():
    """The vectors are those of every gram hashed where it stands; before, each word was hashed anew."""
    import hashlib

    texts, calls = ["one two one", "two  ONE three é", None, ""] * 3, []
    want = np.zeros((len(texts), 16), np.float32)
    for row, text in zip(want, texts):
        for w in (text or "").lower().split():
            for n in (3, 4, 5):
                for i in range(max(len(w) + 2 - n + 1, 1)):
                    h = int.from_bytes(hashlib.blake2b(f" {w} "[i : i + n].encode(), digest_size=8).digest(), "little")
                    row[h % 16] += 1.0 if h >> 63 else -1.0
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-30)
    real = hashlib.blake2b
    with pytest.MonkeyPatch.context() as m:
        m.setattr(hashlib, "blake2b", lambda *a, **k: calls.append(a[0]) or real(*a, **k))
        got = hashing_encoder(16)(texts)
    assert np.array_equal(got, want)
    assert len(calls) <= 40  # grams of four words; 75 before


def test_best_chunks_scores_candidates_alone(spark, monkeypatch):
    """Same rows as from the similarities of all pairs; before, all chunks were scored for all queries."""
    from lodestone.operators import tfidf

    rng, words = np.random.default_rng(3), [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(rng.choice(words, n))
    chunks = spark.createDataFrame([(a, c, text(8)) for a in range(12) for c in range(3)], "article_id long, chunk_id long, text string")
    queries = spark.createDataFrame([(q, text(4)) for q in range(5)], "query_id long, text string")
    pairs = spark.createDataFrame([(q, a) for q in range(5) for a in (q, q + 1)], "query_id long, article_id long")
    refs = chunks.select(F.struct("article_id", "chunk_id").alias("ref_id"), "text")
    sim = {(r.target_id, r.ref_id.article_id, r.ref_id.chunk_id): r.sim for r in tfidf.query_similarity(refs, queries.withColumnRenamed("query_id", "target_id"), 0.4, 0.6, 2, 300_000).collect()}
    want = {(q, a): min((-round(sim.get((q, a, c), 0.0), 9), c) for c in range(3)) for q in range(5) for a in (q, q + 1)}
    counts, real = [], tfidf.Space.scores
    monkeypatch.setattr(tfidf.Space, "scores", lambda self, asked: counts.append(self.texts.count) or real(self, asked))
    got = {(r.query_id, r.article_id): (-r.sim, r.chunk_id) for r in tfidf.best_chunks(chunks, queries, pairs).collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 2e-9 for k in want)
    assert counts == [18, 18]  # of 36 chunks


@pytest.mark.parametrize("frequent", [10**6, 40, 0])
def test_best_scores_passes_on_few_rows_and_ranks_as_all_scores(spark, monkeypatch, frequent):
    """Also where most terms are not sent to the tasks; before, each text's score of each query left its task."""
    from lodestone.operators import terms, tfidf

    rng, words = np.random.default_rng(5), [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 25))) for _ in range(400)]
    texts[10:22] = [texts[10]] * 12  # ties at the edge of the ranking
    corpus = spark.createDataFrame(list(enumerate(texts)), "article_id long, text string").repartition(3)
    queries = spark.createDataFrame([(q, texts[q * 10] + " " + " ".join(rng.choice(words, 3))) for q in range(6)], "query_id long, text string")
    monkeypatch.setattr(tfidf, "FREQUENT", frequent)
    monkeypatch.setattr(terms, "HELD", 100)
    space = tfidf.Space(corpus, "word", frequent=frequent)
    asked = space.asked(queries)
    every = space.scores(asked)
    some = space.best(asked, 5, corpus)
    rows = lambda df: [(r.query_id, r.rank, r.article_id, round(r.score, 7)) for r in S.rank(df, 5).orderBy("query_id", "rank").collect()]
    assert rows(some) == rows(every)
    assert some.count() < every.count() / 3
