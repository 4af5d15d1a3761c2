"""TF-IDF spaces as relations: terms are joined, nothing is a dense matrix."""

from __future__ import annotations

import math
from copy import copy
from functools import cached_property, reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.terms import HELD, Texts
from lodestone.sources.io import settled

WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"
CHAR_SIZES = (3, 4, 5)


#: Terms of a vocabulary, and term weights of questions, that may be broadcast; with more the joins shuffle.
BROADCAST_ROWS = 2_000_000
#: Frequent terms whose weights every task has; texts for each part of a shuffle of terms.
FREQUENT, PART_TEXTS = 1_000_000, 10_000
#: Scores so near to each other may tie when they are rounded for a ranking.
TIE = 2e-9


def word_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) of unigrams and bigrams of tokens with two or more word characters.

    Bigrams come from zip_with over the array and its tail, so that the tokenizer runs once.
    """
    tokens = df.select(key, F.regexp_extract_all(F.lower(text), F.lit(WORD_TOKEN), F.lit(0)).alias("t"))
    pairs = tokens.select(key, F.explode(F.expr("zip_with(t, slice(t, 2, greatest(size(t), 1)), (a, b) -> struct(a, b))")).alias("p"))
    grams = pairs.select(key, F.explode(F.array(F.col("p.a"), F.when(F.col("p.b").isNotNull(), F.concat("p.a", F.lit(" "), "p.b")))).alias("term"))
    return grams.where("term is not null")


def words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, w) of lower-cased words between white space."""
    return df.select(key, F.explode(F.split(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), " ")).alias("w")).where("w <> ''")


def word_grams(df: DataFrame) -> DataFrame:
    """The 3- to 5-character grams inside each space-padded word `w`, as column `term` in place of w."""
    rest = [c for c in df.columns if c != "w"]
    padded = df.select(*rest, F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    sizes = padded.select(*rest, "w", F.explode(F.array(*map(F.lit, CHAR_SIZES))).alias("n")).where("n = 3 or length(w) >= n")
    places = sizes.select(*rest, "w", "n", F.explode(F.expr("sequence(1, greatest(length(w) - n + 1, 1))")).alias("i"))
    return places.select(*rest, F.expr("substring(w, i, n)").alias("term"))


def char_terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) of 3- to 5-character grams inside space-padded words."""
    return word_grams(words(df, key, text))


def _tf(sublinear: bool) -> Column:
    return F.lit(1.0) + F.log("tf") if sublinear else F.col("tf").cast("double")


def counts(df: DataFrame, key: str, analyzer: str) -> DataFrame:
    """(key, term, tf) of the texts. Only the texts are shuffled, by key, into parts of some PART_TEXTS: terms are counted where they arise.

    Grams of characters are made once for each distinct word of a text.
    """
    dealt = df.repartition(min(2_000, 8 + df.count() // PART_TEXTS), key)
    if analyzer == "word":
        return word_terms(dealt, key, "text").groupBy(key, "term").agg(F.count("*").alias("tf"))
    times = words(dealt, key, "text").groupBy(key, "w").agg(F.count("*").alias("times"))
    return word_grams(times).groupBy(key, "term").agg(F.sum("times").alias("tf"))


def idf(tf: DataFrame, n: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """(term, idf, df): smooth inverse document frequency of the corpus; n: one row, its size.

    With max_features the most frequent terms stay, ties by the term: each task keeps its first
    ones before they are merged, so the whole vocabulary is never in one task.
    """
    seen = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(f"df >= {min_df}")
    if max_features:
        seen = seen.orderBy(F.desc("total"), "term").limit(max_features)
    return seen.withColumn("n", n.scalar()).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), "df")


def _fit(df: DataFrame) -> DataFrame:
    """A saved table, for a broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class Space:
    """A corpus (article_id, text) in its TF-IDF space.

    Texts are counted anew in each scan, inside tasks, and only what the next step needs leaves
    them: parts of the terms' frequencies, then the squares of the rarer terms for the rows'
    lengths, then sums for the questions. `weights` (term, idf, df) is the saved vocabulary; terms
    are told apart by 64-bit hashes. Shuffles of terms have a number of parts that grows with the texts.
    """

    def __init__(self, corpus: DataFrame, analyzer: str, min_df: int = 1, sublinear: bool = False, max_features: int | None = None, frequent: int = FREQUENT):
        self.analyzer, self.sublinear, self.frequent, self.spark = analyzer, sublinear, frequent, corpus.sparkSession
        self.texts = Texts(corpus, "article_id", analyzer, WORD_TOKEN, sublinear)
        self.n = n = self.texts.count
        self.few = False
        self.parts = min(2_000, 8 + n // PART_TEXTS)
        seen = self.texts.frequencies().repartition(self.parts, "term").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where(f"df >= {min_df}")
        if max_features:
            seen = seen.orderBy(F.desc("total"), "term").limit(max_features)
        self.weights = settled(seen.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"), "df"))
        self.size = self.weights.count()
        #: weight of terms that `_common` and the joined part of the vocabulary lack: those in one text
        self.alone = math.log((1 + n) / 2) + 1 if min_df <= 1 and not max_features else 0.0

    def of(self, corpus: DataFrame) -> Space:
        """The same vocabulary and weights with the rows of other texts (article_id, text), such as some of the corpus."""
        self._common  # sent once for both
        other = copy(self)
        other.__dict__.pop("norms", None)
        other.few = True
        other.texts = Texts(corpus, "article_id", self.analyzer, WORD_TOKEN, self.sublinear)
        return other

    @cached_property
    def _common(self):
        """Broadcast (terms in order, idf) of the most frequent terms, and whether these are the whole vocabulary."""
        rows = self.weights
        if self.size > self.frequent:  # those of the highest frequencies that have room whole; one row a frequency reaches the driver
            sizes = sorted(rows.groupBy("df").agg(F.count("*")).collect(), reverse=True)
            room = [df for (df, _), upto in zip(sizes, accumulate(n for _, n in sizes)) if upto <= self.frequent]
            rows = rows.where(F.col("df") >= room[-1]) if room else rows.limit(0)
            self.rarer = room[-1] - 1 if room else sizes[0][0]  # no other term is in more texts
        found = rows.select("term", "idf").toArrow()
        terms, idf = found.column(0).to_numpy(), found.column(1).to_numpy()
        order = np.argsort(terms)
        return self.spark.sparkContext.broadcast((terms[order], idf[order])), self.size <= self.frequent

    @cached_property
    def norms(self) -> DataFrame:
        """(article_id, norm): common terms are weighted in the tasks, the squares of others are joined with the vocabulary."""
        sent, whole = self._common
        tf = self.texts.tf

        def make(rows):
            terms, idf = sent.value
            for i, found, n in rows:
                at, known = _places(terms, found)
                square = tf(n) ** 2
                sure = (square[known] * idf[at[known]] ** 2).sum()
                others = found[~known][: 0 if whole else None]
                rest = square[~known][: len(others)]
                yield np.full(len(others) + 1, i), np.append(others, i), np.append(rest, 0.0), np.append(np.zeros(len(others)), sure)

        rows = self.texts.scan(make, "term long, square double, sure double")
        if not whole:
            others = self.weights.where("df > 1" if self.alone else "true").select("term", "idf")
            if self.few:
                rows = settled(rows)
                others = others.join(_fit(rows.select("term").distinct()), "term", "left_semi")
            rows = rows.repartition(self.parts, "term").join(others.repartition(self.parts, "term"), "term", "left").select("article_id", (F.col("sure") + F.col("square") * F.pow(F.coalesce("idf", F.lit(self.alone)), F.lit(2.0))).alias("sure"))
        return settled(rows.groupBy("article_id").agg(F.sqrt(F.sum("sure")).alias("norm")))

    def asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, qw) of queries (query_id, text), saved; terms that the corpus lacks are dropped."""
        texts = Texts(queries, "query_id", self.analyzer, WORD_TOKEN, self.sublinear)
        if self.size <= self.frequent:
            (sent, _), tf = self._common, texts.tf

            def make(rows):
                terms, idf = sent.value
                for i, found, n in rows:
                    at, known = _places(terms, found)
                    w = tf(n[known]) * idf[at[known]]
                    yield np.full(len(w), i), found[known], w / np.sqrt((w * w).sum() or 1)

            return settled(texts.scan(make, "term long, qw double"))
        found = settled(texts.counted())
        raw = found.join(self._known(found), "term").select("query_id", "term", (_tf(self.sublinear) * F.col("idf")).alias("w"))
        length = Window.partitionBy("query_id")
        return settled(raw.select("query_id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(length))).alias("qw")))

    def _known(self, asked: DataFrame) -> DataFrame:
        """The vocabulary's rows for the terms of `asked`, a saved table; the vocabulary is not shuffled for them while they are few."""
        return self.weights.join(_fit(settled(asked.select("term").distinct())), "term", "left_semi")

    def entries(self, terms: DataFrame | None = None) -> DataFrame:
        """(article_id, term, w, df) of unit rows; with terms (term) only theirs leave an article's row."""
        known = self.weights if terms is None else self.weights.join(terms.distinct(), "term", "left_semi")
        rows = self.texts.counted().join(_fit(known), "term").select("article_id", "term", "df", (_tf(self.sublinear) * F.col("idf")).alias("w"))
        return rows.join(_fit(self.norms), "article_id").select("article_id", "term", (F.col("w") / F.col("norm")).alias("w"), "df")

    def _send(self, asked: DataFrame):
        """Broadcast (terms in order, where their questions begin, how many, questions' numbers, weights), and (query, query_id)."""
        table = asked.join(self._known(asked), "term").select("query_id", "term", (F.col("qw") * F.col("idf")).alias("w")).toArrow()
        queries = table.column("query_id").combine_chunks().dictionary_encode()
        order = np.argsort(table.column("term").to_numpy(), kind="stable")
        terms, first, size = np.unique(table.column("term").to_numpy()[order], return_index=True, return_counts=True)
        sent = self.spark.sparkContext.broadcast((terms, first, size, queries.indices.to_numpy()[order].astype(np.int64), table.column("w").to_numpy()[order]))
        names = self.spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(queries.dictionary))), "query_id": queries.dictionary})) if len(queries.dictionary) else asked.select(F.lit(0).cast("long").alias("query"), "query_id").limit(0)
        return sent, names

    def scores(self, asked: DataFrame) -> DataFrame:
        """score(query_id, article_id) of asked (query_id, term, qw): while those are few, sums leave the tasks in place of terms."""
        if asked.count() > BROADCAST_ROWS:
            both = self.entries(asked.select("term")).join(asked, "term")
            return both.groupBy("article_id", "query_id").agg(F.sum(F.col("qw") * F.col("w")).alias("score")).select("query_id", "article_id", "score")
        sent, names = self._send(asked)
        tf = self.texts.tf

        def make(rows):
            terms, first, size, query, w = sent.value
            for i, found, n in rows:
                one, dots = _dots(terms, first, size, query, w, found, tf(n))
                yield np.full(len(one), i), one, dots

        found = self.texts.scan(make, "query long, dot double").join(F.broadcast(names), "query").join(_fit(self.norms), "article_id")
        return found.select("query_id", "article_id", (F.col("dot") / F.col("norm")).alias("score"))


    def best(self, asked: DataFrame, k: int, corpus: DataFrame) -> DataFrame:
        """`scores` of all articles that may be among a question's k best, ties included; corpus: the space's own texts.

        A row's length lies between bounds that need no join: common terms are weighted in the
        task, others weigh at least as those just too rare to be common and at most as those of one
        text. So a task passes on only rows that may still reach the k-th best score that it has
        met; the lengths are then taken exactly for the few articles left. Questions of more rows
        than are sent at once are taken in several passes.
        """
        passes = math.ceil(asked.count() / BROADCAST_ROWS)
        if passes > 1:
            parts = [self.best(settled(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)), k, corpus) for i in range(passes)]
            return reduce(DataFrame.unionByName, parts)
        (sent, names), (common, whole), tf = self._send(asked), self._common, self.texts.tf
        least = 0.0 if whole or not self.alone else math.log((1 + self.n) / (1 + self.rarer)) + 1
        most = 0.0 if whole else math.log((1 + self.n) / 2) + 1

        def make(rows, best):
            terms, idf = common.value
            for i, found, n in rows:
                f = tf(n)
                one, dots = _dots(*sent.value, found, f)
                if not len(one):
                    continue
                at, known = _places(terms, found)
                sure, rest = (f[known] ** 2 * idf[at[known]] ** 2).sum(), (f[~known] ** 2).sum()
                low, high = math.sqrt(sure + rest * least**2), math.sqrt(sure + rest * most**2)
                best.add(i, one, dots, dots / high, dots / max(low, 1e-300))

        rows = settled(self.texts.gathered(make, "query long, dot double, low double, high double", lambda: _Best(k)))
        nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))
        kth = rows.select("query", "low", nth.alias("r")).where(f"r = {k}").select("query", F.col("low").alias("kth"))
        left = rows.join(kth, "query", "left").where(f"kth is null or high >= kth - {TIE}").select("article_id", "query", "dot", "high")
        if whole:
            return left.join(F.broadcast(names), "query").select("query_id", "article_id", F.col("high").alias("score"))
        left = settled(left)
        mine = settled(corpus.select("article_id", "text").join(_fit(left.select("article_id").distinct()), "article_id", "left_semi"))
        found = left.join(F.broadcast(names), "query").join(_fit(self.of(mine).norms), "article_id")
        return found.select("query_id", "article_id", (F.col("dot") / F.col("norm")).alias("score"))


def _dots(terms: np.ndarray, first: np.ndarray, size: np.ndarray, query: np.ndarray, w: np.ndarray, found: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Questions that share terms with a text (terms `found` with factors `f`), and their products."""
    at, known = _places(terms, found)
    at, f = at[known], f[known]
    many = size[at]
    ends = np.cumsum(many)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - ends + many, many)
    asking, parts = query[places], w[places] * np.repeat(f, many)
    if len(asking) and asking.max() < 8 * len(asking):  # few questions: no sort
        hits = np.bincount(asking)
        one = np.flatnonzero(hits)
        return one, np.bincount(asking, parts)[one]
    one, back = np.unique(asking, return_inverse=True)
    return one, np.bincount(back, parts, len(one))


class _Best:
    """One task's rows (place, query, dot, low, high) whose `high` reaches the k-th best `low` that it has met for the query."""

    def __init__(self, k: int):
        self.k, self.met = k, np.full((0, k), -np.inf)  # k best bounds of each query, ascending
        self.kept, self.new, self.held = None, [], 0

    def add(self, place: int, query: np.ndarray, dot: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        if query[-1] >= len(self.met):  # queries ascend
            self.met = np.vstack([self.met, np.full((query[-1] + 1 - len(self.met), self.k), -np.inf)])
        some = high >= self.met[query, 0] - TIE
        self.new.append((np.full(np.count_nonzero(some), place), query[some], dot[some], low[some], high[some]))
        self.held += len(self.new[-1][0])
        if self.held >= HELD:
            self.compact()

    def compact(self) -> None:
        """The bounds of rows not yet counted are counted, and rows below them leave."""
        if self.new:
            columns = [np.concatenate(c) for c in zip(*self.new)]
            order = np.lexsort((-columns[3], columns[1]))
            query, low = columns[1][order], columns[3][order]
            first = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, int)
            rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
            better = np.full((len(self.met), self.k), -np.inf)
            better[query[rank < self.k], rank[rank < self.k]] = low[rank < self.k]
            self.met = np.sort(np.hstack([self.met, better]), axis=1)[:, -self.k :]
            self.kept = columns if self.kept is None else [np.concatenate(c) for c in zip(self.kept, columns)]
            self.new, self.held = [], 0
        if self.kept is not None:
            some = self.kept[4] >= self.met[self.kept[1], 0] - TIE
            self.kept = [c[some] for c in self.kept]

    def take(self, all_of_them: bool) -> list[np.ndarray] | None:
        """Rows to pass on: all, or those kept if they are too many to stay."""
        if all_of_them:
            self.compact()
        if self.kept is None or not len(self.kept[0]) or not (all_of_them or len(self.kept[0]) >= HELD):
            return None
        out, self.kept = self.kept, None
        return out


def _places(terms: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where `found` are in `terms`, which are in order, and which of them are there."""
    at = np.searchsorted(terms, found)
    at[at == len(terms)] = 0
    return at, (terms[at] == found) if len(terms) else np.zeros(len(found), bool)


def tfidf_scores(corpus: DataFrame, queries: DataFrame, analyzer: str, min_df: int = 1, sublinear: bool = False, max_features: int | None = None) -> DataFrame:
    """score(query_id, article_id, score > 0): cosine of queries (query_id, text) and corpus (article_id, text)."""
    space = Space(corpus, analyzer, min_df, sublinear, max_features)
    return space.scores(space.asked(queries))


def best_scores(corpus: DataFrame, queries: DataFrame, analyzer: str, k: int, min_df: int = 1, sublinear: bool = False) -> DataFrame:
    """`tfidf_scores` of all pairs that may be among a query's k best."""
    space = Space(corpus, analyzer, min_df, sublinear)
    return space.best(space.asked(queries), k, corpus)


def lexical_channels(articles: DataFrame, queries: DataFrame) -> DataFrame:
    """(channel, query_id, article_id, score) over clean bodies and titles, words and characters."""
    out = None
    for channel, column, analyzer, min_df in (("body_word", "clean_body", "word", 1), ("body_char", "clean_body", "char", 2), ("title_word", "clean_title", "word", 1), ("title_char", "clean_title", "char", 1)):
        corpus = articles.select("article_id", F.col(column).alias("text"))
        one = tfidf_scores(corpus, queries, analyzer, min_df, analyzer == "char").select(F.lit(channel).alias("channel"), "query_id", "article_id", "score")
        out = one if out is None else out.unionByName(one)
    return out


def query_similarity(references: DataFrame, targets: DataFrame, word: float = 0.3, char: float = 0.7, char_min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """sim(target_id, ref_id, sim) of lexically normalised texts; the vocabulary is the references'."""
    corpus = references.select(F.col("ref_id").alias("article_id"), "text")
    asked = targets.select(F.col("target_id").alias("query_id"), "text")
    parts = [tfidf_scores(corpus, asked, "word", 1, True).withColumn("score", F.col("score") * word), tfidf_scores(corpus, asked, "char", char_min_df, True, max_features).withColumn("score", F.col("score") * char)]
    return parts[0].unionByName(parts[1]).groupBy(F.col("query_id").alias("target_id"), F.col("article_id").alias("ref_id")).agg(F.sum("score").alias("sim"))


def best_chunks(chunks: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best chunk of each candidate article per query; chunks without overlap count 0, ties the first.

    The vocabulary is that of all chunks; only those of candidates are scored, and only their pairs
    are kept, so what is shuffled grows with the candidates.
    """
    candidates = settled(candidates.select("query_id", "article_id"))
    mine = settled(chunks.join(_fit(candidates.select("article_id").distinct()), "article_id", "left_semi").select("article_id", "chunk_id", "text"))
    texts = lambda df: df.select(F.struct("article_id", "chunk_id").alias("article_id"), "text")
    parts = []
    for weight, (analyzer, min_df, most) in ((0.4, ("word", 1, None)), (0.6, ("char", 2, 300_000))):
        space = Space(texts(chunks), analyzer, min_df, True, most)
        found = space.of(texts(mine)).scores(space.asked(queries)).select("query_id", "article_id.article_id", "article_id.chunk_id", (F.col("score") * weight).alias("sim"))
        parts.append(found.join(candidates, ["query_id", "article_id"], "left_semi"))
    sim = parts[0].unionByName(parts[1]).groupBy("query_id", "article_id", "chunk_id").agg(F.sum("sim").alias("sim"))
    every = candidates.join(mine.select("article_id", "chunk_id"), "article_id")
    scored = every.join(sim, ["query_id", "article_id", "chunk_id"], "left").withColumn("sim", F.round(F.coalesce("sim", F.lit(0.0)), 9))
    rank = F.row_number().over(Window.partitionBy("query_id", "article_id").orderBy(F.desc("sim"), "chunk_id"))
    return scored.withColumn("r", rank).where("r = 1").drop("r")
