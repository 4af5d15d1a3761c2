"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestone.llm.common import lean, release_worker, ship
from lodestone.llm.hashing import mix

if TYPE_CHECKING:
    import pandas as pd

#: Bound of the sample that is fitted: labelled documents of each language.
PER_LANGUAGE = 400
ITERATIONS = 3
#: More labels than this are an error: each has a column of the model, and so many are no languages.
MAX_LANGUAGES = 1000
#: Times the sample that may pass a test of the id's hash before it is ranked.
MARGIN = 1.5
#: Added to each piece's expected count.
PRIOR = 0.05
#: Probability of a character that no piece covers, for every language.
UNKNOWN = 1e-9
#: A word's place in a text's evidence; more words than this sharpen the score no further.
EVIDENCE = 40
CACHE_WORDS = 200_000
#: Letters of a word that is scored along with others of its length; texts and words that are at once.
TOGETHER, TOGETHER_CHARS, CHUNK_WORDS = 64, 500_000, 50_000
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.multiply.accumulate(np.array([1] + [int(_BASE)] * (TOGETHER + 1), np.uint64))
_LETTERS = re.compile(r"[^\W\d_]+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[str]:
    """The pieces of a public vocabulary that consist of letters, word starts marked."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if p == "▁" or _LETTERS.fullmatch(p.removeprefix("▁")))


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return _LETTERS.findall(text.lower())


def _fit(path: str, iterations: int):
    """Piece probabilities of one language by expectation maximisation."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd  # takes 27 MB of a worker; those that only predict do without

        release_worker()
        counts: Counter = Counter()
        for text in rows["text"]:
            counts.update("▁" + w for w in words_of(text))
        pieces = vocabulary(path)
        known, longest = set(pieces), max(map(len, pieces))
        expected = dict.fromkeys(pieces, 0.0)
        for w, c in counts.items():  # at first every piece that occurs counts by its length
            for i in range(len(w)):
                for j in range(i + 1, min(len(w), i + longest) + 1):
                    if w[i:j] in known:
                        expected[w[i:j]] += c * (j - i)
        for _ in range(iterations):
            total = sum(expected.values()) + PRIOR * len(pieces)
            p = {k: (v + PRIOR) / total for k, v in expected.items()}
            expected = dict.fromkeys(pieces, 0.0)
            for w, c in counts.items():
                n = len(w)
                arcs = [(i, j, p[w[i:j]], w[i:j]) for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if w[i:j] in p]
                has = {(i, j) for i, j, _, _ in arcs if j == i + 1}
                arcs += [(i, i + 1, UNKNOWN, None) for i in range(n) if (i, i + 1) not in has]
                arcs.sort()
                ahead, back = [1.0] + [0.0] * n, [0.0] * n + [1.0]
                for i, j, q, _ in arcs:
                    ahead[j] += ahead[i] * q
                for i, j, q, _ in reversed(arcs):
                    back[i] += q * back[j]
                if ahead[n] > 0:
                    for i, j, q, k in arcs:
                        if k:
                            expected[k] += c * ahead[i] * q * back[j] / ahead[n]
        total = sum(expected.values()) + PRIOR * len(pieces)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "piece": pieces, "p": [(expected[k] + PRIOR) / total for k in pieces]})

    return run


class Scorer:
    """Forward algorithm for all languages at once; words are kept in a bounded cache."""

    def __init__(self, langs: list[str], model: dict[str, tuple], cache_words: int = CACHE_WORDS):
        self.langs, self.model, self.longest, self.cache_words = langs, model, max(map(len, model), default=1), cache_words
        self.none = (UNKNOWN,) * len(langs)
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(langs)))
        hashes = np.array([_piece_hash(p) for p in model] or [0], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.p = hashes[order], np.array(list(model.values()) or [self.none])[order]

    def word(self, w: str) -> list[float]:
        """Log probability of one word under each language, over all segmentations."""
        w = "▁" + w
        n, base = len(w), [0.0] * len(self.langs)
        ahead: list = [[1.0] * len(self.langs)] + [None] * n
        for j in range(1, n + 1):
            total = [0.0] * len(self.langs)
            for i in range(max(0, j - self.longest), j):
                q = self.model.get(w[i:j])
                if q is None:
                    if i < j - 1:
                        continue
                    q = self.none
                total = [t + a * x for t, a, x in zip(total, ahead[i], q)]
            ahead[j] = total
            if j % 24 == 0:  # long words: take out a factor, so that nothing underflows
                for k in range(len(self.langs)):
                    f = max(total[k], 1e-300)
                    base[k] += math.log(f)
                    for i in range(max(0, j - self.longest), j + 1):
                        ahead[i] = [x / f if m == k else x for m, x in enumerate(ahead[i])]
        return [b + math.log(max(x, 1e-300)) for b, x in zip(base, ahead[n])]

    def words(self, ws: list[str]) -> np.ndarray:
        """`word` for many words: those of one length go through the forward algorithm together."""
        out = np.zeros((len(ws), len(self.langs)))
        lengths = np.array([len(w) for w in ws], np.int64)
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            if n > TOGETHER:
                out[at] = [self.word(ws[k]) for k in at]
                continue
            codes = np.frombuffer("".join("▁" + ws[k] for k in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), n + 1)
            ahead, base = np.zeros((n + 2, len(at), len(self.langs))), np.zeros((len(at), len(self.langs)))
            ahead[0] = 1.0
            sums = _prefixes(codes)
            for j in range(1, n + 2):
                for i in range(max(0, j - self.longest), j):
                    rank, known = self._rank(sums[:, j] - sums[:, i] * _POWERS[j - i])
                    if i == j - 1:
                        ahead[j] += ahead[i] * np.where(known[:, None], self.p[rank], UNKNOWN)
                    elif (hit := np.flatnonzero(known)).size:
                        ahead[j][hit] += ahead[i][hit] * self.p[rank[hit]]
                if j % 24 == 0:
                    f = np.maximum(ahead[j], 1e-300)
                    base += np.log(f)
                    ahead[max(0, j - self.longest) : j + 1] /= f
            out[at] = base + np.log(np.maximum(ahead[n + 1], 1e-300))
        return out

    def _rank(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return rank, self.hashes[rank] == h

    def _rows(self, ws: list[str]) -> np.ndarray:
        """Their log probabilities; new words enter the cache, which is dropped when it is full."""
        new = list({w: None for w in ws if w not in self.index})
        if len(self.index) + len(new) > self.cache_words:
            self.index.clear()
            new = list(dict.fromkeys(ws))
        if new:
            first = len(self.index)
            self.index.update(zip(new, range(first, first + len(new))))
            if len(self.index) > len(self.table):
                self.table = np.vstack([self.table, np.zeros((max(len(self.table), len(new)), len(self.langs)))])
            self.table[first : first + len(new)] = self.words(new)
        return self.table[list(map(self.index.__getitem__, ws))]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [words_of(t) for t in texts] if self.langs else [[] for _ in texts]
        counts = np.array([len(ws) for ws in found], np.int64)
        owner, flat = np.repeat(np.arange(len(texts)), counts), [w for ws in found for w in ws]
        total = np.zeros((len(self.langs), len(texts)))
        for at in range(0, len(flat), CHUNK_WORDS):
            rows = self._rows(flat[at : at + CHUNK_WORDS])
            for k in range(len(self.langs)):  # adds in the order of the words, wherever chunks end
                np.add.at(total[k], owner[at : at + CHUNK_WORDS], rows[:, k])
        out = []
        for d, n in enumerate(counts.tolist()):
            if not n:
                out.append(("und", 0.0))
                continue
            logs = total[:, d] * min(1.0, EVIDENCE / n)
            best = int(logs.argmax())
            out.append((self.langs[best], float(1.0 / np.exp(logs - logs[best]).sum())))
        return out


def _prefixes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of the prefixes of each row."""
    sums = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    spread = mix(codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for j in range(codes.shape[1]):
        sums[:, j + 1] = sums[:, j] * _BASE + spread[:, j]
    return sums


def _piece_hash(piece: str) -> int:
    return int(_prefixes(np.array([[ord(c) for c in piece]], np.uint32))[0, -1])


def _predict(langs: list[str], model):
    @lean
    def run(batches):
        scorer = Scorer(langs, model.value)
        for b in batches:
            texts, got, part, size = b.column("text"), [], [], 0
            for k in range(len(texts)):
                part.append(texts[k].as_py())
                size += len(part[-1] or "")
                if size >= TOGETHER_CHARS or k == len(texts) - 1:
                    got += scorer.predict(part)
                    part, size = [], 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return run


def fit(docs: DataFrame, path: str | None = None, per_language: int = PER_LANGUAGE, iterations: int = ITERATIONS) -> tuple[list[str], dict[str, tuple]]:
    """Piece probabilities per language from at most `per_language` labelled texts of each.

    Documents whose crc32(doc_id as text) mod 5 is 0 are held out. Which of the others are fitted
    is decided by a hash of doc_id: those under a share of the language's different ids are ranked.
    Of an id that is there more often one text counts. Every label is learned; what comes to the
    driver is bounded by the vocabulary times their number, and over MAX_LANGUAGES is an error.
    """
    ship(docs.sparkSession)
    path = path or vocabulary_path()
    labelled = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("id is not null and lang is not null and text is not null and crc32(id) % 5 <> 0")
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("ids")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} labels in lang")
    sizes = docs.sparkSession.createDataFrame(sizes, "lang string, ids long")
    ids = labelled.select("id", "lang", F.xxhash64("id", "lang").alias("h")).join(F.broadcast(sizes), "lang")
    near = ids.where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("ids") < MARGIN * per_language).select("id", "lang", "h").distinct()
    chosen = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(f"k <= {per_language}").select("id", "lang")
    sample = labelled.join(F.broadcast(chosen), ["id", "lang"]).groupBy("lang", "id").agg(F.min("text").alias("text"))
    rows = sample.select("lang", "text").groupBy("lang").applyInPandas(_fit(path, iterations), "lang string, piece string, p double").collect()
    langs = sorted({r["lang"] for r in rows})
    at = {x: i for i, x in enumerate(langs)}
    model: dict[str, list] = {}
    for r in rows:
        model.setdefault(r["piece"], [UNKNOWN] * len(langs))[at[r["lang"]]] = r["p"]
    return langs, {k: tuple(v) for k, v in model.items()}


def identify(docs: DataFrame, fitted: tuple[list[str], dict[str, tuple]]) -> DataFrame:
    """Add lang_pred and score to `docs`, from the whole text alone.

    `und` with score 0 where the text is null, empty or has no letter. The score is the
    posterior of the predicted language with the evidence of at most EVIDENCE words. All columns
    but older ones of these two names stay; repeated rows get the same answer; an empty table
    stays empty.
    """
    ship(docs.sparkSession)
    langs, model = fitted
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(_predict(langs, docs.sparkSession.sparkContext.broadcast(model)), schema)
