"""Encoders and rerankers: stand-ins that need no weights, and the place for real models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.scores import high_score, minmax, rank
from lodestone.operators.tfidf import best_chunks

CANDIDATES = 15


#: Words and grams whose places an encoder keeps; it starts anew when it has so many.
KEPT_WORDS, KEPT_GRAMS = 50_000, 200_000


def hashing_encoder(dimension: int = 256) -> Callable[[list[str]], np.ndarray]:
    """Signed feature hashing of 3- to 5-character grams, rows of length one. Not a trained model.

    Words and grams are hashed once, not each time that they are met.
    """
    known: dict[str, np.ndarray] = {}
    grams: dict[str, int] = {}

    def place(gram: str) -> int:
        if gram not in grams:
            if len(grams) >= KEPT_GRAMS:
                grams.clear()
            h = int.from_bytes(hashlib.blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            grams[gram] = h % dimension + (0 if h >> 63 else dimension)
        return grams[gram]

    def places(word: str) -> np.ndarray:
        """Places of the word's grams, those of negative sign after the others."""
        if word not in known:
            if len(known) >= KEPT_WORDS:
                known.clear()
            w = f" {word} "
            known[word] = np.array([place(w[i : i + n]) for n in (3, 4, 5) for i in range(max(len(w) - n + 1, 1))], np.int32)
        return known[word]

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, text in zip(out, texts):
            words = (text or "").lower().split()
            if words:
                n = np.bincount(np.concatenate([places(w) for w in words]), minlength=2 * dimension)
                row[:] = n[:dimension] - n[dimension:]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


#: Tokens of a text that an encoder reads, and of a question with its passage that a reranker reads.
TEXT_TOKENS, PAIR_TOKENS = 512, 256


def padded(tokenized: list[list[int]], most: int, pad_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of one batch: the first `most` tokens of each text, filled up on the left to the longest's length."""
    rows = [t[:most] for t in tokenized]
    width = max(map(len, rows), default=0)
    ids, mask = np.full((len(rows), width), pad_id, np.int64), np.zeros((len(rows), width), np.int64)
    for k, row in enumerate(rows):
        if row:
            ids[k, -len(row) :], mask[k, -len(row) :] = row, 1
    return ids, mask


def _by_length(texts: list[str], tokenize: Callable[[list[str]], list[list[int]]], most: int, batch_size: int, pad_id: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Batches of texts of about the same length, with their places in `texts`."""
    tokenized = tokenize([t or "" for t in texts])
    order = sorted(range(len(texts)), key=lambda k: (len(tokenized[k]), k))
    for at in range(0, len(order), batch_size):
        places = order[at : at + batch_size]
        yield places, *padded([tokenized[k] for k in places], most, pad_id)


def token_encoder(tokenize: Callable[[list[str]], list[list[int]]], forward: Callable[[np.ndarray, np.ndarray], np.ndarray], dimension: int, batch_size: int = 64, most: int = TEXT_TOKENS, pad_id: int = 0) -> Callable[[list[str]], np.ndarray]:
    """An encoder for `encode` from a tokenizer and a model.

    `forward` gets (ids, mask), padded on the left, and returns a vector a token; a text's is its
    last token's, brought to length one. A text without tokens has the zero vector.
    """

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for places, ids, mask in _by_length(texts, tokenize, most, batch_size, pad_id):
            some = np.flatnonzero(mask.any(axis=1))
            if len(some):
                last = np.asarray(forward(ids[some], mask[some]), np.float32)[:, -1]
                norm = np.linalg.norm(last, axis=1, keepdims=True)
                out[np.array(places)[some]] = last / np.where(norm > 0, norm, 1)
        return out

    return run


def token_scorer(load: Callable[[], tuple[Callable, Callable]], batch_size: int = 4, most: int = PAIR_TOKENS, pad_id: int = 0) -> Callable[[DataFrame], DataFrame]:
    """A scorer for `rerank` from a pairwise model: (query_id, article_id, logit) of rows with a prompt.

    `load` runs once in each task and gives the tokenizer and a model that returns a logit a row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = None
        for b in batches:
            loaded = loaded or load()
            logits = np.zeros(len(b))
            for places, ids, mask in _by_length(b["prompt"].tolist(), loaded[0], most, batch_size, pad_id):
                logits[places] = loaded[1](ids, mask)
            yield b[["query_id", "article_id"]].assign(logit=logits)

    return lambda pairs: pairs.select("query_id", "article_id", "prompt").mapInPandas(run, "query_id long, article_id long, logit double")


def encode(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_encoder, batch_size: int = 64) -> DataFrame:
    """(key, embedding): `load` runs once in each worker, on its first batch; the model gets batch_size texts at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or load()
            texts = b[text].tolist()
            for at in range(0, len(texts), batch_size):
                part = slice(at, at + batch_size)
                yield pd.DataFrame({key: b[key].iloc[part].tolist(), "embedding": list(model(texts[part]))})

    return df.select(key, text).mapInPandas(run, f"{key} long, embedding array<float>")


def candidate_logits(base: DataFrame, chunks: DataFrame, queries: DataFrame, cached: DataFrame | None = None, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, article_id, logit) of each query's best CANDIDATES articles.

    Logits of a cache are used where they exist; only missing pairs are scored. A scorer gets
    (query_id, article_id, query, passage), the passage being the article's best chunk of all
    chunks; the default one is that chunk's lexical similarity.
    """
    pairs = rank(base, CANDIDATES).select("query_id", "article_id")
    if cached is None:
        return pair_logits(pairs, chunks, queries, score)
    made = pair_logits(pairs.join(cached, ["query_id", "article_id"], "left_anti"), chunks, queries, score)
    return made.unionByName(pairs.join(cached, ["query_id", "article_id"]).select("query_id", "article_id", "logit"))


def pair_logits(pairs: DataFrame, chunks: DataFrame, queries: DataFrame, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, article_id, logit) of the given pairs."""
    best = best_chunks(chunks, queries, pairs)
    if score is None:
        return best.select("query_id", "article_id", F.col("sim").alias("logit"))
    asked = best.join(chunks.withColumnRenamed("text", "passage"), ["article_id", "chunk_id"]).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    return score(asked.select("query_id", "article_id", "query", "passage"))


def fuse(base: DataFrame, logits: DataFrame) -> DataFrame:
    return high_score(base, minmax(logits.withColumnRenamed("logit", "score")))


def rerank(base: DataFrame, chunks: DataFrame, queries: DataFrame, cached: DataFrame | None = None, score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fuse base scores with reranked scores of each query's best CANDIDATES articles (see candidate_logits)."""
    return fuse(base, candidate_logits(base, chunks, queries, cached, score))
