"""Text expressions: normalisation, chunks, passages, prompts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: sizes and prompts of the retrieval task
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_MAX = 150, 35, 180
RERANK_CHUNK, RERANK_STEP = 120, 90
PASSAGE_CHARS = 6000


def _normal(value: str | None) -> str | None:
    if value is None:
        return None
    value = unicodedata.normalize("NFKC", value).replace("ё", "е").replace("Ё", "Е")
    return " ".join("".join(c for c in value if c.isprintable() or c.isspace()).split())


@F.pandas_udf(StringType())
def _normalize(values: pd.Series) -> pd.Series:
    return values.map(_normal, na_action="ignore")


def normalize_text(c: Column) -> Column:
    """NFKC, yo folded, unprintable characters dropped, white space collapsed; case stays.

    Plain printable ASCII, which needs only the last step, stays in the JVM.
    """
    plain = F.trim(F.regexp_replace(c, " +", " "))
    return F.when(c.rlike(r"^[\x20-\x7E]*$"), plain).otherwise(_normalize(F.when(~c.rlike(r"^[\x20-\x7E]*$"), c)))


def normalize_lexical_text(c: Column) -> Column:
    """Lower-cased runs of Latin and Russian letters and digits, one space between."""
    return F.array_join(F.regexp_extract_all(F.translate(F.lower(c), "ё", "е"), F.lit("[a-zа-я0-9]+"), F.lit(0)), " ")


def parse_ground_truth(c: Column) -> Column:
    """Ids of a white-space-separated list; repeats stay."""
    parts = F.filter(F.split(F.trim(c), r"\s+"), lambda v: v != "")
    return F.transform(parts, lambda v: v.cast("bigint"))


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda v: v != "")


def _windows(words: Column, count: Column, size, step: int, last_open: bool) -> Column:
    def piece(w: Column, i: Column) -> Column:
        length = F.when(i == count, F.greatest(F.size(w), F.lit(1))).otherwise(F.lit(size)) if last_open else F.lit(size)
        return F.array_join(F.slice(w, (i * step + 1).cast("int"), length), " ")

    return F.transform(F.sequence(F.lit(0), count), lambda i: piece(words, i))


def split_text(df: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Adds chunk_id and chunk: overlapping word windows; what is left under the maximum is one."""
    if not 0 <= overlap < size <= CHUNK_MAX:
        raise ValueError("chunk size or overlap out of range")
    step = size - overlap
    words = df.withColumn("__w", split_words(F.col(text))).where(F.size("__w") > 0)
    count = F.when(F.size("__w") <= CHUNK_MAX, F.lit(0)).otherwise(F.ceil((F.size("__w") - CHUNK_MAX) / step)).cast("int")
    places = words.withColumn("__k", count).select("*", F.explode(F.sequence(F.lit(0), F.col("__k"))).alias("chunk_id"))
    length = F.when(F.col("chunk_id") == F.col("__k"), F.size("__w")).otherwise(F.lit(size))
    return places.withColumn("chunk", F.array_join(F.slice("__w", F.col("chunk_id") * step + 1, length), " ")).withColumn("chunk_id", F.col("chunk_id").cast("long")).drop("__w", "__k")


def build_article_chunks(articles: DataFrame) -> DataFrame:
    out = split_text(articles.select("article_id", "clean_title", "clean_body"), "clean_body")
    return out.select("article_id", "chunk_id", F.concat("clean_title", F.lit("\n"), "chunk").alias("text"))


def reranker_chunks(articles: DataFrame) -> DataFrame:
    """article_id, chunk_id, text: windows of 120 words at every 90th; an empty body gives one."""
    words = articles.select("article_id", "title", split_words(F.col("dense")).alias("w"))
    places = words.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.size("w"), F.lit(1)) - 1) / RERANK_STEP).cast("int"))).alias("chunk_id"))
    return places.select("article_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.concat("title", F.lit("\n"), F.array_join(F.slice("w", F.col("chunk_id") * RERANK_STEP + 1, F.lit(RERANK_CHUNK)), " ")).alias("text"))


def article_passages(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", F.concat("title", F.lit("\n"), F.substring("dense", 1, PASSAGE_CHARS)).alias("passage"))


def instructed(c: Column, task: str) -> Column:
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), c)


def rerank_prompt(query: Column, passage: Column, task: str) -> Column:
    """What a pairwise model reads: the task, then query and passage."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query, F.lit("\nDocument: "), passage)
