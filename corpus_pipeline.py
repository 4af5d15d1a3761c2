"""Documents to packed training sequences: five stages, each on what the one before it kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, table
from lodestone.llm.decontamination import clean
from lodestone.llm.language_id import fit, identify
from lodestone.llm.near_duplicates import near_duplicates
from lodestone.llm.packing import pack
from lodestone.llm.pseudonyms import pseudonymise
from lodestone.llm.queries import KEY

#: Columns that the stages know; others pass through them under names that cannot clash with their own.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")

#: Documents whose language is less certain go, with those that have none.
LEAST_SCORE = 0.5


def _apart(stage: Callable) -> Callable:
    """The stage with further columns of `docs` renamed on the way."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: f"__column_{k}" for k, c in enumerate(docs.columns) if c not in KNOWN}
        return stage(spark, docs.withColumnsRenamed(names), sf_dir).withColumnsRenamed({v: c for c, v in names.items()})

    return run


@_apart
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Written here, so that the texts go through Python in small batches."""
    found = identify(docs, fit(docs.select("doc_id", "text", "lang")))
    found = found.where(f"lang_pred <> 'und' and score >= {LEAST_SCORE}").drop("lang_pred", "score")
    return Workspace(spark, "languages").save(found, "kept")


@_apart
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group, once; documents without an id stay.

    Different texts under one id are different documents: each gets a number of its own first.
    """
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("th")).distinct()
    reused = texts.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("th").alias("th")).where("n > 1")
    if not reused.isEmpty():
        return _near_dedup_of_reused(spark, docs, texts, reused)
    kept = near_duplicates(docs, size=5, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.union(docs.where("doc_id is null")).select(docs.columns)


def _near_dedup_of_reused(spark: SparkSession, docs: DataFrame, texts: DataFrame, reused: DataFrame) -> DataFrame:
    space = Workspace(spark, "numbered")
    after = texts.agg(F.max("doc_id")).first()[0] + 1
    others = texts.join(reused.select("doc_id", F.col("th").alias("own")), "doc_id").where("th <> own")
    others = others.select("doc_id", "th", (F.monotonically_increasing_id() + after).alias("row_id"))
    others = space.save(others, "others")
    named = docs.where("doc_id is not null").withColumn("th", F.xxhash64("text")).dropDuplicates(["doc_id", "th"])
    named = named.join(others, ["doc_id", "th"], "left").withColumn("row_id", F.coalesce("row_id", "doc_id")).drop("th")
    named = space.save(named, "documents")
    groups = near_duplicates(named.select(F.col("row_id").alias("doc_id"), "text"), size=5, percent=80).select(F.col("doc_id").alias("row_id"), "component_id")
    kept = groups.join(named.select("row_id", "doc_id"), "row_id").groupBy("component_id").agg(F.min(F.struct("doc_id", "row_id")).alias("first")).select("first.row_id")
    return named.join(kept, "row_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null").select(docs.columns))


@_apart
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


@_apart
def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pseudonymise(docs, KEY).drop("n_pii")
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(docs.columns)


@_apart
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("pseudonyms", pseudonyms), ("packing", packing)]

#: The first stage's model and the last one's tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = space.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
