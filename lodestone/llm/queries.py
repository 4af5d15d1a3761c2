"""The registered queries of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import sql
from lodestone.llm.chat_format import format_preferences, neighbour_pairs
from lodestone.llm.common import table
from lodestone.llm.decontamination import leaks
from lodestone.llm.html_extraction import extract_pages
from lodestone.llm.language_id import fit, identify
from lodestone.llm.near_duplicates import near_duplicates
from lodestone.llm.packing import pack
from lodestone.llm.piecewise_hash import fingerprints
from lodestone.llm.pseudonyms import pseudonymise
from lodestone.llm.quality_rules import quality
from lodestone.llm.repeated_text import remove_repeated
from lodestone.llm.spelling_variants import spelling_variants
from lodestone.llm.token_alignment import align_tokens
from lodestone.llm.token_output import materialise

#: Stand-in for the secret key of a production run.
KEY = "lodestone-demo-key"


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.expr("coalesce(crc32(cast(doc_id as string)) % 5 = 0, false)").alias("held_out")
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held, "lang_pred", "score")


def op3_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(table(spark, sf_dir, "documents"), length=200).drop("kept_text")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(table(spark, sf_dir, "documents"), KEY)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return quality(table(spark, sf_dir, "documents"), trusted)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op8_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    out = format_preferences(turns, neighbour_pairs(turns))
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), " ")
    return out.select("pair_id", "chosen_id", "rejected_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt", "chosen", mask("chosen_spans").alias("chosen_mask"), "rejected", mask("rejected_spans").alias("rejected_mask"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))[0]


def op12_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_language_id, op3_repeated_text, op4_token_output, op5_html_extraction, op6_quality_rules, op7_pseudonyms, op8_preference_format, op9_packing, op10_decontamination, op11_token_alignment, op12_piecewise_hash, op13_spelling_variants)}
ORACLES = sql.ORACLES
