"""The registered queries of the numbered operators and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import byte_bpe, conversation_repair, exact_dedup, hmm_scoring, html_extraction, language_id, near_dedup, packing, quality_classifier, quality_rules, secret_scan, spelling_variants, sql, substring_dedup
from riskframe.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, equivalent: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if equivalent is not None:
            ORACLES[name] = equivalent
        return fn

    return register


@query("op1_quality_rules", sql.QUALITY_RULES)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *[f"{m}_high" for m in quality_rules.METRICS], "word_length_low",
    )


@query("op2_exact_dedup", sql.EXACT_DEDUP)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op3_substring_dedup", sql.SUBSTRING_DEDUP)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256")
    )


@query("op6_near_dedup", sql.NEAR_DEDUP)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), 2).select("doc_id", "n_shingles", "component_id", "kept")


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = packing.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary)


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


@query("op4_secret_scan", sql.SECRET_SCAN)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{name}") for i, (name, *_) in enumerate(secret_scan.KINDS)],
        F.sha2(F.encode(secret_scan.listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
        F.size("owned").cast("bigint").alias("n_owned"),
    )


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


@query("op9_hmm_scoring")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scoring.hmm_scores(table(spark, sf_dir, "documents"))


@query("op11_conversation_repair", sql.CONVERSATION_REPAIR)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_report(rows, "present")


@query("op12_spelling_variants", sql.SPELLING_VARIANTS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_quality_classifier")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
