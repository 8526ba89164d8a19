"""The registered queries of this subpackage: operators over whole tables, as digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitlens.llm import (
    decontaminate,
    filter_audit,
    main_text,
    merkle,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    repeats,
    simhash,
    token_count,
    token_output,
    toxicity,
)
from remitlens.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@register
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted",
        F.size("segments").alias("n_segments"), "evidence",
    )


@register
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@register
def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_output.packed_matrices(documents(spark, sf_dir), path)


@register
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.best_fit_pack(documents(spark, sf_dir), path)


@register
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir)).drop("spans")


@register
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@register
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_count.count_tokens(documents(spark, sf_dir), path)


@register
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long"), "text")
    machine = quality_classifier.fit_quality(docs, table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    return quality_classifier.score_quality(docs, machine).select(
        "doc_id", toxicity.held_out().alias("held_out"), score.alias("score"),
        (score >= quality_classifier.PASS_AT).cast("int").alias("predicted"),
    )


@register
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return decontaminate.digest(found)


@register
def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pii.replace_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    return replaced.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_replaced")


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(merkle.leaves(documents(spark, sf_dir)))
    folded = merkle.fold(F.coalesce("altered", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@register
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@register
def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")
