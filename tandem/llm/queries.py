"""Registered queries of the numbered operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandem.llm import conversations, decontamination, lm_score, mixing, near_dedup, packing, periodic, pii, quality, secrets, token_counts, topk, toxicity
from tandem.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every length of the documents, read as a context limit."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms of every whole document."""
    return pii.personal_data_digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document under the model of those not held out."""
    return lm_score.language_scores(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document with its score, learned from the labels not held out."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best matches of every vector whose id is divisible by 50, among all vectors."""
    return topk.top_k_of_every(table(spark, sf_dir, "embeddings"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document."""
    return secrets.secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document with its measures and the verdict of its host."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged as the contract says, with its faults and its cheapest repair."""
    return conversations.audits(conversations.damaged(table(spark, sf_dir, "conversations")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document, a tenth of them with the contract's repetition, with its periodic runs."""
    return periodic.run_digest(periodic.periodic_runs(table(spark, sf_dir, "documents"), faulty=True))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document against every window of the benchmark."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_pii, op3_near_dedup, op4_lm_score, op5_packing, op6_mixing, op7_toxicity, op8_topk, op9_secrets, op10_quality,
        op11_conversations, op12_periodic_runs, op13_decontamination,
    )
}
ORACLES = {"op6_mixing": mixing.MIX_SQL, "op8_topk": topk.TOP_K_SQL, "op10_quality": quality.QUALITY_SQL, "op11_conversations": conversations.REPAIR_SQL, "op13_decontamination": decontamination.CONTAMINATION_SQL}
