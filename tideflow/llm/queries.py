"""The numbered operators' queries, each over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tideflow.llm import decontamination, filter_audit, mixing, packing, ranked_search
from tideflow.llm.common import table
from tideflow.llm.license_scan import license_scan
from tideflow.llm.lm_mixing import lm_scores
from tideflow.llm.ngram_join import jaccard_components
from tideflow.llm.pii import find_pii
from tideflow.llm.quality_rules import quality
from tideflow.llm.secret_scan import find_secrets
from tideflow.llm.substring_dedup import remove_repeats
from tideflow.llm.toxicity import toxicity_scores


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document. Nulls, repeats and empty tables: see the operator."""
    return license_scan(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document. Nulls, repeats and empty tables: see the operator."""
    return find_pii(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document. Nulls, repeats and empty tables: see the operator."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and mixing-model scores of every document. Nulls, repeats and empty tables: see the operator."""
    return lm_scores(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document. Nulls, repeats and empty tables: see the operator."""
    return quality(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document. Nulls, repeats and empty tables: see the operator."""
    return find_secrets(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document. Nulls, repeats and empty tables: see the operator."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in benchmark windows. Nulls, repeats and empty tables: see the operator."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_near", "row")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of a similarity of 0.8 or more on five-word shingles. Nulls, repeats and empty tables: see the operator."""
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that passages of 35 words or more, found elsewhere, cover. Nulls, repeats and empty tables: see the operator."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text", "row")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten best documents. Nulls, ties, repeats and empty tables: see the operator."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order of five filters removes at each step, by source. Nulls, repeats and empty tables: see the operator."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 ids. Nulls, ties, repeats and empty tables: see the operator."""
    return packing.pieces_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_pii,
        op3_mixing,
        op4_lm_scores,
        op5_quality_rules,
        op6_secret_scan,
        op7_toxicity,
        op8_decontamination,
        op9_ngram_jaccard,
        op10_substring_dedup,
        op11_ranked_search,
        op12_filter_audit,
        op13_packing,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.ORACLE, "op8_decontamination": decontamination.ORACLE, "op11_ranked_search": ranked_search.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
