"""The queries of the corpus operators, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import decontamination, html_extraction, language_id, merkle, ngram_join, oracles, packing, quality_classifier, quality_rules, quantiles, secret_scans, suffix_tree, token_counts, toxicity
from sieveline.llm.common import table

BYTE_BPE = "byte_bpe_50k.json"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.scan(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op12_quantile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.deciles(spark, sf_dir)


def op13_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_quality_classifier, op3_best_fit_packing, op4_quality_rules, op5_decontamination, op6_toxicity, op7_token_counts, op8_language_id, op9_secret_scans, op10_html_extraction, op11_merkle_manifest, op12_quantile_summaries, op13_suffix_tree_scores)}
#: The others learn, tokenize, parse or lex: they are tested against brute force, the libraries and held-out labels.
ORACLES = {"op1_ngram_jaccard_join": oracles.NGRAM_JACCARD, "op4_quality_rules": oracles.QUALITY_RULES, "op5_decontamination": oracles.DECONTAMINATION, "op11_merkle_manifest": oracles.MERKLE, "op12_quantile_summaries": oracles.QUANTILES}
