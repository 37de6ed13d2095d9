"""The registered queries of this subpackage and their SQL, where SQL can express them.

Each query applies its operator, with production parameters, to its whole table. Tokenizer files come from the
installed vocabulary package; their paths are parameters of the operators.
"""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from textaxis.llm import (
    decontam, divergence, jaccard, licenses, lm, minhash, oracles, packing, rlz, rules, search, sharding, tokens, warc)


def vocabulary(name: str) -> str:
    """The path of an installed vocabulary file."""
    return importlib.import_module("public_tokenizers").path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_propagation(_table(spark, sf_dir, "documents"), 16)


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.verdicts(_table(spark, sf_dir, "documents"), "v1")
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, alone and together, from one stored ledger of ``documents``."""
    return rules.ablations(_table(spark, sf_dir, "documents"))


def op3_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_aligned_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.dedup_substrings(_table(spark, sf_dir, "documents"), 50)


def op6_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_rank_merging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), 4096)


def op8_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), 5, 75)


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 1024)


def op10_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.resolve_revisits(warc.recrawl(_table(spark, sf_dir, "pages"))).where("kind = 'revisit'")
    return got.selectExpr(
        "(record_id - 1) div 2 as page_id", "url_key", "refers_to div 2 as refers_to_page", "resolution",
        "element_at(headers, 'etag') as etag", "element_at(headers, 'content-type') as content_type")


def op11_systolic_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"), 30)


def op12_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), 3, 85)


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_label_propagation, op2_rule_ledger, op3_attention_scores, op4_aligned_leaks, op5_relative_lz, op6_diagonal_voting,
    op7_rank_merging, op8_set_relation_join, op9_mixture_packing, op10_revisit_resolution, op11_systolic_divergence,
    op12_bbit_minhash, op13_impact_search, rule_ablations, pipeline)}
ORACLES: dict[str, str] = {
    "op2_rule_ledger": oracles.OP2, "rule_ablations": oracles.ablations(rules.POLICIES), "op5_relative_lz": oracles.OP5, "op8_set_relation_join": oracles.OP8, "op10_revisit_resolution": oracles.OP10,
    "op11_systolic_divergence": oracles.OP11, "op12_bbit_minhash": oracles.OP12, "op13_impact_search": oracles.OP13}
