"""Queries of the text operators and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reachspark.llm import decontaminate, hard_negatives, language_id, line_dedup, main_text, near_dedup, quality_rules, source_mix, substring_dedup, token_counts, toxicity, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_divergence": quality_rules.query,
    "op2_source_mix": source_mix.query,
    "op3_line_dedup": line_dedup.query,
    "op4_main_text_cut": main_text.query,
    "op5_probminhash_near_dedup": near_dedup.query,
    "op6_prefix_decontamination": decontaminate.query,
    "op7_warc_chain": warc.query,
    "op8_trie_token_counts": token_counts.query,
    "op9_rank_order_language": language_id.query,
    "op10_induced_substring_dedup": substring_dedup.query,
    "op11_noisy_or_toxicity": toxicity.query,
    "op12_charpoly_whitening": whitening.query,
    "op13_lemp_hard_negatives": hard_negatives.query,
}
SQL: dict[str, str] = {"op1_quality_divergence": quality_rules.SQL, "op2_source_mix": source_mix.SQL, "op3_line_dedup": line_dedup.SQL, "op13_lemp_hard_negatives": hard_negatives.SQL}
