"""The operators as queries of (spark, folder of tables), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.llm import (
    ann, filter_audit, line_dedup, mixing, packing, pivot_search, quality, simhash, substring_dedup, toxicity, url_rules, warc, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": warc.op1_warc_revisits,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_simhash_groups": simhash.op4_simhash_groups,
    "op5_packing": packing.op5_packing,
    "op6_learned_partitions": ann.op6_learned_partitions,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_line_windows": line_dedup.op10_line_windows,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_pivot_search": pivot_search.op12_pivot_search,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES: dict[str, str] = {
    "op1_warc_revisits": warc.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op8_quality_rules": quality.oracle_sql(),
    "op9_url_rules": url_rules.oracle_sql(),
    "op10_line_windows": line_dedup.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_pivot_search": pivot_search.ORACLE,
}
