"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprints, licenses, line_dedup, mixing, near_dedup, packing, prefix_trie, quality_rules, secrets, structure_repair, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1,
    "op2_ngram_jaccard": near_dedup.op2,
    "op3_substring_dedup": substring_dedup.op3,
    "op4_line_dedup": line_dedup.op4,
    "op5_packing": packing.op5,
    "op6_toxicity": toxicity.op6,
    "op7_mixing": mixing.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_exact_dedup": exact_dedup.op9,
    "op10_secret_scan": secrets.op10,
    "op11_prefix_trie": prefix_trie.op11,
    "op12_structure_repair": structure_repair.op12,
    "op13_edit_fingerprint": fingerprints.op13,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.oracle_sql(),
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op7_mixing": mixing.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_structure_repair": structure_repair.ORACLE_SQL,
}
