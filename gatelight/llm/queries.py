"""Queries and SQL of the corpus operators, for the driver entry."""

from __future__ import annotations

from . import divergence, language_id, licenses, line_dedup, mixing, near_dedup, packing, quality, runs, sharding, substring_dedup, token_counts, topk


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_quality_rules": quality.op2_quality_rules,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_packing": packing.op5_packing,
        "op6_sharding": sharding.op6_sharding,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_topk": topk.op8_topk,
        "op9_mixing": mixing.op9_mixing,
        "op10_language_id": language_id.op10_language_id,
        "op11_license_scans": licenses.op11_license_scans,
        "op12_source_divergence": divergence.op12_source_divergence,
        "op13_periodic_runs": runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.SQL,
        "op4_near_dedup": near_dedup.SQL,
        "op7_substring_dedup": substring_dedup.SQL,
        "op8_topk": topk.SQL,
        "op9_mixing": mixing.SQL,
        "op11_license_scans": licenses.SQL,
        "op12_source_divergence": divergence.SQL,
        "op13_periodic_runs": runs.SQL,
    }
