"""Queries of the llm operators and their SQL, for the registry."""

from __future__ import annotations

from . import decontamination, license_scan, line_dedup, packing, ppm_scoring, quality_rules, simhash_dedup, spelling_variants, substring_dedup, token_store, toxicity, url_filter, vector_codes

QUERIES = {
    "op1_token_store": token_store.op1_token_store,
    "op2_simhash_dedup": simhash_dedup.op2_simhash_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_ppm_scoring": ppm_scoring.op5_ppm_scoring,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_packing": packing.op8_packing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLES = {
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op9_line_dedup": line_dedup.ORACLE_SQL,
    "op10_substring_dedup": substring_dedup.ORACLE_SQL,
    "op11_spelling_variants": spelling_variants.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
}
