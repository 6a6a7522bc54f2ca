"""Queries of this subpackage by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from vettra.llm import decontamination, html_extraction, language_id, license_scan, line_dedup, merkle_manifest, periodic_runs, sentencepiece_codec, sharding, simhash_dedup, token_records, topk_search, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_sharding": sharding.op3_sharding,
    "op4_simhash_dedup": simhash_dedup.op4_simhash_dedup,
    "op5_topk_search": topk_search.op5_topk_search,
    "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_token_records": token_records.op8_token_records,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_language_id": language_id.op10_language_id,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_html_extraction": html_extraction.op12_html_extraction,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op2_decontamination": decontamination.ORACLE_SQL,
    "op3_sharding": sharding.ORACLE_SQL,
    "op5_topk_search": topk_search.ORACLE_SQL,
    "op9_license_scan": license_scan.oracle_sql(),
    "op11_merkle_manifest": merkle_manifest.oracle_sql(),
    "op12_html_extraction": html_extraction.ORACLE_SQL,
    "op13_periodic_runs": periodic_runs.ORACLE_SQL,
}
