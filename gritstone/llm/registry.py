"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from gritstone.llm import decontaminate, fill_middle, html_main, language_id, license_scan, near_dedup, packing, secret_scan, sharding, sql, token_counts, url_filter, vector_codes, vector_dedup

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_language_id": language_id.op3_language_id,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_sharding": sharding.op6_sharding,
    "op7_html_main": html_main.op7_html_main,
    "op8_packing": packing.op8_packing,
    "op9_vector_dedup": vector_dedup.op9_vector_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_token_counts": token_counts.op13_token_counts,
}
ORACLES = {
    "op2_url_filter": url_filter.ORACLE,
    "op4_near_dedup": sql.NEAR_DEDUP,
    "op9_vector_dedup": sql.VECTOR_DEDUP,
    "op10_decontaminate": sql.DECONTAMINATE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
}
