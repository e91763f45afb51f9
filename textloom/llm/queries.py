"""The llm subpackage's queries and their oracle SQL."""

from __future__ import annotations

from textloom.llm import decontaminate, exact_dedup, html_extract, language_id, license_scan, minhash_dedup, packing, suffix_dedup, url_filter, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_minhash_dedup": minhash_dedup.op4_minhash_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_packing": packing.op6_packing,
    "op7_language_id": language_id.op7_language_id,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_warc": warc.op9_warc,
    "op10_html_extract": html_extract.op10_html_extract,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_license_scan": license_scan.ORACLE,
    "op4_minhash_dedup": minhash_dedup.ORACLE,
    "op8_suffix_dedup": suffix_dedup.ORACLE,
    "op9_warc": warc.ORACLE,
}
