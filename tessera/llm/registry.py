"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import decontamination, exact_dedup, html_text, packing, quality, secret_scan, simhash, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_html_text": html_text.op2_html_text,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_packing": packing.op4_packing,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_simhash": simhash.op6_simhash,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_quality": quality.op10_quality,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
}
