"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, html_extract, line_dedup, quality, simhash, substring_dedup, suffix_dedup, url_filter


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_bpe": bpe.op3_bpe,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_html_extract": html_extract.op6_html_extract,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_quality": quality.op8_quality,
        "op9_simhash": simhash.op9_simhash,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.SQL,
        "op4_exact_dedup": exact_dedup.SQL,
        "op5_url_filter": url_filter.SQL,
        "op7_line_dedup": line_dedup.SQL,
    }
