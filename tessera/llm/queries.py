"""The registered queries of this subpackage, one for each operator, and their SQL twins."""

from __future__ import annotations

from . import decontaminate, divergence, filter_audit, html_text, license_scan, ngram_join, packing, perplexity, quality_rules, token_files, toxicity, url_filter, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_pack": packing.op2_pack,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_token_files": token_files.op4_token_files,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_perplexity": perplexity.op7_perplexity,
    "op8_html_text": html_text.op8_html_text,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_warc": warc.op12_warc,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {
    "op5_license_scan": license_scan.sql(),
    "op9_quality_rules": quality_rules.SQL,
    "op10_decontaminate": decontaminate.SQL,
    "op11_source_divergence": divergence.SQL,
    "op12_warc": warc.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
