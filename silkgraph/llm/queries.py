"""Queries of the pipeline operators and their SQL counterparts."""

from __future__ import annotations

from silkgraph.llm import decontaminate, jaccard_join, language_id, license_scan, packing, preference, quality_classifier, quality_rules, substring, warc

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_chat_formatting": preference.op2_chat_formatting,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_warc": warc.op4_warc,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_language_id": language_id.op6_language_id,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_ngram_jaccard_join": jaccard_join.op10_ngram_jaccard_join,
}

#: Queries that SQL can't express (suffix arrays, filters, index votes) are tested against brute force instead.
ORACLES = {
    "op2_chat_formatting": preference.ORACLE,
    "op3_benchmark_decontamination": decontaminate.ORACLE,
    "op4_warc": warc.ORACLE,
    "op7_substring_dedup": substring.ORACLE,
    "op10_ngram_jaccard_join": jaccard_join.ORACLE,
}
