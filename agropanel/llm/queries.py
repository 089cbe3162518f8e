"""Queries over whole tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from agropanel.llm import (
    decontaminate, factors, fill_middle, importance, line_quality, mixing, phrases, private_data, simhash, suffixes, tokens, toxicity, warc,
)

QUERIES = {
    "op1_private_data": private_data.op1_private_data,
    "op2_phrase_fingerprints": phrases.op2_phrase_fingerprints,
    "op3_simhash_groups": simhash.op3_simhash_groups,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_lempel_ziv": factors.op5_lempel_ziv,
    "op6_line_quality": line_quality.op6_line_quality,
    "op7_benchmark_hits": decontaminate.op7_benchmark_hits,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_warc_roundtrip": warc.op9_warc_roundtrip,
    "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    "op11_token_counts": tokens.op11_token_counts,
    "op12_importance_draw": importance.op12_importance_draw,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

ORACLE_SQL = {
    "op5_lempel_ziv": factors.ORACLE,
    "op7_benchmark_hits": decontaminate.ORACLE,
    "op9_warc_roundtrip": warc.ORACLE,
    "op10_suffix_dedup": suffixes.ORACLE,
    "op12_importance_draw": importance.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}
