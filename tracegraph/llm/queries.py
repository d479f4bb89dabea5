"""The corpus operators' queries by name, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

from tracegraph.llm import ann, embedding_dedup, filter_audit, fim, jaccard, langid, mixing, packing, rollup, suffix, toxicity, url_filter, warc

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_embedding_dedup": embedding_dedup.op2,
    "op3_token_counts": rollup.op3,
    "op4_mixing": mixing.op4,
    "op5_suffix_dedup": suffix.op5,
    "op6_warc": warc.op6,
    "op7_language_id": langid.op7,
    "op8_packing": packing.op8,
    "op9_ann": ann.op9,
    "op10_jaccard": jaccard.op10,
    "op11_filter_audit": filter_audit.op11,
    "op12_url_filter": url_filter.op12,
    "op13_fill_in_middle": fim.op13,
    "token_counts_by_pattern": rollup.by_pattern,
}

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": embedding_dedup.SQL,
    "op6_warc": warc.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_url_filter": url_filter.SQL,
    "op13_fill_in_middle": fim.SQL,
    "token_counts_by_pattern": rollup.SQL,
}
