"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from . import decontaminate, filter_audit, jaccard, mixing, phrases, pii, repeats, token_counts, token_files, topk, toxicity, url_filters, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_warc": warc.op3_warc,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_pivot_topk": topk.op6_pivot_topk,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_personal_data": pii.op9_personal_data,
    "op10_token_files": token_files.op10_token_files,
    "op11_phrases": phrases.op11_phrases,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_remove_repeats": repeats.op13_remove_repeats,
}

ORACLE: dict[str, str] = {
    "op2_jaccard_join": jaccard.OP2_SQL,
    "op3_warc": warc.OP3_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op6_pivot_topk": topk.OP6_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op8_url_filters": url_filters.OP8_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
