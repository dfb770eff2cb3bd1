"""Queries of the corpus operators and the SQL that they are checked against."""

from __future__ import annotations

from tessera.llm import (
    bpe,
    conversations,
    exact_dedup,
    line_templates,
    mixing,
    phrases,
    pii,
    quality,
    simhash,
    token_counts,
    token_files,
    url_filter,
    vector_dedup,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_quality": quality.op3_quality,
    "op4_line_templates": line_templates.op4_line_templates,
    "op5_pii": pii.op5_pii,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_bpe": bpe.op7_bpe,
    "op8_vectors": vector_dedup.op8_vectors,
    "op9_simhash": simhash.op9_simhash,
    "op10_token_files": token_files.op10_token_files,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_collocations": phrases.op12_collocations,
    "op13_conversations": conversations.op13_conversations,
}

#: Queries that SQL cannot express are tested against brute force instead.
SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op4_line_templates": line_templates.OP4_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op12_collocations": phrases.OP12_SQL,
}
