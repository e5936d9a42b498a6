"""The queries of this subpackage, and their DuckDB twins."""

from __future__ import annotations

from loomgraph.llm import (
    q_chat_tree,
    q_exact_dedup,
    q_html_extract,
    q_importance,
    q_language_id,
    q_line_dedup,
    q_mixing,
    q_ngram_join,
    q_packing,
    q_simhash,
    q_toxicity,
    q_url_filter,
    q_whitening,
)

MODULES = [q_toxicity, q_packing, q_chat_tree, q_mixing, q_html_extract, q_line_dedup, q_exact_dedup, q_simhash, q_language_id, q_ngram_join, q_importance, q_url_filter, q_whitening]


def queries():
    return {m.NAME: m.query for m in MODULES}


def oracle_sql():
    return {m.NAME: m.ORACLE for m in MODULES if getattr(m, "ORACLE", None)}
