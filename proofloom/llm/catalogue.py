"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from proofloom.llm import q_overlap, q_terms, q_text

MODULES = [q_terms, q_overlap, q_text]


def queries() -> dict:
    return {n: f for m in MODULES for n, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for m in MODULES for n, s in m.SQL.items()}
