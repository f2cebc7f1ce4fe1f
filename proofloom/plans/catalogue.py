"""All queries of the core library and their SQL."""

from __future__ import annotations

from proofloom.plans import core_p, core_p_sql, q_graph, q_metrics, q_structure

MODULES = [q_metrics, q_graph, q_structure]


def queries() -> dict:
    return core_p.QUERIES | {n: f for m in MODULES for n, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return core_p_sql.SQL | {n: s for m in MODULES for n, s in m.SQL.items()}
