"""Structure queries read propositions and context types, of proof_outlines and of raw_outlines."""

import json

import pytest

from proofloom.plans import q_structure

NODE = "struct<id: bigint, kind: string, children: array<bigint>, name: string, var_index: bigint, value_text: string, binder_info: string, universe_levels: array<string>>"
GRAPH = f"struct<root: bigint, nodes: array<{NODE}>>"
CTX = f"struct<id: string, user_name: string, kind: string, binder_info: string, type_text: string, type_graph: {GRAPH}, value_text: string>"
STEP = f"struct<id: bigint, kind: string, proposition: string, proposition_graph: {GRAPH}, context: array<{CTX}>, scope: array<string>, proof_term_path: string, prerequisite_steps: array<bigint>, hypothesis_references: array<string>, named_references: array<string>>"
OUTLINES = f"outline_id bigint, decl_id bigint, declaration string, complete boolean, truncation_reason string, visited_terms bigint, conclusion_step bigint, candidate_node_count bigint, raw_steps array<{STEP}>, received_at timestamp"


def pair(kind, name, bad=False):
    """A node of ``kind`` over four constants, and ``bad``: a child before it is missing."""
    leaves = [(i, "constant", [], f"{name}{i}", None, None, None, None) for i in range(4)]
    return (4, [*leaves, (4, kind, [0, 1, 2, 9 if bad else 3], None, None, None, None, None)])


@pytest.fixture(scope="module")
def directory(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("outlines"))
    from datetime import datetime

    at = datetime(2026, 1, 1)
    step = (1, "conclusion", "p", pair("application", "p"), [("h", "h", None, None, "t", pair("application", "t"), None), ("h", "h", None, None, "t", pair("application", "t"), None), (None, "i", None, None, None, pair("lambda", "i"), None), ("g", "g", None, None, None, pair("let", "g", True), None)], None, None, None, None, None)
    spark.createDataFrame([(1, 10, "A", True, None, 0, 1, 0, [step, step, None], at), (1, 10, "A", True, None, 0, 1, 0, [step], at)], OUTLINES).write.parquet(f"{d}/proof_outlines.parquet")
    keys = ("id", "kind", "children", "name")
    graph = lambda g: {"root": g[0], "nodes": [dict(zip(keys, n)) for n in g[1]]}
    payload = {"rawSteps": [{"id": 1, "propositionGraph": graph(pair("application", "p")), "context": [{"id": "k", "typeGraph": graph(pair("application", "t"))}]}]}
    raw = [(2, 20, json.dumps(payload), at), (2, 20, json.dumps(payload)[:50], at), (3, 30, json.dumps(payload), at)]
    spark.createDataFrame(raw, "outline_id bigint, decl_id bigint, payload string, received_at timestamp").write.parquet(f"{d}/raw_outlines.parquet")
    spark.createDataFrame([(10, "A", at), (20, "B", at)], "decl_id bigint, name string, received_at timestamp").write.parquet(f"{d}/declarations.parquet")
    return d


def test_both_graphs_of_both_tables_count(spark, directory):
    kinds = {r.kind: r.unique_nodes for r in q_structure.kind_proportions(spark, directory).collect()}
    assert kinds == {"application": 6, "lambda": 1, "let": 1, "constant": 32}
    for query in (q_structure.duplicates_exact, q_structure.duplicates_alpha, q_structure.repeated_structures):
        assert sorted((r.declarations, r.occurrences) for r in query(spark, directory).collect()) == [(3, 3), (3, 3)]
    held = {r.declaration: (r.groups, r.largest) for r in q_structure.repeated_for_declaration(spark, directory).collect()}
    assert held == {"A": (2, 5), "B": (2, 5), "outline:3": (2, 5)}


def test_sizes_and_violations_name_the_entry(spark, directory):
    sizes = {(r.outline_id, r.step_id, r.context_id, r.unique_nodes, r.occurrences, r.depth) for r in q_structure.expression_sizes(spark, directory).collect()}
    assert sizes == {(1, 1, None, 5, 5, 2), (1, 1, "h", 5, 5, 2), (1, 1, "g", 5, 4, 2), (2, 1, None, 5, 5, 2), (2, 1, "k", 5, 5, 2), (3, 1, None, 5, 5, 2), (3, 1, "k", 5, 5, 2)}
    assert [(r.rule, r.subject) for r in q_structure.validation_graphs(spark, directory).collect()] == [("child does not precede its node", "1/1/g")]


def test_snapshot_comparison_has_all_parts(spark, tmp_path):
    from proofloom.sources import snapshot

    def graph(binder, more=False):
        nodes = [{"id": 0, "kind": "constant", "children": [], "name": "T"}, {"id": 1, "kind": "application", "children": [0, 0]}, {"id": 2, "kind": "lambda", "children": [1], "name": binder, "universeLevels": []}]
        return {"root": 3 if more else 2, "nodes": nodes + [{"id": 3, "kind": "application", "children": [2, 0]}] * more}

    made = [("a", graph("x"), ["p", "q"]), ("b", graph("y"), ["q", "p"]), ("c", graph("x", True), ["q"]), ("d", None, ["q"])]
    document = {"schemaVersion": 6, "importedModules": ["M"], "symbols": [], "declarations": [{"name": n, "kind": "theorem", "typeGraph": g, "statementDependencies": deps} for n, g, deps in made]}
    (tmp_path / "s.json").write_text(json.dumps(document))
    pairs = spark.createDataFrame([("a", x, "statement") for x in "abcd"], "left_name string, right_name string, layer string")
    got = {r.right_name: tuple(r)[3:10] for r in snapshot.compare(snapshot.load_snapshots(spark, [str(tmp_path / "s.json")]), pairs).collect()}
    cosine = 4 / (3 * 6) ** 0.5
    assert got == {"a": (True, True, 1, 1, 1, 1, 1), "b": (False, True, 1, 1, 1, 1, 1), "c": (False, False, 1, round(cosine, 6), 0.75, 0.75, round((2.5 + cosine) / 4, 6))}
