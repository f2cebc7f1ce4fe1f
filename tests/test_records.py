"""Expression graphs and proof steps, record by record."""

import pytest

from proofloom.functions import dag
from proofloom.operators import proof, structure, validate


def node(i, kind, children=(), name=None, binder=None):
    return {"id": i, "kind": kind, "children": list(children), "name": name, "var_index": None, "value_text": None, "binder_info": binder, "universe_levels": []}


def test_multiplicities_of_a_shared_graph():
    rows = {r["node_id"]: r for r in dag.analyse(2, [node(0, "constant", name="x"), node(1, "application", [0, 0]), node(2, "application", [1, 0])])}
    assert [rows[i]["multiplicity"] for i in range(3)] == [3, 1, 1]
    assert rows[2]["size"] == 5 and rows[2]["depth"] == 3


def test_alpha_ignores_binder_names_only():
    def root(name, kind):
        return next(r for r in dag.analyse(1, [node(0, "constant", name="T"), node(1, kind, [0], name)]) if r["is_root"])

    a, b = root("x", "forall"), root("y", "forall")
    assert a["exact"] != b["exact"] and a["alpha"] == b["alpha"]
    assert root("x", "constant")["alpha"] != root("y", "constant")["alpha"]


def test_dirty_graphs():
    assert dag.analyse(None, None) == [] and dag.analyse(3, []) == []
    rows = dag.analyse(0, [node(0, "a", [1, 7, 1]), None, node(1, "b", [0]), node(0, "again")])
    assert {r["node_id"]: r["size"] for r in rows} == {0: 3, 1: 1}
    deep = dag.analyse(200, [node(i, "n", [i - 1, i - 1] if i else []) for i in range(201)])
    assert max(r["size"] for r in deep) == dag.CAP
    chain = dag.analyse(5000, [node(i, "n", [i - 1] if i else []) for i in range(5001)])
    assert max(r["depth"] for r in chain) == 5001


def test_render_and_label():
    nodes = [node(0, "constant", name="x"), node(1, "application", [0, 0])]
    assert dag.render(1, nodes, 2) == "application\n  constant x\n  constant x"
    assert dag.render(1, nodes, 1) == "application\n  …\n  …"
    assert dag.label({**node(0, "sort"), "universe_levels": ["u", "v"], "var_index": 2}) == "sort #2 levels=u,v"


def test_duplicates_and_repeats(spark):
    schema = "declaration string, root bigint, nodes array<struct<id:bigint,kind:string,children:array<bigint>,name:string,var_index:bigint,value_text:string,binder_info:string,universe_levels:array<string>>>"
    graph = lambda b: [node(0, "constant", name="T"), node(1, "application", [0, 0]), node(2, "application", [1, 0]), node(3, "lambda", [2], b)]
    df = spark.createDataFrame([("p", 3, graph("x")), ("q", 3, graph("x")), ("r", 3, graph("y")), ("s", None, None)], schema)
    rows = dag.node_rows(df, ["declaration"])
    assert [(r.declarations, r.first_declaration) for r in structure.duplicates(rows).collect()] == [(2, "p")]
    assert [r.declarations for r in structure.duplicates(rows, "alpha").collect()] == [3]
    assert sorted((r.size, r.declarations) for r in structure.repeated(rows).collect()) == [(5, 3), (6, 2)]
    assert {(r.declaration) for r in structure.members(rows, structure.duplicates(rows)).collect()} == {"p", "q"}


def step(i, kind="anonymousApplication", before=(), names=()):
    return {"id": i, "kind": kind, "proposition": f"P{i}", "prerequisite_steps": list(before), "named_references": list(names)}


def test_closure_and_paths():
    steps = [step(0), step(1, before=[0]), step(2, "conclusion", [0, 1])]
    _, before, after = proof._graph(steps)
    assert after[0] == [1, 2] and proof.closure(before)[2] == {0, 1}
    assert proof.paths_to(after, 0, 2) == ([[0, 1, 2], [0, 2]], False)
    assert proof.paths_to(after, 0, 2, 1) == ([[0, 1, 2]], True)


def test_outline_keeps_the_landmarks():
    steps = [step(0, "namedApplication", names=["Foo.bar"]), step(1, before=[0]), step(2, "localFact", [1]), step(3, "branchConclusion", [2]), step(4, "conclusion", [3]), step(5, "localFact")]
    made = proof.outline(steps, 4)
    assert made["nodes"] == [0, 2, 3, 4]
    assert made["edges"] == [(0, 2, 1, 3, [0, 1, 2]), (2, 3, 1, 2, [2, 3]), (3, 4, 1, 2, [3, 4])]


def test_branches_are_counted_without_listing_them():
    steps = [step(0, "localFact"), step(1, before=[0]), step(2, before=[0]), step(3, before=[1, 2]), step(4, "conclusion", [3])]
    assert [e[:4] for e in proof.outline(steps, 4)["edges"]] == [(0, 4, 2, 4)]


def test_large_and_partial_outlines():
    steps = [step(i, "namedApplication", [i - 1] if i else [], [f"Lemma.l{i}"]) for i in range(300)] + [step(300, "conclusion", [299])]
    made = proof.outline(steps, 300)
    assert made["candidates"] == 301 and len(made["nodes"]) == 240 and 300 in made["nodes"]
    assert proof.outline([], None) is None and proof.outline(None, 3) is None
    assert proof.outline_node_rows(None, None) == []


def test_meaningful_references(spark):
    names = ["instFoo", "A.toB", "A.match_1", "id", "Nat.add_comm"]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", proof.meaningful(F.col("n")).alias("m"))
    assert [r.n for r in df.where("m").collect()] == ["Nat.add_comm"] == [n for n in names if proof._telling(n)]


def test_graph_shape_rules(spark):
    schema = "graph string, root bigint, nodes array<struct<id:bigint,children:array<bigint>>>"
    good = [{"id": 0, "children": []}, {"id": 1, "children": [0]}]
    df = spark.createDataFrame([("good", 1, good), ("empty", 0, []), ("root", 2, good), ("ids", 0, [{"id": 1, "children": None}]), ("child", 0, [{"id": 0, "children": [0]}])], schema)
    assert {(r.subject, r.rule) for r in validate.graph_shape(df, "graph").collect()} == {
        ("empty", "graph is empty"), ("root", "root out of bounds"), ("ids", "id differs from position"), ("child", "child does not precede its node")
    }
    validate.require(validate.graph_shape(df.where("graph = 'good'"), "graph"))
    with pytest.raises(ValueError, match="root out of bounds"):
        validate.require(validate.graph_shape(df.where("graph = 'root'"), "graph"))
