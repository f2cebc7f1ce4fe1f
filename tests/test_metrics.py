import json

import pytest

from proofloom.operators import metrics
from proofloom.operators.filters import AnalysisFilter
from proofloom.sources import snapshot


def test_distribution(spark):
    df = spark.createDataFrame([("odd", x) for x in (1, 9, 3)] + [("even", x) for x in (1, 3, 5, 7)] + [("two", x) for x in (0, 10)] + [("none", None)], "g string, x bigint")
    got = {r.g: r for r in metrics.distribution(df, ["g"], "x").collect()}
    assert got["odd"].p50 == 3 and got["even"].p50 == 4 and got["two"].p75 == 7.5
    assert got["none"]["count"] == 0 and got["none"].p50 is None
    assert metrics.distribution(df.limit(0), ["g"], "x").count() == 0


def test_histogram_has_every_bucket(spark):
    df = spark.createDataFrame([("a", x) for x in (0, 1, 2, 10, None)] + [("b", 7)], "g string, x bigint")
    got = metrics.histogram(df, "g", "x", (5, 1, 5)).collect()
    assert [r["count"] for r in sorted((r for r in got if r.g == "a"), key=lambda r: (r.lower is not None, r.lower))] == [1, 2, 1]
    assert sorted(r["count"] for r in got if r.g == "b") == [0, 0, 1]


def corpus(spark):
    d = [(0, "A", "theorem", None, False), (1, "B", "theorem", None, False), (2, "C", "theorem", "recursor", True)]
    declarations = spark.createDataFrame(d, "decl_id bigint, name string, kind string, generation_kind string, hidden boolean")
    e = [(i, s, t, "statement", 1, True, False, False) for i, s, t in ((0, "A", "B"), (1, "B", "A"), (2, "C", "B"))]
    edges = spark.createDataFrame(e, "source_id bigint, source string, target string, layer string, occurrences bigint, target_in_corpus boolean, target_hidden boolean, target_infrastructure boolean")
    return declarations, edges


def test_filters(spark):
    declarations, edges = corpus(spark)
    assert AnalysisFilter().declarations(declarations).count() == 2
    assert AnalysisFilter.all().declarations(declarations).count() == 3
    assert {r.source for r in AnalysisFilter.all().edges(edges, declarations).where("target = 'B'").collect()} == {"A", "C"}
    assert {r.source for r in AnalysisFilter().edges(edges, declarations).where("target = 'B'").collect()} == {"A"}
    assert AnalysisFilter(layer="proof").edges(edges, declarations).count() == 0
    with pytest.raises(ValueError):
        AnalysisFilter(layer="both")


def test_rank_rejects_unknown_metrics(spark):
    declarations, edges = corpus(spark)
    with pytest.raises(ValueError, match="unknown metric"):
        metrics.rank(declarations, edges, edges, "proof-beauty", 3)
    got = metrics.rank(declarations, edges, edges, "statement-dependencies", 2).collect()
    assert [(r["rank"], r.name, r.value) for r in got] == [(1, "A", 1), (2, "B", 1)]


def document(names, version=6):
    graph = {"root": 0, "nodes": [{"id": 0, "kind": "constant", "children": [], "name": "X", "universeLevels": []}]}
    d = [{"name": n, "kind": "theorem", "hasValue": False, "typeGraph": graph, "statementDependencies": ["X"]} for n in names]
    return {"schemaVersion": version, "leanVersion": "4", "importedModules": ["M"], "declarations": d, "symbols": [{"name": "X", "kind": "axiom"}]}


def test_snapshots(spark, tmp_path):
    for n, doc in (("a", document(["P", "Q"])), ("b", document(["R"])), ("old", document(["P"], 5))):
        (tmp_path / f"{n}.json").write_text(json.dumps(doc, indent=1))
    path = lambda n: f"file://{tmp_path}/{n}.json"
    first = snapshot.load_snapshots(spark, [path("a"), path("a")])
    assert [(r.decl_id, r.name) for r in snapshot.declarations(first).orderBy("decl_id").collect()] == [(0, "P"), (1, "Q")]
    assert snapshot.graphs(first).select("layer").distinct().collect()[0].layer == "statement"
    with pytest.raises(ValueError, match="version"):
        snapshot.load_snapshots(spark, [path("old")])
    with pytest.raises(ValueError):
        snapshot.load_snapshots(spark, [" "])
    names = lambda n: snapshot.declarations(snapshot.load_snapshots(spark, [path(n)])).select("decl_id", "name", "kind")
    assert [r.decl_id for r in snapshot.merge_declarations([names("a"), names("b")]).orderBy("name").collect()] == [0, 1, 2]
    with pytest.raises(ValueError, match="occurs twice"):
        snapshot.merge_declarations([names("a"), names("a")])
    merged = snapshot.merge_symbols([spark.createDataFrame([("X", "axiom")], "name string, kind string"), spark.createDataFrame([("X", "other"), ("Y", "z"), (None, "n")], "name string, kind string")])
    assert {(r.name, r.kind, r.snapshot) for r in merged.collect()} == {("X", "axiom", 0), ("Y", "z", 1)}
