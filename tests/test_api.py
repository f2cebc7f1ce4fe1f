import os

import pytest

from proofloom.plans.api import Engine, parse_lenses
from proofloom.reports import render
from proofloom.streaming import rollup

TINY = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(TINY), reason="no test tables")


def test_lens_names():
    assert parse_lenses("neighbours, trust,trust") == ["neighbors", "trust"]
    assert parse_lenses("trust,all")[0] == "trust" and len(parse_lenses("all")) == 5
    with pytest.raises(ValueError):
        parse_lenses("beauty")


def test_csv_quoting():
    assert [render.csv_value(v) for v in ("a", "a,b", 'a"b', "a\nb", None, True, 3)] == ["a", '"a,b"', '"a""b"', '"a\nb"', "", "true", "3"]
    assert render.names([str(i) for i in range(14)]) == "0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11 (+2 more)"
    assert render.path(["A", "B"], ["proof"]) == "A\n  -[proof]-> B\n" and render.path([], []) == "no path\n"


@needs_data
def test_commands(spark, tmp_path):
    engine = Engine(spark, TINY, limit=5)
    assert engine.summary().first().declarations > 0
    name = engine._graph[1].join(engine._graph[0], engine._graph[1]["src"] == engine._graph[0]["id"]).first().name
    direct = engine.dependencies(name).collect()
    assert direct and all(r.source == name for r in direct)
    reached = engine.dependencies(name, transitive=True).collect()
    assert reached and engine.path(name, reached[0].name).first().nodes[0] == name
    assert engine.shared_dependencies([name, name]).count() == min(5, len({r.target for r in engine.dependencies(name).collect()}))
    with pytest.raises(KeyError):
        engine.path(name, "no such name")
    with pytest.raises(ValueError):
        engine.export("pictures")
    listed = engine.emit(engine.rank("axioms"), "text", "Axioms")
    assert listed.startswith("Axioms\n") and len(listed.splitlines()) == 7
    assert len(engine.emit(engine.export("modules"), "csv", export=True).splitlines()) == 1 + engine.modules().count() > engine.limit
    assert engine.discover("neighbors")["neighbors"].select("query").distinct().count() == 5
    with pytest.raises(ValueError):
        engine.emit(engine.modules(), "csv")
    assert engine.emit(engine.symbol(name), "json").startswith('{"name":')
    render.write_csv(engine.export("nodes"), f"file://{tmp_path}/nodes")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/nodes").count() == engine.export("nodes").count()


@needs_data
def test_streamed_rollup_equals_the_batch(spark, tmp_path):
    source = spark.read.parquet(f"{TINY}/dependency_edges.parquet")
    source.repartition(3).write.parquet(f"file://{tmp_path}/in")
    query = rollup.start(rollup.rollup(rollup.read_edges(spark, f"file://{tmp_path}/in", source.schema)), f"file://{tmp_path}/state", f"file://{tmp_path}/out")
    query.awaitTermination(180)
    got = {(r.source_module, r.target_module, r.layer): r.occurrences for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    once = source.where("target is not null").dropDuplicates(["source_id", "target", "layer"]).fillna("<unknown>", ["source_module", "target_module"])
    want = {(r.source_module, r.target_module, r.layer): r["sum(occurrences)"] for r in once.groupBy("source_module", "target_module", "layer").sum("occurrences").collect()}
    assert got == want
