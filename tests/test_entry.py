"""The driver contract, and results against SQL on the smallest tables."""

import ast
import glob
import importlib
import math
import os
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TINY = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(TINY), reason="no test tables")
QUICK = [
    "module_rollup", "declarations_filtered", "symbols_filtered", "edges_internal_proof", "corpus_summary", "breakdown", "size_distribution", "size_histogram", "declaration_metrics", "rank_axioms", "search", "trust",
    "export_edges", "degrees", "compare_declarations", "grouped_edges", "proof_closure", "outline_rarity", "p2_targets", "p2_flags", "p2_found", "p3_found", "p3_contexts",
]


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source_module", "target_module", "layer", "occurrences"] and df.count() > 0


def test_sql_has_a_query_each():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_subpackage():
    for path in glob.glob(f"{ROOT}/proofloom/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            for node in ast.walk(ast.parse(open(path).read())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("proofloom.llm") for n in names), path


def test_entry_without_the_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("proofloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "proofloom.llm", None)
    try:
        alone = importlib.reload(entry)
        assert "module_rollup" in alone.queries() and "p2_found" in alone.queries() and "p6_ids" not in alone.queries()
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{TINY}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, TINY)
    want = duck.sql(entry.oracle_sql()[name]).df()
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    number = lambda x: float(x) if isinstance(x, int) and not isinstance(x, bool) else x
    got = sorted((tuple(number(plain(r[c])) for c in columns) for r in df.collect()), key=repr)
    frame = want[columns].astype(object).where(want[columns].notna(), None)
    rows = sorted((tuple(number(plain(v.item() if hasattr(v, "item") else v)) for v in r) for r in frame.itertuples(index=False)), key=repr)
    assert got == rows
