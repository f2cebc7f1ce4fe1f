import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofloom.operators.nested import conform, flatten, inline_schema, prune

GRAPH = "struct<root:bigint,nodes:array<struct<id:bigint,children:array<bigint>>>>"
RECORD = f"key bigint, info struct<lang:string,size:bigint>, main {GRAPH.replace('struct<root', 'struct<root')}, parts array<struct<id:string,own_graph:{GRAPH},tags:array<string>>>"


def schema(text):
    return T._parse_datatype_string(text)


def test_shared_and_repeated_types_become_tables(spark):
    tables = inline_schema(schema(RECORD.replace("main", "main_graph")), "record", ["key"])
    assert tables["record"].columns == {"key": "key", "info_lang": "info.lang", "info_size": "info.size"}
    assert {t: v.parent for t, v in tables.items()} == {"record": None, "graph": "record", "nodes": "graph", "children": "nodes", "parts": "record", "tags": "parts"}
    assert len(tables["graph"].occurrences) == 2 and len(tables["nodes"].occurrences) == 2


def test_rows_keep_their_parents(spark):
    s = schema("key bigint, parts array<struct<id:string,own_graph:" + GRAPH + ",tags:array<string>>>, main_graph " + GRAPH)
    graph = {"root": 1, "nodes": [{"id": 1, "children": [0, 9, 0, None]}, None, {"id": 0, "children": None}]}
    data = [(1, [{"id": "p", "own_graph": graph, "tags": ["x", None]}, None, {"id": "q", "own_graph": None, "tags": []}], {"root": 5, "nodes": []}), (2, None, None)]
    df = spark.createDataFrame(data, s)
    tables = inline_schema(s, "record", ["key"])
    parts = flatten(df, tables, "parts", ["key"]).collect()
    assert [(r.key, r.parts_pos, r.id) for r in parts] == [(1, 0, "p"), (1, 2, "q")]
    graphs = {(r.place, r.parts_pos, r.root) for r in flatten(df, tables, "graph", ["key"]).collect()}
    assert graphs == {("parts.own_graph", 0, 1), ("main_graph", None, 5)}
    links = flatten(df, tables, "children", ["key"], {"parts": "id", "nodes": "id"}, {"children": ("nodes", "id")}).collect()
    assert [(r.parts_id, r.nodes_id, r.children_pos, r.value, r.refers) for r in sorted(links, key=lambda r: r.children_pos)] == [
        ("p", 1, 0, 0, True), ("p", 1, 1, 9, False), ("p", 1, 2, 0, True), ("p", 1, 3, None, False)
    ]
    assert {r.value for r in flatten(df, tables, "tags", ["key"]).collect()} == {"x", None}
    assert flatten(df.limit(0), tables, "nodes", ["key"]).count() == 0


def test_json_is_brought_into_shape(spark):
    s = schema("raw_steps array<struct<id:bigint,type_text:string,hints:array<bigint>>>")
    texts = [
        '{"rawSteps":[{"id":"3","type":"a","hints":7,"more":{"x":1}}]}', '{"rawSteps":{"id":4,"hints":["1",2]}}', '{"rawSteps":null}', "{}", '{"rawSteps":[{"id":1', "", "  ", None, '{"a":1} x', "[1]",
        '{"rawSteps":[null,{"id":"x"}]}', '{"a":1},{"a":2}', json.dumps({"rawSteps": [{"id": 9, "type": "é" * 200_000}]}),
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.d for r in conform(df, "t", s, "d", {"type_text": "type"}).collect()}
    assert got[0].raw_steps[0].asDict() == {"id": 3, "type_text": "a", "hints": [7]}
    assert got[1].raw_steps[0].asDict() == {"id": 4, "type_text": None, "hints": [1, 2]}
    assert got[2].raw_steps is None and got[3].raw_steps is None
    assert [got[i] for i in (4, 5, 6, 7, 8, 11)] == [None] * 6
    assert got[10].raw_steps[0] is None and got[10].raw_steps[1].id is None
    assert len(got[12].raw_steps[0].type_text) == 200_000


def test_prune_keeps_only_what_is_named():
    s = schema("a array<struct<b:bigint,c:array<struct<d:string,e:string>>>>, f string")
    assert prune(s, ["a.c.d"]).simpleString() == "struct<a:array<struct<c:array<struct<d:string>>>>>"
    assert prune(s, ["a", "f"]) == s


def test_entries_with_clashing_names(spark):
    df = spark.createDataFrame([(1, [{"key": 5, "parts_pos": 6}])], "key bigint, parts array<struct<key:bigint,parts_pos:bigint>>")
    tables = inline_schema(df.schema, "record", ["key"])
    assert flatten(df, tables, "parts", ["key"]).count() == 1
    assert flatten(df, tables, "record", ["key"]).select(F.col("key")).first().key == 1


def test_repeated_keys_and_refused_texts_are_kept(spark):
    from pyspark.sql import types as T

    from proofloom.operators import nested

    schema = T.StructType.fromDDL("id bigint, tags array<string>, items array<struct<n: bigint, ok: boolean, w: double>>")
    texts = ['{"id": 1, "id": "2", "tags": "one", "items": {"n": "7", "ok": "true", "w": "x"}, "more": {"n": 1, "n": 2}}', '{"id": 3, "id": 4} x', '{"id": 5', "", " ", None, '{"id": 6, "tags": [1, null, {"a": 1}]}', '{"id": 1, "id": null, "tags": [], "items": [null, {"n": 1.0}]}', "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, payload string")
    made = nested.conform(df, "payload", schema, "doc")
    got = {r.k: r.doc.asDict(recursive=True) if r.doc else None for r in made.collect()}
    assert got[0] == {"id": 2, "tags": ["one"], "items": [{"n": 7, "ok": True, "w": None}]}
    assert got[6] == {"id": 6, "tags": ["1", None, '{"a":1}'], "items": None}
    assert got[7] == {"id": None, "tags": [], "items": [None, {"n": 1, "ok": None, "w": None}]}
    assert all(got[k] is None for k in (1, 2, 3, 4, 5))
    states = {r.state: r.texts for r in nested.states(made, "payload", "doc").collect()}
    assert states["null"] == 1 and states["blank"] == 2 and states["broken"] == 2 and sum(states.values()) == len(texts)


def test_a_text_too_large_for_the_parser(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from proofloom.operators import nested

    df = spark.range(1).select("id", F.concat(F.lit('{"id": 9, "tags": ["'), F.repeat(F.lit("abcdefghij"), 14_000_000), F.lit('"]}')).alias("payload"))
    made = nested.conform(df, "payload", T.StructType.fromDDL("id bigint"), "doc")
    assert made.select("doc.id").first().id == 9


def test_table_names_do_not_hang_on_the_projection(spark):
    from pyspark.sql import types as T

    from proofloom.operators import nested

    node, schema = "array<struct<id: bigint>>", None
    schema = T.StructType.fromDDL(f"k bigint, steps array<struct<a: struct<root: bigint, nodes: {node}>, b: struct<root: bigint, nodes: {node}>>>")
    whole = nested.inline_schema(schema, "record", ["k"])
    pruned = nested.prune(schema, ["k", "steps.a.nodes.id"])
    kept = nested.keep_known(whole, pruned)
    assert set(kept) == set(whole) and len(kept["nodes"].occurrences) == 1 and list(kept["nodes"].columns) == ["id"]
    df = spark.createDataFrame([(1, [((5, [(1,), (2,)]), None)])], schema).select("k", F_expr("transform(steps, s -> named_struct('a', named_struct('nodes', s.a.nodes)))"))
    rows = nested.flatten(df, nested.keep_known(whole, df.schema), "nodes", ["k"], {})
    assert sorted(r.id for r in rows.collect()) == [1, 2]


def F_expr(text):
    from pyspark.sql import functions as F

    return F.expr(text).alias("steps")
