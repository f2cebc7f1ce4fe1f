"""Everything that starts from snapshots: edges, sizes, comparison, groups, lenses, proof steps, validation, commands."""

import json

import pytest
from pyspark.sql import functions as F

from proofloom.operators import lenses, proof, structure, validate
from proofloom.operators.filters import AnalysisFilter
from proofloom.plans.api import Engine, run
from proofloom.plans.corpus import SnapshotCorpus
from proofloom.sources import snapshot


def graph(names, binder="x", kind="lambda", twice=False):
    """kind(binder, names...) with every name a constant; ``twice``: the names stand twice, sharing their nodes."""
    nodes = [{"id": i, "kind": "constant", "children": [], "name": n, "universeLevels": []} for i, n in enumerate(names)] or [{"id": 0, "kind": "sort", "children": []}]
    k = len(nodes)
    nodes.append({"id": k, "kind": "application", "children": list(range(k)), "universeLevels": []})
    nodes.append({"id": k + 1, "kind": kind, "children": [k, k] if twice else [k], "name": binder, "binderInfo": "default", "universeLevels": []})
    return {"root": k + 1, "nodes": nodes}


def total(g):
    times = {g["root"]: 1}
    for n in reversed(g["nodes"]):
        for c in n["children"]:
            times[c] = times.get(c, 0) + times.get(n["id"], 0)
    return sum(times.values())


def declared(name, statement=(), value=None, kind="theorem", **more):
    g = graph(statement, **{k: more.pop(k) for k in ("binder", "twice") if k in more})
    v = graph(value) if value is not None else None
    return {
        "name": name, "kind": kind, "moduleName": "M", "hasValue": v is not None, "type": f"type of {name}", "typeGraph": g, "typeStats": {"nodes": total(g)}, "valueGraph": v, "valueStats": {"nodes": total(v)} if v else None,
        "statementDependencies": sorted(set(statement)), "proofDependencies": sorted(set(value or [])), "axioms": [], "sourceRange": {"start": {"line": 1, "column": 0}, "end": {"line": 2, "column": 0}},
    } | more


def document(declarations, extra=(), version=6, lean="4"):
    names = [d["name"] for d in declarations]
    symbols = [{"name": n, "kind": d["kind"], "moduleName": "M"} for n, d in zip(names, declarations)] + [{"name": n, "kind": "axiom", "moduleName": "Base", **({"isClass": True} if n == "Class" else {})} for n in extra]
    return {"schemaVersion": version, "leanVersion": lean, "importedModules": ["M"], "declarations": declarations, "symbols": symbols}


def load(spark, folder, *documents):
    paths = []
    for i, d in enumerate(documents):
        (folder / f"{i}.json").write_text(json.dumps(d, indent=1))
        paths.append(f"file://{folder}/{i}.json")
    return snapshot.load_snapshots(spark, paths)


def steps(conclusion=2):
    g = graph(["Nat"])
    ctx = {"id": "h@0", "userName": "h", "kind": "assumption", "type": "p", "typeGraph": g}
    made = lambda i, kind, pre, **more: {"id": i, "kind": kind, "proposition": f"p{i}", "propositionGraph": g, "context": [ctx], "scope": ["h@0"], "proofTermPath": [i], "prerequisiteSteps": pre, "hypothesisReferences": [], "namedReferences": []} | more
    return {"complete": True, "visitedTerms": 9, "conclusionStep": conclusion, "steps": [made(0, "hypothesis", [], hypothesisReferences=["h@0"]), made(1, "namedApplication", [0], namedReferences=["Nat"]), made(2, "conclusion", [0, 1])], "namedResults": [{"name": "Nat", "kind": "axiom", "typeGraph": g}]}


DOC = [
    declared("A", ["Nat"], ["B", "Nat"], binder="x", proofSteps=steps()),
    declared("B", ["Nat", "Class"], ["C"], twice=True),
    declared("C", ["Nat"], ["B"], binder="y"),
    declared("D", ["Nat", "Class"], ["A"], kind="definition"),
    declared("E", ["Nat"], ["A", "D"], generationKind="recursor"),
]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    return load(spark, tmp_path_factory.mktemp("snap"), document(DOC, ["Nat", "Class"]))


@pytest.fixture(scope="module")
def corpus(rows):
    return SnapshotCorpus.of(rows)


def test_edges_keep_the_number_of_occurrences(corpus):
    got = {(r.source, r.target, r.layer): (r.occurrences, r.target_in_corpus, r.target_is_class, r.target_module) for r in corpus.edges.collect()}
    assert got["B", "Nat", "statement"] == (2, False, False, "Base") and got["B", "Class", "statement"] == (2, False, True, "Base")
    assert got["A", "B", "proof"] == (1, True, False, "M") and len(got) == 14
    assert corpus.filtered(AnalysisFilter(layer="proof"))[1].count() == 6 - 1  # without those of the generated E


def test_expression_metrics(corpus):
    r = corpus.expressions.join(corpus.declarations.select("decl_id", "name"), "decl_id").where("name = 'B' and layer = 'statement'").first()
    assert (r.total_occurrences, r.unique_nodes, r.max_depth, r.distinct_constants) == (7, 4, 3, 2)
    assert r.kinds == {"constant": 4, "application": 2, "lambda": 1} and r.binders == {"default": 1} and abs(r.kind_proportions["constant"] - 4 / 7) < 1e-9
    assert [(c.name, c.occurrences) for c in r.constant_frequencies] == [("Class", 2), ("Nat", 2)]


def test_walks_are_safe_on_cycles_both_ways(spark, corpus):
    e = Engine(spark, source=corpus)
    assert [(r.name, r.depth, r.place) for r in e.dependencies("A", True).collect()] == [("B", 1, 1), ("C", 2, 2)]
    assert {r.name for r in e.dependents("C", True).collect()} == {"B", "A", "D"}
    assert [r.truncated for r in Engine(spark, source=corpus, limit=1).dependents("C", True).collect()] == [True]
    p = e.path("D", "Class").first()
    assert p.nodes == ["D", "Class"] if p else True
    found = e.path("D", "C").first()
    assert (found.nodes, found.layers, found.occurrences) == (["D", "A", "B", "C"], ["proof"] * 3, 3)
    assert e.path("D", "Nat").first().nodes == ["D", "Nat"]  # an external symbol
    assert e.path("A", "A").first().nodes == ["A"] and e.path("C", "D").first() is None
    with pytest.raises(KeyError):
        e.path("A", "no such name")


def test_ids_are_unique_after_merging(spark, tmp_path, rows):
    other = load(spark, tmp_path, document([declared("F", ["Nat"]), declared("G", ["A"])], ["Nat", "A"]))
    merged = snapshot.merge_snapshots([rows, other])
    ids = [(r.decl_id, r.name) for r in snapshot.declarations(merged).orderBy("decl_id").collect()]
    assert ids == list(enumerate("ABCDEFG"))
    c = SnapshotCorpus.of(merged)
    assert {r.source for r in c.edges.where("target = 'A' and target_in_corpus").collect()} == {"D", "E", "G"}
    assert {r.name: r.kind for r in c.symbols.collect()}["A"] == "theorem"  # as the first snapshot has it
    with pytest.raises(ValueError, match="occurs twice"):
        snapshot.merge_snapshots([rows, rows])
    (tmp_path / "later").mkdir()
    with pytest.raises(ValueError, match="versions"):
        snapshot.merge_snapshots([rows, load(spark, tmp_path / "later", document([declared("H")], lean="5"))])
    a, b = snapshot.declarations(rows), snapshot.declarations(other)
    assert sorted(r.decl_id for r in snapshot.merge_declarations([a, b]).collect()) == list(range(7))


def test_split_snapshots_hold_the_same(spark, tmp_path, rows):
    (tmp_path / "s.json").write_text(json.dumps(document(DOC, ["Nat", "Class"])))
    snapshot.split_snapshot(str(tmp_path / "s.json"), str(tmp_path / "lines"), 2)
    declarations, symbols = snapshot.load_lines(spark, f"file://{tmp_path}/lines")
    assert [(r.decl_id, r.name) for r in declarations.orderBy("decl_id").collect()] == list(enumerate("ABCDE")) and symbols.count() == 7
    c = SnapshotCorpus(spark, "", declarations, symbols)
    assert c.edges.count() == 14


def test_comparison_and_alpha(spark, corpus):
    pairs = spark.createDataFrame([("A", x, "statement") for x in "ABC"], "left_name string, right_name string, layer string")
    got = {r.right_name: r for r in structure.compare_graphs(pairs, corpus.features).collect()}
    assert got["A"].exact_equal and not got["C"].exact_equal and got["C"].alpha_equivalent and not got["B"].alpha_equivalent
    assert got["C"].combined_score == 1 and got["C"].explanation[0].endswith("names of binders")
    b = got["B"]
    cosine = (1 * 2 + 1 + 1) / (3**0.5 * 6**0.5)
    assert (b.dependency_jaccard, b.size_ratio, b.depth_ratio) == (0.5, 0.75, 1) and abs(b.kind_histogram_cosine - cosine) < 1e-5
    assert abs(b.combined_score - (0.5 + cosine + 0.75 + 1) / 4) < 1e-5
    assert (b.shared_dependencies, b.left_only_dependencies, b.right_only_dependencies) == (["Nat"], [], ["Class"])
    e = Engine(spark, source=corpus, limit=2)
    near = e.inspect("A", "neighbors")["neighbors"].collect()
    assert [(r.name, r.place) for r in near] == [("C", 1), ("B", 2)] and "up to the names of binders" in near[0].reason
    assert all(c in near[0].asDict() for c in (*structure.COMPONENTS, "combined_score", "shared_dependencies"))
    with pytest.raises(KeyError):
        e.compare("A", "Nat")


def test_equal_up_to_binders_makes_one_group(spark, corpus):
    ends, met = Engine(spark, source=corpus).endpoints()
    assert {r.name: r.endpoint for r in ends.collect()} == {"A": "group:A", "C": "group:A", "B": "decl:B", "D": "decl:D"}
    assert {(r.prerequisite, r.user) for r in met.collect()} == {("decl:B", "group:A"), ("group:A", "decl:B"), ("group:A", "decl:D")}
    e = Engine(spark, source=corpus)
    ways = {r.direction: r.nodes for r in e.witnesses("group:A", "decl:D").collect()}
    assert ways == {"down": ["D", "A"]} and len(e.fingerprint()) == 64
    assert {r.direction: r.nodes for r in e.witnesses("decl:B", "group:A").collect()}["down"] == ["A", "B"]
    with pytest.raises(KeyError):
        e.witnesses("decl:D", "group:A")


def test_duplicates_and_repeats_list_their_members(spark, corpus, tmp_path):
    e = Engine(spark, source=corpus, mode="alpha", filter=AnalysisFilter(layer="statement"), minimum_size=2)
    assert [(r.declarations, r.first_declaration) for r in e.duplicates().collect()] == [(2, "A")]
    e.write_export("duplicates", str(tmp_path / "d.csv"))
    assert (tmp_path / "d.csv").read_text().splitlines()[1].endswith("A;C")
    places = e.export("repeated").collect()
    assert {(r.declaration, r.location_occurrences) for r in places if r.expression_size == 3} == {("A", 1), ("B", 2), ("C", 1), ("D", 1)}
    assert {r["size"] for r in e.repeated_in("D").collect()} == {3} and e.repeated_in("A").where("declarations = 2").count() >= 1


def lens_corpus(spark, folder):
    """Two clusters of theorems, X at their border: X rests on the one, the other rests on X."""
    d = [declared(f"L{i}", ["Nat"], [f"L{j}" for j in range(4) if j != i]) for i in range(4)] + [declared(f"R{i}", ["Nat"], [f"R{j}" for j in range(4) if j != i] + (["X"] if i == 0 else [])) for i in range(4)]
    d += [declared("X", ["Nat"], ["L0"])]
    return SnapshotCorpus.of(load(spark, folder, document(d, ["Nat"])))


def test_lenses_show_real_witnesses(spark, tmp_path):
    c = lens_corpus(spark, tmp_path)
    e = Engine(spark, source=c)
    found = e.discover()
    bridge = {r.name: r for r in found["bridge"].collect()}
    assert bridge["X"].articulation and bridge["X"].region_pairs >= 1
    report = e.inspect("X")
    edges = {(r.source, r.target) for r in c.edges.where("layer = 'proof'").collect()}
    paths = [r.path for r in report["bridge_paths"].collect()]
    assert paths and all((a, b) in edges for p in paths for a, b in zip(p, p[1:])) and paths[0] == ["R0", "X", "L0"]
    assert {(r.dependent, r.direct) for r in report["influence"].collect()} == {("R0", True), ("R1", False), ("R2", False), ("R3", False)}
    ways = report["influence_paths"].collect()
    assert [(r.path[0], r.path[-1], r.depth) for r in ways] == [("R1", "X", 2), ("R2", "X", 2), ("R3", "X", 2)] and all((a, b) in edges for r in ways for a, b in zip(r.path, r.path[1:]))
    reach = {r.name: (r.reachable, r.direct) for r in found["influence"].collect()}
    assert reach["X"] == (4, 1) and reach["L0"][0] == 8
    assert report["proof"] is None and report["trust"].first().has_proof
    with pytest.raises(KeyError):
        e.inspect("Nat")
    with pytest.raises(ValueError):
        e.discover("trust")
    assert {r.layer for r in Engine(spark, source=c, both_layers=True).discover("neighbors")["neighbors"].collect()} == {"statement", "proof"}


def test_more_declarations_change_influence(spark, tmp_path, rows, corpus):
    more = SnapshotCorpus.of(snapshot.merge_snapshots([rows, load(spark, tmp_path, document([declared("F", ["Nat"], ["A"]), declared("G", ["Nat"], ["F"])], ["Nat", "A"]))]))
    before, after = (Engine(spark, source=c).discover("influence")["influence"] for c in (corpus, more))
    got = {r.name: (r.reachable_before, r.reachable_after, r.change) for r in lenses.influence_change(before, after).collect()}
    assert got == {"B": (2, 4, 2), "C": (2, 4, 2), "A": (0, 2, 2), "F": (0, 1, 1)}
    assert [(r.name, r.load_bearing, r.connected) for r in Engine(spark, source=corpus, limit=2).rankings().collect()] == [("B", 2, 3), ("A", 1, 2)]
    with pytest.raises(ValueError):
        Engine(spark, source=corpus).rankings("beauty")


def test_bridge_pairs_have_the_first_witness(spark):
    links = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (9, 4), (9, 5), (9, 9)], "src bigint, dst bigint")
    region = spark.createDataFrame([(1, "b", "r1"), (2, "a", "r1"), (3, "c", "r2"), (4, "d", "r2"), (5, "e", "r3"), (9, "x", "r1")], "id bigint, name string, region string")
    pairs = lenses.bridge_pairs(links, region)
    assert {(r.from_region, r.to_region): r.path for r in pairs.collect()} == {("r1", "r2"): ["a", "x", "d"], ("r1", "r3"): ["a", "x", "e"], ("r2", "r3"): ["c", "x", "e"]}
    assert [(r.place, r.path) for r in lenses.bridge_witnesses(pairs, 2).orderBy("place").collect()] == [(1, ["a", "x", "d"]), (2, ["a", "x", "e"])]


def test_proof_steps_and_one_of_them(spark, corpus):
    e = Engine(spark, source=corpus)
    report = e.proof_steps("A", 0)
    assert report["edges"] == [(0, 1), (0, 2), (1, 2)] and [r["name"] for r in report["named_results"]] == ["Nat"]
    x = report["selected"]
    assert (x["direct_dependents"], x["transitive_prerequisites"], x["paths_to_conclusion"], x["paths_truncated"], x["path_count"]) == ([1, 2], [], [[0, 1, 2], [0, 2]], False, 2)
    assert e.proof_steps("A", 2)["selected"]["transitive_prerequisites"] == [0, 1]
    with pytest.raises(KeyError, match="unknown proof step"):
        e.proof_steps("A", 7)
    with pytest.raises(KeyError):
        e.proof_steps("B")
    assert e.proof_outline("A")["nodes"] == [1, 2]


def test_counts_of_ways_are_exact():
    n = 80  # every step rests on the two before it
    after = {i: [j for j in (i + 1, i + 2) if j < n] for i in range(n)}
    fib = [1, 1]
    while len(fib) < n:
        fib.append(fib[-1] + fib[-2])
    assert proof.counts_to(after, n - 1)[0] == (fib[n - 1], n)
    many = [{"id": i, "kind": "x", "proposition": "", "prerequisite_steps": [p for p in (i - 1, i - 2) if p >= 0], "named_references": []} for i in range(n)]
    assert proof.path_rows(many, n - 1)[0] == (0, 100, n, True, str(fib[n - 1]))
    assert proof.path_rows(many, None)[0] == (0, 0, 0, False, "0")
    x = proof.inspect(many, n - 1, 0)
    assert len(x["paths_to_conclusion"]) == 100 and x["paths_truncated"] and x["path_count"] == fib[n - 1]


def test_large_outlines_keep_the_landmarks():
    made = [{"id": i, "kind": "localFact" if i % 3 == 0 else "namedApplication", "proposition": "", "prerequisite_steps": [i - 1] if i else [], "named_references": ["rare" if i == 400 else "common"]} for i in range(600)]
    made.append({"id": 600, "kind": "conclusion", "proposition": "", "prerequisite_steps": [599], "named_references": []})
    out = proof.outline(made, 600)
    assert len(out["nodes"]) == 240 and out["candidates"] == 601 and 400 in out["nodes"] and 600 in out["nodes"]
    assert all(i in out["nodes"] for i in range(0, 600, 3))
    facts = [{**s, "kind": "localFact"} if s["id"] < 600 else s for s in made]
    assert proof.outline(facts, 600)["nodes"] == [k * 600 // 239 for k in range(239)] + [600]


BREAK = {
    "occurrences differ from the statistics": lambda d: d["typeStats"].update(nodes=1),
    "dependencies differ from the graph's constants": lambda d: d.update(statementDependencies=["Class"]),
    "value graph without statistics or the other way round": lambda d: d.update(valueStats=None),
    "hasValue differs from the value graph": lambda d: d.update(hasValue=False),
    "declaration is no symbol": lambda d: d.update(name="unknown"),
    "dependency is no symbol": lambda d: d.update(proofDependencies=["nowhere"]),
    "graph is empty": lambda d: d["typeGraph"].update(nodes=[]),
    "root out of bounds": lambda d: d["typeGraph"].update(root=77),
    "id differs from position": lambda d: d["typeGraph"]["nodes"].reverse(),
    "child does not precede its node": lambda d: d["typeGraph"]["nodes"][1].update(children=[2]),
    "complete exactly without a reason": lambda d: d["proofSteps"].update(truncationReason="limit"),
    "complete without a conclusion": lambda d: d["proofSteps"].update(conclusionStep=None),
    "conclusion names no step of that kind": lambda d: d["proofSteps"].update(conclusionStep=1),
    "step ids are not 0, 1, ... in order": lambda d: d["proofSteps"]["steps"].reverse(),
    "step listed twice": lambda d: d["proofSteps"]["steps"].append(d["proofSteps"]["steps"][0]),
    "two steps at one place of the term": lambda d: d["proofSteps"]["steps"][1].update(proofTermPath=[0]),
    "context id listed twice": lambda d: d["proofSteps"]["steps"][0]["context"].append(d["proofSteps"]["steps"][0]["context"][0]),
    "scope differs from the context": lambda d: d["proofSteps"]["steps"][0].update(scope=[]),
    "prerequisite does not precede its step": lambda d: d["proofSteps"]["steps"][0].update(prerequisiteSteps=[1]),
    "prerequisite listed twice": lambda d: d["proofSteps"]["steps"][1].update(prerequisiteSteps=[0, 0]),
    "prerequisite in a scope apart": lambda d: d["proofSteps"]["steps"][0].update(scope=["other"]),
    "hypothesis is no assumption of the context": lambda d: d["proofSteps"]["steps"][1].update(hypothesisReferences=["h@9"]),
    "named result listed twice": lambda d: d["proofSteps"]["namedResults"].append(d["proofSteps"]["namedResults"][0]),
    "named reference without a result": lambda d: d["proofSteps"].update(namedResults=[]),
}


def test_every_rule_is_told_when_broken(spark, tmp_path):
    """One document holds a declaration for every rule, each broken in that way only."""
    made = []
    for i, how in enumerate(BREAK.values()):
        d = json.loads(json.dumps(declared(f"D{i}", ["Nat"], ["Nat"], proofSteps=steps())))
        how(d)
        made.append(d)
    made.append(declared("fine", ["Nat"], ["Nat"], proofSteps=steps()))
    made.append(declared("without", ["Nat"], proofSteps=steps()) | {"valueGraph": None})
    doc = document(made, ["Nat"])
    doc["symbols"] = [s for s in doc["symbols"] if s["name"] != "unknown"]
    c = SnapshotCorpus.of(load(spark, tmp_path, doc))
    names = {r.decl_id: r.name for r in c.declarations.collect()}
    told = {}
    for r in validate.declaration_rules(c).collect():
        subject = names[int(r.subject)] if r.subject.isdigit() else r.subject.split("/")[0]
        told.setdefault(r.rule, set()).add(subject)
    for i, rule in enumerate(BREAK):
        assert ("unknown" if "no symbol" in rule and "declaration" in rule else f"D{i}") in told.get(rule, set()), rule
    assert told["proof steps without a value"] == {"without", "D3"}
    assert not any("fine" in subjects for subjects in told.values())


def test_commands_and_formats(spark, corpus, tmp_path):
    say = lambda *argv: run(spark, list(argv), corpus)
    assert say().startswith("Summary\n4 declarations (3 theorems, 0 generated), ")
    assert "theorem in M, lines 1 to 2" in say("declaration", "A") and "B  [proof] x1" in say("dependencies", "A") and "depth 2" in say("dependencies", "A", "--transitive")
    assert say("path", "D", "C").splitlines()[-1] == "occurrences along it: 3" and say("path", "C", "D") == "no path\n"
    assert say("rank", "statement-depth").splitlines()[1].split() == ["1.", "A", "3"]
    assert "equal up to the names of binders" in say("compare", "A", "C") and say("duplicates", "--alpha").count("2 declarations") >= 1
    assert "[2] conclusion: p2  (from 0, 1)  <- conclusion" in say("proof-steps", "A", "--step", "0") and "2 ways to the conclusion" in say("proof-steps", "A", "--step", "0")
    assert say("inspect", "A", "--lens", "trust,proof").startswith("Evidence about A\n") and "Influence" in say("discover", "--lens", "influence") and "Centrality" in say("graph")
    assert "size" in say("repeated-structures", "--min-size", "2") and say("modules").startswith("Modules\n") and "A" in say("search", "a")
    assert say("export", "metrics").splitlines()[0].startswith("name,module,kind,generated,source_backed,has_documentation,axiom_count,statement_occurrences,statement_unique_nodes,statement_depth")
    assert json.loads(say("rank", "axioms", "--format", "json").splitlines()[0])["rank"] == 1 and "--layer" in say("help")
    assert say("validate").startswith("Violations\n")
    whole = [x for x in say("export", "edges", "--limit", "1").splitlines()]
    assert len(whole) == 1 + Engine(spark, source=corpus).export("edges").count() > 2
    for bad in (["beauty"], ["rank"], ["summary", "--format", "csv"], ["export", "pictures"], ["--layer", "none"]):
        with pytest.raises(ValueError):
            run(spark, bad, corpus)
    with pytest.raises(ValueError, match="snapshot"):
        run(spark, ["summary"])
    (tmp_path / "s.json").write_text(json.dumps(document(DOC, ["Nat", "Class"])))
    assert run(spark, ["--import", f"file://{tmp_path}/s.json", "rank", "proof-occurrences"]).startswith("Ranking by")


def test_generation_kinds(spark):
    df = spark.createDataFrame([(True, True), (False, True), (None, None)], "is_matcher boolean, is_recursor boolean")
    assert [r.k for r in df.select(snapshot.generation_kind(df.columns).alias("k")).collect()] == ["matcher", "recursor", None]


def test_interned_expressions():
    from proofloom.functions import dag

    tree = [{"id": i, "kind": "constant", "children": [], "name": "a", "universe_levels": []} for i in (5, 6)] + [{"id": 7, "kind": "application", "children": [5, 6], "name": None, "universe_levels": []}, {"id": 8, "kind": "application", "children": [7, 5], "name": None, "universe_levels": []}]
    root, nodes = dag.intern(8, tree)
    assert root == 2 and [n["children"] for n in nodes] == [[], [0, 0], [1, 0]] and [n["id"] for n in nodes] == [0, 1, 2]


def test_positions_stay(spark):
    from proofloom.operators.groups import position

    r = spark.createDataFrame([("A",), ("B",)], "n string").select(position(F.col("n")).alias("p")).collect()
    assert r[0].p != r[1].p and all(20 <= (x.p.x**2 + x.p.y**2) ** 0.5 <= 145 for x in r)
