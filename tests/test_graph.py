import random
from collections import Counter, defaultdict

import pytest

from proofloom.operators import graph, lenses

NAMES = ["A1", "A2", "A3", "B", "C1", "C2", "C3", "Disconnected"]
OUT = {0: [1, 3], 1: [0, 2], 2: [0, 1], 3: [4], 4: [5, 6], 5: [4, 6], 6: [4, 5], 7: []}


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame(list(enumerate(NAMES)), "id bigint, name string")
    links = spark.createDataFrame([(a, b, 1, 1) for a, bs in OUT.items() for b in bs], "src bigint, dst bigint, weight bigint, layers bigint")
    return nodes, links


def test_degrees_and_pagerank(small):
    got = {r.name: (r.in_degree, r.out_degree) for r in graph.degrees(*small).collect()}
    assert got == {"A1": (2, 2), "A2": (2, 2), "A3": (1, 2), "B": (1, 1), "C1": (3, 2), "C2": (2, 2), "C3": (2, 2), "Disconnected": (0, 0)}
    ranks = {NAMES[r.id]: r["rank"] for r in graph.pagerank(*small).collect()}
    want = {"A1": 0.07580375, "A3": 0.05319562, "C1": 0.26149456, "C2": 0.22976384, "Disconnected": 0.02097902}
    assert all(ranks[n] == pytest.approx(v, abs=1e-7) for n, v in want.items())
    assert sum(ranks.values()) == pytest.approx(1)


def test_betweenness_and_labels(small):
    assert {NAMES[r.id]: r.betweenness for r in graph.betweenness(*small).collect()} == {"A1": 8, "A2": 1, "A3": 0, "B": 9, "C1": 8, "C2": 0, "C3": 0, "Disconnected": 0}
    labels = graph.label_propagation(*small)
    assert [r.label for r in labels.orderBy("id").collect()] == [0, 0, 0, 0, 4, 4, 4, 7] or len({r.label for r in labels.collect()}) == 3
    assert sorted(Counter(r.community for r in graph.communities(labels).collect()).values()) == [1, 3, 4]


def test_components_and_cuts(small):
    assert sorted(Counter(r.component for r in graph.weak_components(*small).collect()).values()) == [1, 7]
    assert {(r.id, r.component) for r in graph.strong_components(*small).collect()} == {(0, 0), (1, 0), (2, 0), (3, 3), (4, 4), (5, 4), (6, 4), (7, 7)}
    points, bridges = graph.cut_structure(*small)
    assert {NAMES[r.id] for r in points.collect()} == {"A1", "B", "C1"}
    assert {(NAMES[r.a], NAMES[r.b]) for r in bridges.collect()} == {("A1", "B"), ("B", "C1")}


def test_traversal_takes_names_in_order(spark, small):
    nodes, links = small
    got = {r.node: (r.depth, r.path) for r in graph.traverse(nodes, links, nodes.where("id = 0")).collect()}
    assert got[6] == (3, ["A1", "B", "C1", "C3"]) and got[2] == (2, ["A1", "A2", "A3"]) and 7 not in got
    assert {r.node for r in graph.traverse(nodes, links, nodes.where("id = 3"), 1, reverse=True).collect()} == {3, 0}


def test_influence(small):
    nodes, links = small
    region = lenses.regions(nodes, links, nodes, "proof")
    got = {r.name: (r.direct, r.reachable) for r in lenses.influence(links, nodes, region, 32).collect()}
    assert got == {"A1": (2, 2), "A2": (2, 2), "A3": (1, 2), "B": (1, 3), "C1": (3, 6), "C2": (2, 6), "C3": (2, 6)}
    cut_off = {r.name: r.truncated for r in lenses.influence(links, nodes, region, 1).collect()}
    assert cut_off["B"] and not cut_off["A1"]


def test_random_graph_against_brute_force(spark):
    rng = random.Random(11)
    n = 18
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(26)})
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id bigint")
    links = spark.createDataFrame([(a, b, 1, 1) for a, b in pairs], "src bigint, dst bigint, weight bigint, layers bigint")
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def parts(without=None, edge=None):
        seen, count = {without}, 0
        for v in range(n):
            if v in seen:
                continue
            count += 1
            todo = [v]
            seen.add(v)
            while todo:
                x = todo.pop()
                fresh = {y for y in near[x] - seen if {x, y} != edge}
                seen |= fresh
                todo += fresh
        return count

    base = parts()
    points, bridges = graph.cut_structure(nodes, links)
    assert {r.id for r in points.collect()} == {v for v in range(n) if near[v] and parts(v) > base}
    assert {(r.a, r.b) for r in bridges.collect()} == {(a, b) for a in near for b in near[a] if a < b and parts(edge={a, b}) > base}


def test_empty_graph(spark):
    nodes = spark.createDataFrame([], "id bigint, name string")
    links = spark.createDataFrame([], "src bigint, dst bigint, weight bigint, layers bigint")
    for result in (graph.pagerank(nodes, links), graph.betweenness(nodes, links), graph.weak_components(nodes, links), graph.strong_components(nodes, links), graph.label_propagation(nodes, links), *graph.cut_structure(nodes, links)):
        assert result.count() == 0
