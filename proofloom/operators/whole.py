"""Graph loops and searches by tasks that each hold the whole graph (``functions.csr``), for graphs of at most ``NODES`` and ``LINKS``.

A round of a loop over DataFrames costs seconds whatever it moves, and a search from many roots shuffles a row for every pair of root and node; here a loop is one task and a search one task per share of
the roots, which shuffles nothing. The tasks read the graph from the shared scratch folder. ``of`` gives None where that doesn't do, and the callers in ``graph`` and ``lenses`` then work round by round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions import csr
from proofloom.session import cut, shared_local_path

NODES, LINKS = 1 << 22, 1 << 23
BATCH = 1 << 15
TASKS = 4  # for each core


@dataclass(frozen=True)
class Whole:
    spark: SparkSession
    nodes: tuple[str, ...]
    links: tuple[str, ...]


def of(nodes: DataFrame, links: DataFrame, nullable: tuple[str, ...] = ()) -> Whole | None:
    """The graph of ``nodes`` (id and more) and ``links`` (src, dst and perhaps an integer weight), written for tasks to read; None if it is too large, if no folder is shared or if columns but ``nullable`` hold nulls."""
    spark = links.sparkSession
    if shared_local_path(spark) is None or dict(links.dtypes).get("weight", "bigint") not in ("bigint", "int"):
        return None
    files = []
    for df, most in ((nodes, NODES), (links, LINKS)):
        own = tuple(sorted(unquote(urlparse(f).path) for f in cut(df, "whole").inputFiles()))
        rows, nulls = csr.rows_and_nulls(own)
        if rows > most or any(n != 0 for c, n in nulls.items() if c not in nullable and rows):
            return None
        files.append(own)
    return Whole(spark, *files)


def _batches(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    rows = pa.RecordBatch.from_pydict(columns)
    for k in range(0, len(rows), BATCH):
        yield rows.slice(k, BATCH)


def _once(w: Whole, values: Callable[[csr.Graph], np.ndarray], schema: str, column: str) -> DataFrame:
    """(id, ``column``) of every node, in one task."""
    nodes, links = w.nodes, w.links

    def run(batches):
        list(batches)
        g = csr.load(nodes, links)
        if g.n:
            yield from _batches({"id": pa.array(g.ids), column: pa.array(values(g))})

    return cut(w.spark.range(0, 1, 1, 1).mapInArrow(run, schema), column)


def pagerank(w: Whole, weighted: bool, damping: float, rounds: int) -> DataFrame:
    return _once(w, lambda g: csr.pagerank(g, weighted, damping, rounds), "id bigint, rank double", "rank")


def label_propagation(w: Whole, rounds: int) -> DataFrame:
    return _once(w, lambda g: g.ids[csr.label_propagation(g, rounds)], "id bigint, label bigint", "label")


def _each(w: Whole, roots: DataFrame, rows: Callable[[csr.Graph, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``rows`` gives for the nodes ``roots`` (id), which are dealt out to tasks."""
    nodes, links = w.nodes, w.links

    def run(batches):
        own = [b.column(0).drop_null().to_numpy() for b in batches]
        if any(len(x) for x in own):
            g = csr.load(nodes, links)
            yield from rows(g, g.places(np.sort(np.concatenate(own))))

    return roots.select("id").distinct().repartition(TASKS * w.spark.sparkContext.defaultParallelism).mapInArrow(run, schema)


def traverse(w: Whole, roots: DataFrame, max_depth: int, reverse: bool, form: str) -> DataFrame:
    """``graph.traverse``; the nodes' table has a name each."""

    def rows(g, places):
        names = g.column("name")
        for root in places[g.row_of[places] >= 0]:
            way, text = np.array([[root]]), names.take(pa.array([root]))
            for depth, (at, before, along) in enumerate(csr.ways(g, root, max_depth, reverse)):
                out = {"root": pa.array(np.full(len(at), g.ids[root])), "node": pa.array(g.ids[at]), "depth": pa.array(np.full(len(at), depth))}
                if form == "ends":
                    out |= {"root_name": names.take(pa.array(np.full(len(at), root))), "name": names.take(pa.array(at))}
                elif form == "text":
                    text = pc.binary_join_element_wise(text.take(pa.array(before)), names.take(pa.array(at)), " > ") if depth else text
                    out["path"] = text
                else:
                    way = np.column_stack([way[before], at]) if depth else way
                    out["path"] = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * (depth + 1)), names.take(pa.array(way.ravel())))
                yield from _batches(out | {"path_weight": pa.array(along)})

    path = {"ends": "root_name string, name string", "text": "path string"}.get(form, "path array<string>")
    return _each(w, roots, rows, f"root bigint, node bigint, depth bigint, {path}, path_weight bigint")


def betweenness(w: Whole) -> DataFrame:
    """(id, betweenness) of every node; each task adds up what its share of the roots gives."""
    nodes, links, tasks = w.nodes, w.links, TASKS * w.spark.sparkContext.defaultParallelism

    def run(batches):
        shares = [x for b in batches for x in b.column(0).to_pylist()]
        g = csr.load(nodes, links)
        for share in shares:
            if g.n:
                yield from _batches({"id": pa.array(g.ids), "betweenness": pa.array(csr.betweenness(g, np.arange(share, g.n, tasks)))})

    shares = cut(w.spark.range(0, tasks, 1, tasks).mapInArrow(run, "id bigint, betweenness double"), "shares")
    return shares.groupBy("id").agg(F.sum("betweenness").alias("betweenness"))


def reach_counts(w: Whole, roots: DataFrame, max_depth: int, reverse: bool) -> DataFrame:
    """(root, reachable, regions, farthest, truncated) of the roots that reach a node with a region, of which the nodes' table holds those."""

    def rows(g, places):
        group = pc.fill_null(pc.dictionary_encode(g.column("region")).indices, -1).to_numpy(zero_copy_only=False)
        side = 64 * max(1, csr.CELLS // g.n)
        for k in range(0, len(places), side):
            own = places[k : k + side]
            reachable, regions, farthest, more = csr.reach_counts(g, own, max_depth, reverse, group)
            some = reachable > 0
            yield from _batches({n: pa.array(v[some]) for n, v in (("root", g.ids[own]), ("reachable", reachable), ("regions", regions), ("farthest", farthest), ("truncated", more))})

    return cut(_each(w, roots, rows, "root bigint, reachable bigint, regions bigint, farthest bigint, truncated boolean"), "reach")


def influence_members(w: Whole, roots: DataFrame, max_depth: int) -> DataFrame:
    """``lenses.influence_members``; the nodes' table has name and region of the visible theorems."""

    def rows(g, places):
        names, regions, shown = g.column("name"), g.column("region"), g.row_of >= 0
        loops = np.zeros(g.n, bool)
        loops[g.src[g.src == g.dst]] = True
        for root in places[shown[places]]:
            found = [x[shown[x]] for x in csr.levels(g, root, max_depth, True)[0]]
            found[0] = found[0][loops[found[0]]]
            at, depth = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
            root_names = names.take(pa.array(np.full(len(at), root)))
            yield from _batches({"name": root_names, "dependent": names.take(pa.array(at)), "depth": pa.array(depth), "direct": pa.array(depth <= 1), "region": regions.take(pa.array(at))})

    return _each(w, roots, rows, "name string, dependent string, depth bigint, direct boolean, region string")


def influence_witnesses(w: Whole, roots: DataFrame, max_depth: int, most: int) -> DataFrame:
    """``lenses.influence_witnesses``; the nodes' table has name and shown, which is null but for the visible theorems."""

    def rows(g, places):
        names, rank, shown = g.column("name"), g.name_rank, g.column("shown").is_valid().to_numpy(zero_copy_only=False)
        for root in places[shown[places]]:
            levels = list(csr.ways(g, root, max_depth, True))
            paths, left = [], most
            for depth in range(len(levels) - 1, 0, -1):
                own = np.flatnonzero(shown[levels[depth][0]])
                for at in own[np.argsort(rank[levels[depth][0][own]], kind="stable")][:left]:
                    path = []
                    for nodes, before, _ in levels[depth:0:-1]:
                        path.append(nodes[at])
                        at = before[at]
                    paths.append((depth, names.take(pa.array([*path, root])).to_pylist()))
                left = most - len(paths)
                if left <= 0:
                    break
            if paths:
                yield from _batches({"name": names.take(pa.array(np.full(len(paths), root))), "place": pa.array(np.arange(1, len(paths) + 1)), "path": pa.array([p for _, p in paths], pa.list_(pa.string())), "depth": pa.array([d for d, _ in paths], pa.int64())})

    return _each(w, roots, rows, "name string, place bigint, path array<string>, depth bigint")
