"""Programs over one expression graph, run per record inside Arrow batches.

A graph is a root id and a list of nodes (id, kind, children, name, var_index, value_text, binder_info, universe_levels) in any order. The first of several nodes with an id
counts; children that name no node, and children that would close a cycle, are left out. Sizes are those of the expanded tree; from 2**62 on they stay there and ``capped`` says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAP = 1 << 62
BINDERS = ("lambda", "forall", "let")
NODE_COLUMNS = "node_id bigint, kind string, name string, binder_info string, is_root boolean, multiplicity bigint, size bigint, depth bigint, capped boolean, exact string, alpha string"


def _order(nodes: dict[int, dict], start: int | None = None) -> tuple[list[int], dict[int, list[int]]]:
    """Ids with children before parents, and the children that count."""
    state: dict[int, int] = {}
    out: list[int] = []
    kept: dict[int, list[int]] = {}
    for first in sorted(nodes) if start is None else [start]:
        if first in state:
            continue
        state[first], kept[first] = 1, []
        stack = [(first, iter(nodes[first]["children"] or []))]
        while stack:
            at, rest = stack[-1]
            for child in rest:
                if child not in nodes or state.get(child) == 1:
                    continue
                kept[at].append(child)
                if child not in state:
                    state[child], kept[child] = 1, []
                    stack.append((child, iter(nodes[child]["children"] or [])))
                    break
            else:
                state[at] = 2
                out.append(at)
                stack.pop()
    return out, kept


def _digest(node: dict, children: list[str], alpha: bool) -> str:
    """MD5 over the node's fields, each with its length in bytes, and its children's digests."""
    name = None if alpha and node["kind"] in BINDERS else node["name"]
    told = [node["kind"], name, node["var_index"], node["value_text"], node["binder_info"], *(node["universe_levels"] or [])]
    texts = ["-" if p is None else f"{len(str(p).encode())}:{p}" for p in told]
    return hashlib.md5("".join([*texts, f"|{len(children)}|", *children]).encode(), usedforsecurity=False).hexdigest()


def analyse(root: int | None, listed: list[dict] | None) -> list[dict]:
    """A row per distinct node: its multiplicity (paths from the root, 0 off the root's tree), size, depth from 1, and two digests; equal ``exact``
    digests mean equal subtrees, equal ``alpha`` digests equal up to the names of binders."""
    nodes: dict[int, dict] = {}
    for n in listed or []:
        if n is not None and n["id"] is not None:
            nodes.setdefault(n["id"], n)
    # the root's tree first, so that cycles break the same way wherever nodes stand in the list
    order, kept = _order(nodes, root) if root in nodes else ([], {})
    if len(order) < len(nodes):
        more, also = _order(nodes)
        order += [i for i in more if i not in kept]
        kept = also | kept
    size, depth, exact, alpha = {}, {}, {}, {}
    for i in order:
        c = [k for k in kept[i] if k in size]
        size[i] = min(CAP, 1 + sum(size[k] for k in c))
        depth[i] = 1 + max((depth[k] for k in c), default=0)
        exact[i] = _digest(nodes[i], [exact[k] for k in c], False)
        alpha[i] = _digest(nodes[i], [alpha[k] for k in c], True)
    times = dict.fromkeys(order, 0)
    if root in nodes:
        times[root] = 1
        for i in reversed(order):
            if times[i]:
                for k in kept[i]:
                    times[k] = min(CAP, times[k] + times[i])
    return [
        {"node_id": i, "kind": nodes[i]["kind"], "name": nodes[i]["name"], "binder_info": nodes[i]["binder_info"], "is_root": i == root, "multiplicity": times[i], "size": size[i], "depth": depth[i], "capped": CAP in (size[i], times[i]), "exact": exact[i], "alpha": alpha[i]} for i in order
    ]


def node_rows(graphs: DataFrame, keys: list[str]) -> DataFrame:
    """``graphs``: keys, root, nodes. One row per node with the columns of ``analyse``; a null or empty graph gives none. No shuffle."""
    fields = [graphs.schema[k] for k in keys]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", " + NODE_COLUMNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"node_id": pa.int64(), "kind": pa.string(), "name": pa.string(), "binder_info": pa.string(), "is_root": pa.bool_(), "multiplicity": pa.int64(), "size": pa.int64(), "depth": pa.int64(), "capped": pa.bool_(), "exact": pa.string(), "alpha": pa.string()}
        for batch in batches:
            roots, lists = batch.column("root").to_pylist(), batch.column("nodes").to_pylist()
            index, out = [], []
            for i, (root, nodes) in enumerate(zip(roots, lists)):
                rows = analyse(root, nodes)
                index.extend([i] * len(rows))
                out.extend(rows)
            take = pa.array(index, pa.int64())
            made = [pa.array([r[n] for r in out], t) for n, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in keys], *made], names=[*keys, *kinds])

    return graphs.select(*keys, "root", "nodes").mapInArrow(run, schema)


def intern(root: int, listed: list[dict]) -> tuple[int, list[dict]]:
    """The same expression with every distinct subtree stored once: (root, nodes), ids 0, 1, ... in an order that has children before their parents. Nodes off the root's tree are left out."""
    nodes = {n["id"]: n for n in reversed([x for x in listed if x is not None and x["id"] is not None])}
    order, kept = _order(nodes, root)
    known: dict[tuple, int] = {}
    at: dict[int, int] = {}
    out: list[dict] = []
    for i in order:
        children = [at[k] for k in kept[i] if k in at]
        own = (tuple(children), *(tuple(v) if isinstance(v, list) else v for k, v in sorted(nodes[i].items()) if k not in ("id", "children")))
        if own not in known:
            known[own] = len(out)
            out.append({**nodes[i], "id": len(out), "children": children})
        at[i] = known[own]
    return at[root], out


def expression_stats(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Per graph of ``node_rows`` the figures of its expanded tree: total_occurrences, max_depth and the occurrences of every kind; with unique_nodes, distinct_constants, constants (a map), kinds and binders (maps)."""
    times = F.sum("multiplicity")
    live = nodes.where("multiplicity > 0 or is_root")
    whole = live.groupBy(*keys).agg(
        times.alias("total_occurrences"), F.max(F.when(F.col("is_root"), F.col("depth"))).alias("max_depth"), F.max(F.when(F.col("is_root"), F.col("exact"))).alias("exact"), F.max(F.when(F.col("is_root"), F.col("alpha"))).alias("alpha")
    )
    unique = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_nodes"))
    binder = F.when(F.col("kind") == "let", F.lit("let")).when(F.col("kind").isin("lambda", "forall"), F.coalesce("binder_info", F.lit("unknown")))
    named = F.array(F.struct(F.lit("kinds").alias("of"), F.col("kind").alias("k")), F.struct(F.lit("binders").alias("of"), binder.alias("k")), F.struct(F.lit("constants").alias("of"), F.when(F.col("kind") == "constant", F.col("name")).alias("k")))
    cells = nodes.select(*keys, "multiplicity", F.explode(named).alias("x")).where("x.k is not null").groupBy(*keys, "x.of", "x.k").agg(times.alias("n"), F.count(F.lit(1)).alias("u"))
    entry = F.struct("k", "n")
    part = lambda of: F.map_from_entries(F.collect_list(F.when(F.col("of") == of, entry)))  # noqa: E731 - a graph's own kinds and names
    maps = cells.groupBy(*keys).agg(part("kinds").alias("kinds"), part("binders").alias("binders"), part("constants").alias("constants"), F.map_from_entries(F.collect_list(F.when(F.col("of") == "kinds", F.struct("k", "u")))).alias("unique_kinds"))
    rows = whole.join(unique, keys).join(maps, keys)
    return rows.withColumn("distinct_constants", F.size("constants").cast("bigint")).withColumn("kind_proportions", F.transform_values("kinds", lambda _, n: F.try_divide(n, F.col("total_occurrences"))))


def render(root: int, listed: list[dict], max_depth: int) -> str:
    """The expression as an indented tree down to ``max_depth`` levels, deeper parts as an ellipsis."""
    nodes = {n["id"]: n for n in reversed(listed)}
    out, stack = [], [(root, 0)]
    while stack:
        at, level = stack.pop()
        if level >= max_depth:
            out.append("  " * level + "…")
            continue
        out.append("  " * level + label(nodes[at]))
        stack.extend((c, level + 1) for c in reversed(nodes[at]["children"] or []) if c in nodes)
    return "\n".join(out)


def label(node: dict) -> str:
    """kind, then name, #index, binder, value and levels where there are any."""
    parts = [node["kind"], node.get("name"), None if node.get("var_index") is None else f"#{node['var_index']}", node.get("binder_info"), node.get("value_text")]
    levels = node.get("universe_levels")
    return " ".join(p for p in [*parts, f"levels={','.join(levels)}" if levels else None] if p is not None)
