"""SQL counterparts of the searches over all nodes: the levels of a breadth-first search as one table each. Every table expects ``n`` (id) and ``l`` (src, dst) to be there."""

from __future__ import annotations

DEEPEST = 40


def levels(name: str, roots: str, a: str, b: str, depth: int = DEEPEST, links: str = "l") -> str:
    """``name``_all (root, node, depth, paths): what ``roots`` (a query of ids) reach along ``links`` from ``a`` to ``b``, themselves at depth 0, with the number of shortest paths."""
    parts = [f"{name}_l as materialized (select distinct src, dst from {links} where src <> dst)", f"{name}0 as materialized (select id root, id node, 1.0::double paths from ({roots}))", f"{name}s0 as materialized (select root, node from {name}0)"]
    for k in range(1, depth + 1):
        parts.append(
            f"{name}{k} as materialized (select t.root, x.{b} node, sum(t.paths) paths from {name}{k - 1} t join {name}_l x on t.node = x.{a} "
            f"where not exists (select 1 from {name}s{k - 1} s where s.root = t.root and s.node = x.{b}) group by 1, 2)"
        )
        parts.append(f"{name}s{k} as materialized (select * from {name}s{k - 1} union all select root, node from {name}{k})")
    every = " union all ".join(f"select root, node, {k}::bigint depth, paths from {name}{k}" for k in range(depth + 1))
    return ", ".join([*parts, f"{name}_all as materialized ({every})"])


def between(name: str = "b", depth: int = DEEPEST, links: str = "l") -> str:
    """``between`` (id, betweenness) from the levels of all of ``n``: dependencies flow back from the deepest level."""
    parts = [levels(name, "select id from n", "src", "dst", depth, links), f"{name}d{depth} as materialized (select root, node, paths, 0.0::double delta from {name}{depth})"]
    for k in range(depth - 1, 0, -1):
        parts.append(
            f"{name}d{k} as materialized (select t.root, t.node, t.paths, coalesce(sum(t.paths / d.paths * (1 + d.delta)), 0) delta from {name}{k} t left join {name}_l x on t.node = x.src "
            f"left join {name}d{k + 1} d on d.root = t.root and d.node = x.dst group by 1, 2, 3)"
        )
    every = " union all ".join(f"select node, delta from {name}d{k}" for k in range(1, depth + 1))
    return ", ".join([*parts, f"between as (select n.id, coalesce(sum(delta), 0) betweenness from n left join ({every}) on n.id = node group by 1)"])


# v is an articulation point if, without it, one of its neighbours doesn't reach all the others; {near} has both directions
CUT_POINTS = """starts as (select src v, min(dst) s from near group by 1),
fl as (select v, s node from starts union select fl.v, near.dst from fl join near on near.src = fl.node where near.dst <> fl.v),
points as (select distinct near.src id from near left join fl on fl.v = near.src and fl.node = near.dst where fl.node is null)"""

# a link on a triangle is no bridge; of the others each is one if its ends don't reach one another without it
CUT_LINKS = """open as (select x.src a, x.dst b from near x where x.src < x.dst and not exists (select 1 from near y join near z on y.dst = z.src where y.src = x.src and z.dst = x.dst)),
fb as (select a, b, a node from open union select fb.a, fb.b, near.dst from fb join near on near.src = fb.node where not (near.src = fb.a and near.dst = fb.b) and not (near.src = fb.b and near.dst = fb.a)),
parted as (select a, b from open where not exists (select 1 from fb where fb.a = open.a and fb.b = open.b and fb.node = open.b))"""
