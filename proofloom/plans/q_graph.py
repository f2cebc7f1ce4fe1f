"""Traversals, paths, centrality, components, communities and the evidence built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.operators import graph, lenses
from proofloom.operators.filters import LAYERS, AnalysisFilter
from proofloom.plans import graph_sql
from proofloom.plans.corpus import Corpus
from proofloom.plans.q_metrics import BASE
from proofloom.session import cut

DEFAULT = AnalysisFilter()
DEPTH = 32  # of influence, which tells where it was cut off
ANY_DEPTH = 1 << 30


def _graph(spark: SparkSession, d: str, f: AnalysisFilter = DEFAULT) -> tuple[DataFrame, DataFrame]:
    nodes, links = Corpus(spark, d).graph(f)
    return cut(nodes, "nodes"), cut(links, "links")


def _roots(nodes: DataFrame) -> DataFrame:
    """The stated query set of searches: every declaration whose id is divisible by 100."""
    return nodes.where("id % 100 = 0").select("id")


def _traverse(spark: SparkSession, d: str, reverse: bool) -> DataFrame:
    nodes, links = _graph(spark, d)
    found = graph.traverse(nodes, links, _roots(nodes), ANY_DEPTH, reverse, "ends")
    return found.where("depth > 0").select("root_name", "name", "depth", "path_weight")


def traverse_forward(spark: SparkSession, d: str) -> DataFrame:
    """All that the query declarations rest on, with depth and weight along the breadth-first tree."""
    return _traverse(spark, d, False)


def traverse_reverse(spark: SparkSession, d: str) -> DataFrame:
    """All that rests on the query declarations."""
    return _traverse(spark, d, True)


def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    """The shortest path from every query declaration to every declaration that it reaches."""
    nodes, links = _graph(spark, d)
    found = graph.traverse(nodes, links, _roots(nodes), ANY_DEPTH, form="text")
    return found.select("root", "node", "depth", "path", F.col("path_weight").alias("occurrences"))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(*_graph(spark, d)).select("name", "in_degree", "out_degree", "weighted_in_degree", "weighted_out_degree")


def _ranked(spark: SparkSession, d: str, weighted: bool) -> DataFrame:
    nodes, links = _graph(spark, d)
    return graph.pagerank(nodes, links, weighted).join(nodes, "id").select("name", F.round("rank", 9).alias("pagerank"))


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, False)


def pagerank_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d, True)


def betweenness(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = _graph(spark, d)
    return graph.betweenness(nodes, links).join(nodes, "id").select("name", F.round("betweenness", 6).alias("betweenness"))


def centrality(spark: SparkSession, d: str) -> DataFrame:
    """PageRank, betweenness and degrees of every declaration."""
    nodes, links = _graph(spark, d)
    rows = graph.degrees(nodes, links).join(graph.pagerank(nodes, links), "id").join(graph.betweenness(nodes, links), "id")
    return rows.select("name", F.round("rank", 9).alias("pagerank"), F.round("betweenness", 6).alias("betweenness"), "in_degree", "out_degree")


def weak_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.weak_components(*_graph(spark, d))


def strong_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.strong_components(*_graph(spark, d))


def articulation_points(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = _graph(spark, d)
    return graph.cut_structure(nodes, links)[0].join(nodes, "id").select("name")


def bridges(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = _graph(spark, d)
    names = nodes.select("id", "name")
    pairs = graph.cut_structure(nodes, links)[1].join(names.toDF("a", "na"), "a").join(names.toDF("b", "nb"), "b")
    return pairs.select(F.least("na", "nb").alias("left_name"), F.greatest("na", "nb").alias("right_name"))


def communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(graph.label_propagation(*_graph(spark, d)))


def _path_graph(spark: SparkSession, d: str, layer: str = "proof") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all declarations, links of the layer among them, the visible theorems)."""
    c = Corpus(spark, d)
    nodes, links = c.graph(AnalysisFilter.all(layer=layer))
    visible = DEFAULT.declarations(c.declarations).where("kind = 'theorem'").select(F.col("decl_id").alias("id"), "name")
    return cut(nodes, "nodes"), cut(links, "links"), cut(visible, "visible")


def _regions(spark: SparkSession, d: str, layer: str = "proof") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    nodes, links, visible = _path_graph(spark, d, layer)
    return nodes, links, visible, cut(lenses.regions(nodes, links, visible, layer), "regions")


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the proof layer with hidden members left out; numbers keep gaps."""
    return _regions(spark, d)[3]


def influence(spark: SparkSession, d: str) -> DataFrame:
    """How many visible theorems rest on each theorem, directly and at all, and over how many regions they spread."""
    _, links, visible, region = _regions(spark, d)
    return lenses.influence_reason(lenses.influence(links, visible, region, DEPTH))


def influence_members(spark: SparkSession, d: str) -> DataFrame:
    """The theorems that rest on every hundredth declaration, one by one, with depth and region."""
    _, links, visible, region = _regions(spark, d)
    return lenses.influence_members(links, visible, region, visible.where("id % 100 = 0"), DEPTH)


def influence_witnesses(spark: SparkSession, d: str) -> DataFrame:
    """Of every hundredth declaration that is a visible theorem the three deepest theorems that rest on it, with the ways down."""
    nodes, links, visible = _path_graph(spark, d)
    rows = lenses.influence_witnesses(nodes, links, visible, visible.where("id % 100 = 0"), DEPTH)
    return rows.withColumn("path", F.array_join("path", " > "))


def _both_layers(make) -> DataFrame:
    parts = [make(layer).withColumn("layer", F.lit(layer)) for layer in LAYERS]
    return parts[0].unionByName(parts[1])


def bridge_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Theorems whose users and prerequisites lie in different regions, of either layer."""
    return _both_layers(lambda layer: lenses.bridge_reason(lenses.bridges(*_regions(spark, d, layer))))


def bridge_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The ordered pairs of regions that each theorem joins, with the first witness, of either layer."""

    def pairs(layer: str) -> DataFrame:
        _, links, _, region = _regions(spark, d, layer)
        return lenses.bridge_pairs(links, region).withColumn("path", F.array_join("path", " > "))

    return _both_layers(pairs)


def theorem_rankings(spark: SparkSession, d: str) -> DataFrame:
    """Load, connections and bridging of every visible theorem."""
    nodes, links = _graph(spark, d)
    rows = graph.degrees(nodes, links).join(graph.betweenness(nodes, links), "id").where("kind = 'theorem'")
    return rows.select("name", F.col("in_degree").alias("load_bearing"), (F.col("in_degree") + F.col("out_degree")).alias("connected"), F.round("betweenness", 6).alias("bridge"))


def graph_totals(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = _graph(spark, d)
    own, between = nodes.agg(F.count(F.lit(1)).alias("declarations")), links.agg(F.count(F.lit(1)).alias("connections"), F.sum("weight").alias("occurrences"))
    names = [*own.columns, *between.columns]
    return own.unionByName(between, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])


QUERIES = {
    f.__name__: f
    for f in (
        traverse_forward, traverse_reverse, shortest_path, degrees, pagerank, pagerank_weighted, betweenness, centrality, weak_components, strong_components, articulation_points, bridges,
        communities, regions, influence, influence_members, influence_witnesses, bridge_evidence, bridge_pairs, theorem_rankings, graph_totals,
    )
}

NODES = f"""{BASE},
n as (select decl_id id, name, kind from v),
l as (select source_id src, target_id dst, min(occurrences) weight, count(*) layers from f where target_id in (select id from n) group by 1, 2)"""
NEAR = f"""{NODES}, near as (select src, dst from l where src <> dst union select dst, src from l where src <> dst)"""
def _paths(layer: str, base: str = BASE) -> str:
    return f"""{base},
n as (select decl_id id, name from d),
l as (select source_id src, target_id dst from e where target_id is not null and layer = '{layer}' and source_id in (select decl_id from d) group by 1, 2),
near as (select src, dst from l where src <> dst union select dst, src from l where src <> dst),
vis as (select decl_id id, name from v where kind = 'theorem')"""


PATHS = _paths("proof")


def _levels(reverse: bool, depth: int) -> str:
    a, b = ("dst", "src") if reverse else ("src", "dst")
    parts = ["l0 as materialized (select id root, id node, [name] path, 0::bigint w from n where id % 100 = 0)", "s0 as materialized (select root, node from l0)"]
    for k in range(1, depth + 1):
        parts.append(
            f"l{k} as materialized (select t.root, l.{b} node, min(struct_pack(p := list_append(t.path, n.name), w := t.w + l.weight)) m from "
            f"(select root, node, {'path, w' if k == 1 else 'm.p path, m.w w'} from l{k - 1}) t join l on t.node = l.{a} join n on n.id = l.{b} "
            f"where (t.root, l.{b}) not in (select root, node from s{k - 1}) group by 1, 2)"
        )
        parts.append(f"s{k} as materialized (select * from s{k - 1} union all select root, node from l{k})")
    every = " union all ".join(f"select root, node, {k}::bigint depth, m.p path, m.w::bigint w from l{k}" for k in range(1, depth + 1))
    return f"with {NODES}, {', '.join(parts)}, every as ({every})"


def _pagerank(weighted: bool) -> str:
    share = "weight::double" if weighted else "1.0::double"
    parts = [f"st as materialized (select src, dst, {share} / sum({share}) over (partition by src) share from l)", "c as (select count(*) k from n)", "r0 as materialized (select id, 1.0::double / k r from n, c)"]
    for i in range(1, 51):
        parts.append(
            f"r{i} as materialized (select n.id, 0.15::double / k + 0.85::double * (coalesce(g.s, 0) + (select coalesce(sum(r), 0) from r{i - 1} where id not in (select src from st)) / k) r "
            f"from c, n left join (select dst, sum(r * share) s from r{i - 1} join st on id = src group by 1) g on n.id = g.dst)"
        )
    return f"with {NODES}, {', '.join(parts)} select name, round(r, 9) pagerank from r50 join n on r50.id = n.id"


def _labels(rounds: int, source: str) -> str:
    parts = [f"t0 as materialized (select id, id label from {source})"]
    for i in range(1, rounds + 1):
        parts.append(
            f"t{i} as materialized (select t.id, coalesce(g.label, t.label) label from t{i - 1} t left join (select id, label from (select src id, label, row_number() over (partition by src order by count(*) desc, label) k "
            f"from near join t{i - 1} p on p.id = near.dst group by src, label) where k = 1) g on t.id = g.id)"
        )
    return ", ".join(parts)


def _region_sql(layer: str, base: str = BASE) -> str:
    """``region`` (id, name, region) over the path graph of a layer."""
    return f"""{_paths(layer, base)}, {_labels(50, 'n')},
g as (select label, list_sort(list(name)) members from t50 join n on t50.id = n.id group by 1), num as (select label, row_number() over (order by members) k from g),
region as materialized (select vis.id, vis.name, '{layer}-region-' || lpad(k::varchar, greatest(4, len(k::varchar))::int, '0') region from vis join t50 on vis.id = t50.id join num on t50.label = num.label)"""


def _bridge_sql(layer: str) -> str:
    """``pairs`` and ``told``, the evidence, of a layer."""
    return f"""{_region_sql(layer)},
us as (select dst id, region from_region, min(name) u from l join region on src = region.id where src <> dst group by 1, 2), bs as (select src id, region to_region, min(name) b from l join region on dst = region.id where src <> dst group by 1, 2),
pairs as (select region.name, from_region, to_region, u || ' > ' || region.name || ' > ' || b path, us.id from us join bs on us.id = bs.id join region on region.id = us.id where from_region <> to_region),
{graph_sql.between()}, {graph_sql.CUT_POINTS}"""


REASON = "printf('direct witnesses lead through it between %d ordered pair(s) of graph regions', k)"


REACH = "r as (select src root, dst node from l union select r.root, l.dst from r join l on r.node = l.src)"
SQL = {
    "traverse_forward": f"{_levels(False, 40)} select a.name root_name, path[-1] as name, depth, w path_weight from every join n a on a.id = root",
    "traverse_reverse": f"{_levels(True, 40)} select a.name root_name, path[-1] as name, depth, w path_weight from every join n a on a.id = root",
    "shortest_path": f"{_levels(False, 40)} select root, node, depth, array_to_string(path, ' > ') path, w occurrences from every union all select id, id, 0, name, 0 from n where id % 100 = 0",
    "degrees": f"""with {NODES} select name, coalesce(i, 0)::bigint in_degree, coalesce(o, 0)::bigint out_degree, coalesce(wi, 0)::bigint weighted_in_degree, coalesce(wo, 0)::bigint weighted_out_degree from n
left join (select dst, sum(layers) i, sum(weight) wi from l group by 1) a on a.dst = id left join (select src, count(*) o, sum(weight) wo from l group by 1) b on b.src = id""",
    "pagerank": _pagerank(False),
    "pagerank_weighted": _pagerank(True),
    "weak_components": f"""with recursive {NEAR}, r as (select id root, id node from n union select r.root, near.dst from r join near on r.node = near.src)
select node id, min(root) component from r group by 1""",
    "strong_components": f"""with recursive {NODES}, {REACH}, b as (select id root, id node from n union select root, node from r)
select x.root id, min(x.node) component from b x join b y on x.root = y.node and x.node = y.root group by 1""",
    "communities": f"with {NEAR}, {_labels(50, 'n')} select id, dense_rank() over (order by label) - 1 community from t50",
    "graph_totals": f"with {NODES} select (select count(*) from n) declarations, count(*) connections, sum(weight)::bigint occurrences from l",
    "regions": f"with {_region_sql('proof')} select id, name, region from region",
    "betweenness": f"with {NODES}, {graph_sql.between()} select name, round(betweenness, 6) betweenness from between join n on n.id = between.id",
    "theorem_rankings": f"""with {NODES}, {graph_sql.between()}, i as (select dst, sum(layers) i from l group by 1), o as (select src, count(*) o from l group by 1)
select name, coalesce(i, 0)::bigint load_bearing, (coalesce(i, 0) + coalesce(o, 0))::bigint connected, round(betweenness, 6) bridge from n join between on n.id = between.id left join i on i.dst = n.id left join o on o.src = n.id where kind = 'theorem'""",
    "centrality": f"""{_pagerank(False).split(' select name, round(r, 9)')[0]}, {graph_sql.between()}, i as (select dst, sum(layers) i from l group by 1), o as (select src, count(*) o from l group by 1)
select name, round(r, 9) pagerank, round(betweenness, 6) betweenness, coalesce(i, 0)::bigint in_degree, coalesce(o, 0)::bigint out_degree from n join r50 on r50.id = n.id join between on n.id = between.id left join i on i.dst = n.id left join o on o.src = n.id""",
    "articulation_points": f"with recursive {NEAR}, {graph_sql.CUT_POINTS} select name from points join n on n.id = points.id",
    "bridges": f"with recursive {NEAR}, {graph_sql.CUT_LINKS} select least(x.name, y.name) left_name, greatest(x.name, y.name) right_name from parted join n x on x.id = a join n y on y.id = b",
    "influence": f"""with {_region_sql('proof')}, {graph_sql.levels('b', 'select id from vis', 'dst', 'src', 32)},
m as (select root, node, depth from b_all join vis on vis.id = node where depth > 0), gg as (select root, count(*) reachable, count(distinct region) "regions", max(depth) farthest from m join region on region.id = m.node group by 1),
dr as (select dst, count(distinct src) direct from l join vis on vis.id = src group by 1)
select name, coalesce(direct, 0) direct, reachable, "regions", farthest, false truncated, printf('%d theorem(s) rest on it, %d of them directly, in %d graph region(s)', reachable, coalesce(direct, 0), "regions") reason
from gg join vis on vis.id = gg.root left join dr on dr.dst = gg.root""",
    "influence_members": f"""with {_region_sql('proof')}, {graph_sql.levels('b', 'select id from vis where id % 100 = 0', 'dst', 'src', 32)},
m as (select root, node, depth from b_all where depth > 0 union all select dst, src, 0 from l where src = dst and dst % 100 = 0)
select a.name, region.name dependent, depth, depth <= 1 direct, region from m join vis a on a.id = m.root join region on region.id = m.node""",
    "influence_witnesses": f"""{_levels(True, 32).replace(NODES, _paths('proof') .replace("l as (select source_id src, target_id dst from", "l as (select source_id src, target_id dst, min(occurrences) weight from")).replace("from n where id % 100 = 0", "from vis where id % 100 = 0")},
p as (select root, node, depth, path, row_number() over (partition by root order by depth desc, vis.name) place from every join vis on vis.id = node)
select vis.name, place, array_to_string(list_reverse(path), ' > ') path, depth from p join vis on vis.id = root where place <= 3""",
    "bridge_pairs": " union all ".join(f"select * from (with {_region_sql(layer)}, us as (select dst id, region from_region, min(name) u from l join region on src = region.id where src <> dst group by 1, 2), bs as (select src id, region to_region, min(name) b from l join region on dst = region.id where src <> dst group by 1, 2) select region.name, from_region, to_region, u || ' > ' || region.name || ' > ' || b path, '{layer}' layer from us join bs on us.id = bs.id join region on region.id = us.id where from_region <> to_region)" for layer in ("statement", "proof")),
    "bridge_evidence": " union all ".join(f"select * from (with recursive {_bridge_sql(layer)}, c as (select id, any_value(name) name, count(*) k from pairs group by 1) select name, c.id in (select id from points) articulation, k region_pairs, round(betweenness, 6) betweenness, {REASON} reason, '{layer}' layer from c join between on between.id = c.id)" for layer in ("statement", "proof")),
}
