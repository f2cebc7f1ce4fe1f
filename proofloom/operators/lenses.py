"""Evidence about theorems: regions, influence and bridging, over the path graph of one layer.

The path graph holds hidden declarations too; only visible theorems are counted and shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofloom.operators import graph, whole
from proofloom.operators.skew import number_within_keys
from proofloom.session import cut


def regions(nodes: DataFrame, links: DataFrame, visible: DataFrame, layer: str) -> DataFrame:
    """(id, name, region) of the ``visible``: label propagation's groups numbered from 1 in the order of their sorted members' names.

    Two groups never share a member, so the order of the sorted lists is that of their first names and no list is built.
    """
    labels = cut(graph.label_propagation(nodes, links), "labels")
    first = labels.join(nodes.select("id", "name"), "id").groupBy("label").agg(F.min("name").alias("first"))
    digits = F.greatest(F.length(F.col("_number").cast("string")), F.lit(4))
    named = number_within_keys(first, [], ["first"]).select("label", F.concat(F.lit(f"{layer}-region-"), F.lpad(F.col("_number").cast("string"), digits, F.lit("0"))).alias("region"))
    return visible.select("id", "name").join(labels.hint("merge"), "id").join(named.hint("merge"), "label").select("id", "name", "region")


def influence(links: DataFrame, visible: DataFrame, region: DataFrame, max_depth: int) -> DataFrame:
    """Per visible theorem that any other rests on: direct and reachable dependents, regions they lie in, the depth of the farthest, and
    whether ``max_depth`` cut the search. A loop counts as direct, never as reachable."""
    direct = links.join(visible.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("root")).agg(F.countDistinct("src").alias("direct"))
    held = whole.of(region.select("id", "region"), links.select("src", "dst"), nullable=("region",))
    if held:
        reach = whole.reach_counts(held, visible, max_depth, reverse=True)
        rows = visible.withColumnRenamed("id", "root").join(reach, "root").join(direct, "root", "left")
        return rows.select("name", F.coalesce("direct", F.lit(0)).alias("direct"), "reachable", "regions", "farthest", "truncated")
    found, more = graph.reachable(links, visible, max_depth, reverse=True)
    shown = found.join(region.select(F.col("id").alias("node"), "region"), "node")
    reach = shown.groupBy("root").agg(F.count(F.lit(1)).alias("reachable"), F.countDistinct("region").alias("regions"), F.max("depth").alias("farthest"))
    rows = visible.withColumnRenamed("id", "root").join(reach, "root").join(direct, "root", "left").join(more.withColumn("truncated", F.lit(True)), "root", "left")
    return rows.select("name", F.coalesce("direct", F.lit(0)).alias("direct"), "reachable", "regions", "farthest", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def bridges(nodes: DataFrame, links: DataFrame, visible: DataFrame, region: DataFrame) -> DataFrame:
    """Per visible theorem with a user and a prerequisite in different regions: the number of such ordered pairs of regions, whether it is an
    articulation point, and its betweenness. Pairs are counted from the distinct regions on either side, not from pairs of theorems."""
    own = region.select("id", "region")
    users = links.where("src <> dst").join(own.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.col("region").alias("from_region")).distinct()
    bases = links.where("src <> dst").join(own.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), F.col("region").alias("to_region")).distinct()
    pairs = users.groupBy("id").agg(F.count(F.lit(1)).alias("u")).join(bases.groupBy("id").agg(F.count(F.lit(1)).alias("b")), "id")
    same = users.join(bases.withColumnRenamed("to_region", "from_region"), ["id", "from_region"]).groupBy("id").agg(F.count(F.lit(1)).alias("s"))
    counted = pairs.join(same, "id", "left").select("id", (F.col("u") * F.col("b") - F.coalesce("s", F.lit(0))).alias("region_pairs")).where("region_pairs > 0")
    points = graph.cut_structure(nodes, links)[0].withColumn("articulation", F.lit(True))
    between = graph.betweenness(nodes, links)
    rows = visible.join(counted, "id").join(points, "id", "left").join(between, "id")
    return rows.select("name", F.coalesce("articulation", F.lit(False)).alias("articulation"), "region_pairs", F.round("betweenness", 6).alias("betweenness"))


def influence_members(links: DataFrame, visible: DataFrame, region: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """What ``influence`` counts, for the theorems ``roots`` (id): a row per visible theorem that rests on one, with its depth, region and whether it does so directly; a loop is direct at depth 0."""
    names = visible.select("id", "name")
    held = whole.of(names.join(region.select("id", "region").hint("merge"), "id", "left"), links.select("src", "dst"), nullable=("name", "region"))
    if held:
        return whole.influence_members(held, roots, max_depth)
    found, _ = graph.reachable(links, roots, max_depth, reverse=True)
    own = links.where("src = dst").select(F.col("dst").alias("root"), F.col("src").alias("node")).join(roots.select(F.col("id").alias("root")).hint("merge"), "root", "left_semi").distinct().withColumn("depth", F.lit(0).cast("bigint"))
    rows = found.unionByName(own).join(names.select(F.col("id").alias("node"), F.col("name").alias("dependent")).hint("merge"), "node").join(names.select(F.col("id").alias("root"), "name").hint("merge"), "root")
    return rows.join(region.select(F.col("id").alias("node"), "region").hint("merge"), "node", "left").select("name", "dependent", "depth", (F.col("depth") <= 1).alias("direct"), "region")


def influence_witnesses(nodes: DataFrame, links: DataFrame, visible: DataFrame, roots: DataFrame, max_depth: int, most: int = 3) -> DataFrame:
    """(name, place, path, depth): for each of ``roots`` (id, visible theorems) the ``most`` deepest theorems that rest on it, ties by name, each with the names along its way down to the root."""
    shown = visible.select("id", F.lit(True).alias("shown"))
    held = whole.of(nodes.select("id", "name").join(shown.hint("merge"), "id", "left"), links.select("src", "dst", "weight"), nullable=("shown",))
    if held:
        return whole.influence_witnesses(held, roots, max_depth, most)
    found = graph.traverse(nodes, links, roots, max_depth, reverse=True).where("depth > 0").join(visible.select(F.col("id").alias("node"), F.col("name").alias("start")).hint("merge"), "node")
    order = Window.partitionBy("root").orderBy(F.desc("depth"), "start")  # the limit on the place works before the shuffle
    chosen = found.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= most)
    return chosen.join(visible.select(F.col("id").alias("root"), "name").hint("merge"), "root").select("name", "place", F.reverse("path").alias("path"), "depth")


def bridge_pairs(links: DataFrame, region: DataFrame) -> DataFrame:
    """(name, from_region, to_region, path): every ordered pair of different regions that a theorem joins, with the first witness by name: a user in the one, the theorem, a prerequisite in the other.

    The first user in a region and the first prerequisite in another witness their pair, so users and prerequisites are never multiplied with each other.
    """
    near = links.where("src <> dst")
    users = near.join(region.select(F.col("id").alias("src"), F.col("name").alias("user"), F.col("region").alias("from_region")).hint("merge"), "src").groupBy(F.col("dst").alias("id"), "from_region").agg(F.min("user").alias("user"))
    bases = near.join(region.select(F.col("id").alias("dst"), F.col("name").alias("base"), F.col("region").alias("to_region")).hint("merge"), "dst").groupBy(F.col("src").alias("id"), "to_region").agg(F.min("base").alias("base"))
    both = users.join(bases.hint("merge"), "id").where("from_region <> to_region").join(region.select("id", "name").hint("merge"), "id")
    return both.select("name", "from_region", "to_region", F.array("user", "name", "base").alias("path"))


def bridge_witnesses(pairs: DataFrame, most: int = 3) -> DataFrame:
    """The first ``most`` witnesses of each theorem of ``bridge_pairs``, by the names along them."""
    order = Window.partitionBy("name").orderBy("path")
    return pairs.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= most).select("name", "place", "path", "from_region", "to_region")


def influence_reason(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", F.format_string("%d theorem(s) rest on it, %d of them directly, in %d graph region(s)", "reachable", "direct", "regions"))


def bridge_reason(rows: DataFrame) -> DataFrame:
    some = F.format_string("direct witnesses lead through it between %d ordered pair(s) of graph regions", "region_pairs")
    return rows.withColumn("reason", F.when(F.col("region_pairs") > 0, some).otherwise("no direct witness joins different graph regions"))


def neighbor_reason(rows: DataFrame) -> DataFrame:
    """``rows`` of ``operators.structure.graph_neighbours``."""
    claim = F.when(F.col("exact_equal"), "exactly equal expressions").when(F.col("alpha_equivalent"), "expressions equal up to the names of binders").otherwise("neither exact nor alpha equality")
    return rows.withColumn("reason", F.format_string("closest is %s with a combined similarity of %.3f; %s", "name", "combined_score", claim))


def influence_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """What adding to a corpus, duplicates for instance, does to its theorems' influence: (name, layer, reachable_before, reachable_after, change), of all names that either report of ``influence`` has; 0 where one lacks it."""
    side = lambda df, n: df.select("name", "layer", F.col("reachable").alias(n))
    rows = side(before, "reachable_before").join(side(after, "reachable_after").hint("merge"), ["name", "layer"], "full").fillna(0, ["reachable_before", "reachable_after"])
    return rows.withColumn("change", F.col("reachable_after") - F.col("reachable_before"))
