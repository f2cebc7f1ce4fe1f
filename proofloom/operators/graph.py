"""Graph algorithms as loops over DataFrames.

``nodes`` has a unique bigint ``id``; ``links`` has ``src``, ``dst`` (both in ``nodes``) and, where used, a positive ``weight``; parallel links are merged before. Every
round ends in a written table, so plans stay short and a lost executor costs one round. Nothing grows on the driver but round counts. Empty graphs give empty results.
Graphs that a task can hold are left to ``whole``, which gives the same rows.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofloom.operators import whole
from proofloom.operators.skew import number_within_keys
from proofloom.session import cut

DAMPING, ROUNDS = 0.85, 50


def _folded(seen: DataFrame, level: DataFrame, depth: int) -> DataFrame:
    """``seen`` with one more level; written as one table every eighth time, so that plans stay short however deep the search goes."""
    both = seen.union(level)
    return cut(both, "seen") if depth % 8 == 0 else both


def _placed(df: DataFrame, key: str) -> DataFrame:
    """``df`` hashed and sorted by ``key`` once and kept on the executors' disks: loops that join it round after round move only the other side. A lost executor's part is made again from
    the written table below. The caller gives it back with ``unpersist``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key).persist(StorageLevel.DISK_ONLY)


def both_ways(links: DataFrame) -> DataFrame:
    """Distinct undirected neighbours without loops, each pair in both directions."""
    pairs = links.where("src <> dst").select("src", "dst")
    return pairs.union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def traverse(nodes: DataFrame, links: DataFrame, roots: DataFrame, max_depth: int = 32, reverse: bool = False, form: str = "array") -> DataFrame:
    """Breadth first from every ``roots.id``: (root, node, depth, path, path_weight), the roots at depth 0.

    ``nodes`` needs ``name``. Among equally short paths a node gets the one whose names come first in order, which is the one a queue would find that
    takes neighbours by name; ``path`` holds the names, ``path_weight`` sums the weights along it. Cycles are safe. With the ``form`` "text" the names are one text with " > " between them,
    with "ends" the first and the last are ``root_name`` and ``name`` in place of ``path``.
    """
    held = whole.of(nodes.select("id", "name"), links.select("src", "dst", "weight"))
    if held:
        return whole.traverse(held, roots, max_depth, reverse, form)
    a, b = ("dst", "src") if reverse else ("src", "dst")
    named = nodes.select(F.col("id").alias("next"), F.col("name").alias("_next_name"))
    steps = cut(links.select(F.col(a).alias("node"), F.col(b).alias("next"), "weight").join(named, "next"), "steps")
    start = roots.select("id").join(nodes, "id").select(F.col("id").alias("root"), F.col("id").alias("node"), F.array("name").alias("path"), F.lit(0).cast("bigint").alias("path_weight"))
    level = cut(start.distinct(), "level")
    seen, out, depth = level.select("root", "node"), level.withColumn("depth", F.lit(0)), 0
    while depth < max_depth:
        reached = level.join(steps, "node").select("root", F.col("next").alias("node"), F.concat("path", F.array("_next_name")).alias("path"), (F.col("path_weight") + F.col("weight")).alias("path_weight"))
        best = reached.groupBy("root", "node").agg(F.min(F.struct("path", "path_weight")).alias("b"))
        fresh = best.join(seen, ["root", "node"], "left_anti").select("root", "node", "b.path", "b.path_weight")
        level = cut(fresh, "level")
        if level.isEmpty():
            break
        depth += 1
        out = out.union(level.withColumn("depth", F.lit(depth)))
        seen = _folded(seen, level.select("root", "node"), depth)
    path = {"ends": [F.element_at("path", 1).alias("root_name"), F.element_at("path", -1).alias("name")], "text": [F.array_join("path", " > ").alias("path")]}.get(form, ["path"])
    return out.select("root", "node", F.col("depth").cast("bigint").alias("depth"), *path, "path_weight")


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int = 32) -> DataFrame:
    """At most one row (nodes, layers, occurrences): the shortest way from ``source`` to ``target`` along ``edges`` (source, target, layer, occurrences), which may end outside the corpus.

    Among equally short ones the first whose names, then layers (statement before proof) come first; from a name to itself it is that name alone. The search ends with the level that reaches the target.
    """
    spark = edges.sparkSession
    steps = cut(edges.groupBy(F.col("source").alias("node"), F.col("target").alias("next")).agg(F.min(F.struct((F.col("layer") != "statement").alias("late"), "layer", "occurrences")).alias("e")).select("node", "next", "e.layer", "e.occurrences"), "steps")
    start = spark.createDataFrame([(source, [source], [], 0)], "node string, nodes array<string>, layers array<string>, occurrences bigint")
    if source == target:
        return start.drop("node")
    level, seen = cut(start, "level"), start.select("node")
    for _ in range(max_depth):
        further = level.select("node", "nodes", "layers", F.col("occurrences").alias("sum")).join(steps.hint("merge"), "node")
        reached = further.select(F.col("next").alias("node"), F.concat("nodes", F.array("next")).alias("nodes"), F.concat("layers", F.array("layer")).alias("layers"), (F.col("sum") + F.col("occurrences")).alias("occurrences"))
        best = reached.groupBy("node").agg(F.min(F.struct("nodes", "layers", "occurrences")).alias("b")).select("node", "b.*")
        level = cut(best.join(seen.hint("merge"), "node", "left_anti"), "level")
        found = level.where(F.col("node") == target)
        if level.isEmpty() or not found.isEmpty():
            return found.drop("node")
        seen = cut(seen.union(level.select("node")), "seen")
    return level.limit(0).drop("node")


def reachable(links: DataFrame, roots: DataFrame, max_depth: int = 32, reverse: bool = False) -> tuple[DataFrame, DataFrame]:
    """((root, node, depth) without the roots themselves, (root) of those cut off by ``max_depth``)."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = cut(links.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct(), "steps")
    level = cut(roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct(), "level")
    seen, out = level, level.withColumn("depth", F.lit(0)).limit(0)
    fresh = lambda: level.join(steps, "node").select("root", F.col("next").alias("node")).distinct().join(seen, ["root", "node"], "left_anti")
    for depth in range(1, max_depth + 1):
        level = cut(fresh(), "level")
        if level.isEmpty():
            break
        out = out.union(level.withColumn("depth", F.lit(depth)))
        seen = _folded(seen, level, depth)
    return out.select("root", "node", F.col("depth").cast("bigint").alias("depth")), fresh().select("root").distinct()


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """in_degree counts a link once per layer, out_degree counts targets; the weighted ones sum the weights. ``links`` needs ``layers``."""
    incoming = links.groupBy(F.col("dst").alias("id")).agg(F.sum("layers").alias("in_degree"), F.sum("weight").alias("weighted_in_degree"))
    outgoing = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"), F.sum("weight").alias("weighted_out_degree"))
    return nodes.join(incoming, "id", "left").join(outgoing, "id", "left").fillna(0, ["in_degree", "out_degree", "weighted_in_degree", "weighted_out_degree"])


def pagerank(nodes: DataFrame, links: DataFrame, weighted: bool = False, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(id, rank) after exactly ``rounds`` rounds from 1/n; the rank of nodes without links out is spread evenly. Ranks sum to 1."""
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    if not weighted or (links.agg(F.min("weight")).first()[0] or 1) > 0:
        held = whole.of(nodes.select("id"), links.select("src", "dst", *["weight"] * weighted))
        if held:
            return whole.pagerank(held, weighted, damping, rounds)
    share = F.col("weight").cast("double") if weighted else F.lit(1.0)
    totals = links.groupBy("src").agg(F.sum(share).alias("_total"))
    steps = cut(links.join(totals.hint("merge"), "src").select("src", "dst", (share / F.col("_total")).alias("share")), "steps")
    # a node without links out sends its rank to the row with id null, which everyone shares
    dangling = nodes.select("id").join(steps.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    steps = cut(steps.union(dangling.select(F.col("id").alias("src"), F.lit(None).cast("bigint").alias("dst"), F.lit(1.0).alias("share"))), "steps")
    ids, steps = _placed(cut(nodes.select("id"), "ids"), "id"), _placed(steps, "src")
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        sent = ranks.join(steps.hint("merge"), ranks["id"] == steps["src"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        got = cut(sent, "got")
        spread = got.where("id is null").agg(F.sum("got")).first()[0] or 0.0
        ranks = ids.join(got.hint("merge"), "id", "left").select("id", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.lit(spread / n))).alias("rank"))
    out = cut(ranks, "ranks")
    ids.unpersist()
    steps.unpersist()
    return out


def betweenness(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, betweenness): directed, unweighted, unnormalised, end points not counted. All sources advance level by level, then the dependencies flow back."""
    held = whole.of(nodes.select("id"), links.select("src", "dst"))
    if held:
        return whole.betweenness(held)
    steps = cut(links.where("src <> dst").select("src", "dst").distinct(), "steps")
    level = cut(nodes.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(1.0).alias("paths")), "level")
    levels, seen = [level], level.select("root", "node")
    while True:
        reached = level.join(steps, level["node"] == steps["src"]).groupBy("root", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = cut(reached.join(seen, ["root", "node"], "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = _folded(seen, level.select("root", "node"), len(levels))
    below, sums = None, []
    for k in range(len(levels) - 1, 0, -1):
        here = levels[k]
        if below is not None:
            here = here.join(below, ["root", "node"], "left").select("root", "node", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta"))
            sums.append(here.groupBy(F.col("node").alias("id")).agg(F.sum("delta").alias("delta")))
        else:
            here = here.withColumn("delta", F.lit(0.0))
        up = here.join(steps, here["node"] == steps["dst"]).select("root", F.col("src").alias("node"), ((1 + F.col("delta")) / F.col("paths")).alias("part"))
        before = levels[k - 1].select("root", "node", F.col("paths").alias("own"))
        below = cut(up.join(before, ["root", "node"]).groupBy("root", "node").agg(F.sum(F.col("part") * F.col("own")).alias("delta")), "delta")
    total = None
    for s in sums:
        total = s if total is None else total.union(s)
    if total is None:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    total = total.groupBy("id").agg(F.sum("delta").alias("betweenness"))
    return nodes.select("id").join(total, "id", "left").fillna(0.0, ["betweenness"])


def weak_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id of the undirected component. Labels take the neighbours' minimum, then jump to their label's label."""
    near = _placed(cut(both_ways(links), "near"), "dst")
    labels = cut(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        least = near.join(labels, near["dst"] == labels["id"]).groupBy(near["src"].alias("id")).agg(F.min("component").alias("least"))
        taken = cut(labels.join(least, "id", "left").select("id", "component", F.least("component", F.coalesce("least", "component")).alias("now")), "labels")
        if taken.where("now <> component").isEmpty():
            near.unpersist()
            return labels
        jump = taken.select(F.col("id").alias("now"), F.col("now").alias("further"))
        labels = cut(taken.join(jump, "now").select("id", F.col("further").alias("component")), "labels")


def strong_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id of the strongly connected component. Nodes on no cycle are trimmed off round by round; in the rest, the greatest id that
    reaches a node colours it, and a colour's root with all that reach it within the colour is a component."""
    left = cut(nodes.select("id"), "active")
    steps = cut(links.where("src <> dst").select("src", "dst").distinct(), "steps")
    done = None
    add = lambda rows: rows if done is None else done.union(rows)
    while not left.isEmpty():
        while True:
            ends = steps.select(F.col("src").alias("id")).distinct().join(steps.select(F.col("dst").alias("id")).distinct(), "id")
            single = cut(left.join(ends, "id", "left_anti"), "single")
            if single.isEmpty():
                break
            done = add(single.select("id", F.col("id").alias("mark")))
            left = cut(left.join(single, "id", "left_anti"), "active")
            steps = _inside(steps, left)
        if left.isEmpty():
            break
        colours = cut(left.select("id", F.col("id").alias("colour")), "colours")
        while True:
            sent = steps.join(colours, steps["src"] == colours["id"]).groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("sent"))
            now = cut(colours.join(sent, "id", "left").select("id", "colour", F.greatest("colour", F.coalesce("sent", "colour")).alias("now")), "colours")
            if now.where("now <> colour").isEmpty():
                break
            colours = now.select("id", F.col("now").alias("colour"))
        found = cut(colours.where("id = colour"), "found")
        level = found
        coloured = steps.join(colours.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst")
        same = cut(coloured.where("cs = cd").select("src", "dst"), "same")
        while True:
            back = same.join(level.select(F.col("id").alias("dst"), "colour"), "dst").select(F.col("src").alias("id"), "colour").distinct().join(found, "id", "left_anti")
            level = cut(back, "back")
            if level.isEmpty():
                break
            found = cut(found.union(level), "found")
        done = add(found.select("id", F.col("colour").alias("mark")))
        left = cut(left.join(found, "id", "left_anti"), "active")
        steps = _inside(steps, left)
    if done is None:
        return nodes.select("id", F.col("id").alias("component"))
    done = cut(done, "marks")
    return done.join(done.groupBy("mark").agg(F.min("id").alias("component")), "mark").select("id", "component")


def _inside(steps: DataFrame, left: DataFrame) -> DataFrame:
    return cut(steps.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"), "steps")


def label_propagation(nodes: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(id, label): synchronous, at most ``rounds`` rounds; the most frequent label among the neighbours, ties to the smallest; a node without neighbours keeps its own id."""
    held = whole.of(nodes.select("id"), links.select("src", "dst"))
    if held:
        return whole.label_propagation(held, rounds)
    near = _placed(cut(both_ways(links), "near"), "dst")
    labels = cut(nodes.select("id", F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        votes = near.join(labels, near["dst"] == labels["id"]).groupBy(near["src"].alias("id"), "label").agg(F.count(F.lit(1)).alias("votes"))
        best = votes.groupBy("id").agg(F.max(F.struct("votes", (-F.col("label")).alias("least"))).alias("b")).select("id", (-F.col("b.least")).alias("now"))
        changed = cut(labels.join(best, "id", "left").select("id", "label", F.coalesce("now", "label").alias("now")), "labels")
        labels = changed.select("id", F.col("now").alias("label"))
        if changed.where("now <> label").isEmpty():
            break
    near.unpersist()
    return labels


def communities(labels: DataFrame) -> DataFrame:
    """(id, community): labels renumbered from 0 in order."""
    numbers = number_within_keys(labels.select("label").distinct(), [], ["label"], "community").withColumn("community", F.col("community") - 1)
    return labels.join(numbers.hint("merge"), "label").select("id", "community")


def cut_structure(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articulation points: id; bridges: a, b with a < b) of the undirected graph.

    A breadth-first forest is numbered in preorder from subtree sizes; each subtree's lowest and highest neighbour numbers tell bridges, and
    joining tree edges that lie on a common cycle (an edge stands for its lower node) gives the blocks: a node with edges of several blocks is an articulation point.
    """
    near = cut(both_ways(links), "near")
    component = weak_components(nodes, links)
    level = cut(component.where("id = component").select("id", F.lit(None).cast("bigint").alias("parent"), F.lit(0).alias("depth")), "tree")
    levels, seen = [level], level.select("id")
    while True:
        reached = near.join(level.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        level = cut(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(len(levels))), "tree")
        if level.isEmpty():
            break
        levels.append(level)
        seen = _folded(seen, level.select("id"), len(levels))
    sizes: list[DataFrame] = [None] * len(levels)
    for k in range(len(levels) - 1, -1, -1):
        own = levels[k]
        if k + 1 < len(levels):
            kids = sizes[k + 1].groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("kids"))
            own = own.join(kids, "id", "left").select("id", "parent", (1 + F.coalesce("kids", F.lit(0))).cast("bigint").alias("size"))
        else:
            own = own.select("id", "parent", F.lit(1).cast("bigint").alias("size"))
        sizes[k] = cut(own, "sizes")
    # preorder: roots one after another by a running sum over the components, children after their parent in order of id
    numbered = [cut(number_within_keys(sizes[0], [], ["id"], "pre", amount="size"), "pre")]
    siblings = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(1, len(levels)):
        up = numbered[k - 1].select(F.col("id").alias("parent"), F.col("pre").alias("_up"))
        numbered.append(cut(sizes[k].withColumn("_before", F.coalesce(F.sum("size").over(siblings), F.lit(0))).join(up, "parent").select("id", "parent", "size", (F.col("_up") + 1 + F.col("_before")).alias("pre")), "pre"))
    tree = numbered[0].select("id", "parent", "size", "pre")
    for t in numbered[1:]:
        tree = tree.unionByName(t)
    tree = cut(tree, "forest")
    s, t = tree.select(F.col("id").alias("src"), F.col("parent").alias("sp"), F.col("pre").alias("spre"), F.col("size").alias("ssize")), tree.select(F.col("id").alias("dst"), F.col("parent").alias("dp"), F.col("pre").alias("dpre"))
    other = cut(near.join(s, "src").join(t, "dst").where("not (sp <=> dst) and not (dp <=> src)"), "nontree")
    far = other.groupBy(F.col("src").alias("id")).agg(F.min("dpre").alias("lo"), F.max("dpre").alias("hi"))
    ranges: list[DataFrame] = [None] * len(levels)
    for k in range(len(levels) - 1, -1, -1):
        own = numbered[k].join(far, "id", "left").select("id", "parent", "size", "pre", F.least("pre", F.coalesce("lo", "pre")).alias("lo"), F.greatest("pre", F.coalesce("hi", "pre")).alias("hi"))
        if k + 1 < len(levels):
            kids = ranges[k + 1].groupBy(F.col("parent").alias("id")).agg(F.min("lo").alias("klo"), F.max("hi").alias("khi"))
            own = own.join(kids, "id", "left").select("id", "parent", "size", "pre", F.least("lo", F.coalesce("klo", "lo")).alias("lo"), F.greatest("hi", F.coalesce("khi", "hi")).alias("hi"))
        ranges[k] = cut(own, "ranges")
    ranged = ranges[0]
    for r in ranges[1:]:
        ranged = ranged.unionByName(r)
    bridges = ranged.where("parent is not null and lo >= pre and hi < pre + size").select(F.least("id", "parent").alias("a"), F.greatest("id", "parent").alias("b"))
    apart = other.where("spre < dpre and spre + ssize <= dpre").select("src", "dst")
    up = tree.where("parent is not null").select(F.col("id").alias("parent"), F.col("pre").alias("ppre"), F.col("size").alias("psize"))
    joined = ranged.join(up, "parent").where("lo < ppre or hi >= ppre + psize").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    edges = tree.where("parent is not null")
    blocks = weak_components(edges.select("id"), cut(apart.union(joined), "blocks"))
    ends = edges.join(blocks, "id").select(F.explode(F.array("id", "parent")).alias("node"), "component")
    points = ends.groupBy("node").agg(F.countDistinct("component").alias("n")).where("n > 1").select(F.col("node").alias("id"))
    return points, bridges
