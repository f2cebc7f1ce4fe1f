"""Equal and repeated expressions, by digests of their subtrees, and how alike declarations are. Input of the first: the rows of ``functions.dag.node_rows`` with a column ``declaration``; where
they have a ``layer``, groups keep to one. Digests have 128 bits, so equal ones stand for equal subtrees without a second look. Groups are never held in one row: ``members`` and ``locations`` list them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 1 << 14


def _layer(nodes: DataFrame) -> list[str]:
    return ["layer"] if "layer" in nodes.columns else []


def duplicates(nodes: DataFrame, mode: str = "exact", support: int = 2) -> DataFrame:
    """Whole expressions that ``support`` or more distinct declarations have: fingerprint, size, depth, declarations, occurrences, and the first of the declarations by name."""
    by = [*_layer(nodes), "fingerprint"]
    roots = nodes.where("is_root").withColumn("fingerprint", F.col(mode)).groupBy(*by, "declaration").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("depth").alias("depth"))
    groups = roots.groupBy(*by).agg(F.first("size").alias("size"), F.first("depth").alias("depth"), F.count(F.lit(1)).alias("declarations"), F.sum("n").alias("occurrences"), F.min("declaration").alias("first_declaration"))
    return groups.where(F.col("declarations") >= support)


def members(nodes: DataFrame, groups: DataFrame, mode: str = "exact") -> DataFrame:
    """(fingerprint, size, depth, declarations, occurrences, declaration) of the groups of ``duplicates``, a row per member."""
    by = [*_layer(nodes), "fingerprint"]
    roots = nodes.where("is_root").withColumn("fingerprint", F.col(mode)).select(*by, "declaration").distinct()
    return roots.join(groups.drop("first_declaration").hint("merge"), by)


def repeated(nodes: DataFrame, mode: str = "exact", minimum_size: int = 4, support: int = 2) -> DataFrame:
    """Subexpressions of at least ``minimum_size`` nodes in at least ``support`` declarations; occurrences sum the multiplicities."""
    by = [*_layer(nodes), "fingerprint"]
    per = nodes.where(F.col("size") >= minimum_size).withColumn("fingerprint", F.col(mode)).groupBy(*by, "declaration").agg(F.sum("multiplicity").alias("n"), F.first("size").alias("size"), F.first("depth").alias("depth"))
    groups = per.groupBy(*by).agg(F.first("size").alias("size"), F.first("depth").alias("depth"), F.count(F.lit(1)).alias("declarations"), F.sum("n").alias("occurrences"))
    return groups.where(F.col("declarations") >= support)


def locations(nodes: DataFrame, groups: DataFrame, mode: str = "exact", minimum_size: int = 4) -> DataFrame:
    """Where the groups of ``repeated`` are found: a row per group and node with the group's figures, declaration, node and how often the node occurs there."""
    by = [*_layer(nodes), "fingerprint"]
    rows = nodes.where(F.col("size") >= minimum_size).withColumn("fingerprint", F.col(mode)).select(*by, "declaration", F.col("node_id").alias("node"), F.col("multiplicity").alias("location_occurrences"))
    return groups.join(rows.hint("merge"), by)


def repeated_in(nodes: DataFrame, groups: DataFrame, declaration: str, mode: str = "exact", minimum_size: int = 4) -> DataFrame:
    """The groups of ``repeated`` that hold a part of ``declaration``."""
    by = [*_layer(nodes), "fingerprint"]
    own = nodes.where((F.col("size") >= minimum_size) & (F.col("declaration") == declaration)).withColumn("fingerprint", F.col(mode)).select(*by).distinct()
    return groups.join(own.hint("merge"), by, "left_semi")


def repeated_by_declaration(nodes: DataFrame, groups: DataFrame, mode: str = "exact", minimum_size: int = 4) -> DataFrame:
    """Per declaration the repeated subexpressions it holds and the size of the largest."""
    own = nodes.where(F.col("size") >= minimum_size).select(F.col(mode).alias("fingerprint"), "declaration", "size").distinct()
    return own.join(groups.select("fingerprint").distinct().hint("merge"), "fingerprint", "left_semi").groupBy("declaration").agg(F.count(F.lit(1)).alias("groups"), F.max("size").alias("largest"))


def compare(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Similarity of the declarations of each pair (comparison_id, left_name, right_name, layer).

    ``features``: name, layer, deps (distinct names), unique_nodes, total_occurrences. Jaccard of the dependencies, size ratio of the unique nodes and occurrence ratio, and their mean; both
    empty counts as 1. Pairs of which a side has no features are left out.
    """
    left = features.select(F.col("name").alias("left_name"), "layer", *[F.col(c).alias(f"l_{c}") for c in ("deps", "unique_nodes", "total_occurrences")])
    right = features.select(F.col("name").alias("right_name"), "layer", *[F.col(c).alias(f"r_{c}") for c in ("deps", "unique_nodes", "total_occurrences")])
    both = pairs.join(left.hint("merge"), ["left_name", "layer"]).join(right.hint("merge"), ["right_name", "layer"])
    shared, union = F.size(F.array_intersect("l_deps", "r_deps")), F.size(F.array_union("l_deps", "r_deps"))
    jaccard = F.when(union > 0, shared / union).otherwise(F.lit(1.0))
    ratio = lambda c: F.when(F.greatest(f"l_{c}", f"r_{c}") > 0, F.least(f"l_{c}", f"r_{c}") / F.greatest(f"l_{c}", f"r_{c}")).otherwise(F.lit(1.0))
    rows = both.select(
        "comparison_id", "left_name", "right_name", "layer", shared.cast("bigint").alias("shared"), (F.size("l_deps") - shared).cast("bigint").alias("left_only"), (F.size("r_deps") - shared).cast("bigint").alias("right_only"),
        jaccard.alias("j"), ratio("unique_nodes").alias("s"), ratio("total_occurrences").alias("o"),
    )
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return rows.select(*rows.columns[:7], r6(F.col("j"), "dependency_jaccard"), r6(F.col("s"), "size_ratio"), r6(F.col("o"), "occurrence_ratio"), r6((F.col("j") + F.col("s") + F.col("o")) / 3, "combined_score"))


COMPONENTS = ("dependency_jaccard", "kind_histogram_cosine", "size_ratio", "depth_ratio")


def _alike() -> dict[str, Column]:
    """The four components of two sides' columns, prefixed l_ and r_; what is empty on both sides counts as 1."""
    shared, union = F.size(F.array_intersect("l_deps", "r_deps")), F.size(F.array_union("l_deps", "r_deps"))
    dot = lambda x, y: F.expr(f"aggregate(map_keys({x}), 0D, (s, k) -> s + {x}[k] * coalesce({y}[k], 0))")
    norm = F.sqrt(dot("l_kinds", "l_kinds") * dot("r_kinds", "r_kinds"))
    ratio = lambda c: F.coalesce(F.try_divide(F.least(f"l_{c}", f"r_{c}"), F.greatest(f"l_{c}", f"r_{c}")), F.lit(1.0))
    return dict(zip(COMPONENTS, (F.when(union > 0, shared / union).otherwise(F.lit(1.0)), F.coalesce(F.try_divide(dot("l_kinds", "r_kinds"), norm), F.lit(1.0)), ratio("nodes"), ratio("depth"))))


def _sides(features: DataFrame, prefix: str, name: str) -> DataFrame:
    return features.select(F.col("name").alias(name), "layer", *[F.col(c).alias(f"{prefix}_{c}") for c in ("exact", "alpha", "depth", "nodes", "kinds", "deps")])


def _report(both: DataFrame, keys: list[str]) -> DataFrame:
    parts = both.select("*", *[c.alias(n) for n, c in _alike().items()], (F.col("l_exact") == F.col("r_exact")).alias("exact_equal"), (F.col("l_alpha") == F.col("r_alpha")).alias("alpha_equivalent"))
    combined = sum((F.col(c) for c in COMPONENTS), F.lit(0.0)) / len(COMPONENTS)
    claim = F.when(F.col("exact_equal"), "complete expressions are exactly equal").when(F.col("alpha_equivalent"), "expressions are equal up to the names of binders").otherwise("expressions are no structural duplicates")
    percent = lambda text, c: F.format_string(f"{text}: %.1f%%", F.col(c) * 100)
    told = F.array(claim, percent("dependency overlap", COMPONENTS[0]), percent("expression-kind similarity", COMPONENTS[1]), percent("size ratio", COMPONENTS[2]), percent("depth ratio", COMPONENTS[3]))
    lists = [F.array_sort(F.array_intersect("l_deps", "r_deps")).alias("shared_dependencies"), F.array_sort(F.array_except("l_deps", "r_deps")).alias("left_only_dependencies"), F.array_sort(F.array_except("r_deps", "l_deps")).alias("right_only_dependencies")]
    return parts.select(*keys, "exact_equal", "alpha_equivalent", *[F.round(c, 6).alias(c) for c in COMPONENTS], F.round(combined, 6).alias("combined_score"), *lists, told.alias("explanation"))


def compare_graphs(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """The full comparison of declarations that have expression graphs, as those of a snapshot.

    ``pairs``: left_name, right_name, layer. ``features``: name, layer, exact and alpha (digests of the whole), depth, nodes, kinds (unique nodes by kind), deps (distinct names). Exact equality, equality up to binder
    names, Jaccard of the dependencies, cosine of the unique nodes' kinds, ratios of unique nodes and of depth, the mean of these four, the dependencies of both and of either, and an explanation. Pairs of
    which a side has no graph are left out.
    """
    both = pairs.select("left_name", "right_name", "layer").join(_sides(features, "l", "left_name").hint("merge"), ["left_name", "layer"]).join(_sides(features, "r", "right_name").hint("merge"), ["right_name", "layer"])
    return _report(both, ["left_name", "right_name", "layer"])


def _best(asked: DataFrame, rows: DataFrame, score: Column, keys: list[str], top: int, block_rows: int) -> DataFrame:
    """The ``top`` rows for every query by (score desc, name). The stated queries meet all rows block by block; each block keeps its best before the shuffle, so a query never has more than ``top`` rows from a block."""
    blocks = max(1, -(-rows.count() // block_rows))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = asked.join(rows.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).hint("merge"), [*keys, "block"]).where("query <> name")
    scored = met.withColumn("score", score)
    order = [F.desc("score"), F.col("name")]
    best = scored.withColumn("k", F.row_number().over(Window.partitionBy("query", *keys, "block").orderBy(*order))).where(F.col("k") <= top)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query", *keys).orderBy(*order)).cast("bigint")).where(F.col("place") <= top)


def neighbours(features: DataFrame, queries: DataFrame, top: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``top`` most similar rows of ``features`` (name, deps, unique_nodes) for every query name, by the mean of Jaccard and size ratio, ties by name."""
    asked = features.join(queries.hint("merge"), "name", "left_semi").select(F.col("name").alias("query"), F.col("deps").alias("qd"), F.col("unique_nodes").alias("qu"))
    shared, union = F.size(F.array_intersect("qd", "deps")), F.size(F.array_union("qd", "deps"))
    jaccard = F.when(union > 0, shared / union).otherwise(F.lit(1.0))
    ratio = F.when(F.greatest("qu", "unique_nodes") > 0, F.least("qu", "unique_nodes") / F.greatest("qu", "unique_nodes")).otherwise(F.lit(1.0))
    return _best(asked, features, F.round((jaccard + ratio) / 2, 6), [], top, block_rows).select("query", "name", "score", "place")


def graph_neighbours(features: DataFrame, queries: DataFrame, top: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``top`` declarations most like every query name within its layer, by the combined score of ``compare_graphs``, ties by name, with the whole comparison (the query on the left)."""
    asked = _sides(features.join(queries.select("name").hint("merge"), "name", "left_semi"), "l", "query")
    rows = _sides(features, "r", "name")
    combined = sum(_alike().values(), F.lit(0.0)) / len(COMPONENTS)
    placed = _best(asked, rows, combined, ["layer"], top, block_rows)
    return _report(placed, ["query", "name", "layer", "place"])
