"""Counts, distributions, histograms and rankings over declarations and their expressions. Empty input: empty groups, counts 0, other figures null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = (10, 50, 100, 250, 500, 1000, 2500, 5000)
UNKNOWN = "<unknown>"


def module_rollup(edges: DataFrame) -> DataFrame:
    """Sum of occurrences by (source_module, target_module, layer); a null module is ``<unknown>``."""
    modules = [F.coalesce(c, F.lit(UNKNOWN)).alias(c) for c in ("source_module", "target_module")]
    return edges.groupBy(*modules, "layer").agg(F.sum("occurrences").alias("occurrences"))


def group_counts(declarations: DataFrame, column: str) -> DataFrame:
    return declarations.groupBy(F.coalesce(column, F.lit(UNKNOWN)).alias(column)).agg(F.count(F.lit(1)).alias("declarations"))


def summary(declarations: DataFrame, edges: DataFrame, expressions: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """One row. The filter's layer bears on edges only, not on sizes. ``symbols``: those that pass the filter, counted if given."""
    own = declarations.agg(
        F.count(F.lit(1)).alias("declarations"), F.count_if(F.col("kind") == "theorem").alias("theorems"), F.count_if(F.col("has_value")).alias("with_value"), F.count("start_line").alias("source_backed"), F.countDistinct("module_name").alias("modules"), F.count("generation_kind").alias("generated")
    )
    sized = expressions.join(declarations, "decl_id", "left_semi")
    sums = [F.sum(F.when(F.col("layer") == side, F.col(c))).alias(f"{side}_{n}") for side in ("statement", "proof") for c, n in (("total_occurrences", "occurrences"), ("unique_nodes", "unique_nodes"))]
    links = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if("target_in_corpus").alias("internal_edges"), F.sum("occurrences").alias("edge_occurrences"))
    # the three single rows are stacked, each null where another has its figures, and folded into one
    parts = [own, sized.agg(*sums), links] + ([symbols.agg(F.count(F.lit(1)).alias("symbols"))] if symbols is not None else [])
    names = [c for p in parts for c in p.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def distribution(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """count, min, max, mean, population stddev and quantiles (linear interpolation at q * (n - 1)) of the non-null values."""
    quantiles = F.percentile(column, F.array(*[F.lit(q / 100) for q in (50, 75, 90, 95, 99)]))
    rows = df.groupBy(*by).agg(F.count(column).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_pop(column), 6).alias("stddev"), quantiles.alias("_q"))
    return rows.select(*by, "count", "min", "max", "mean", "stddev", *[F.round(F.col("_q")[i], 6).alias(f"p{q}") for i, q in enumerate((50, 75, 90, 95, 99))])


def histogram(df: DataFrame, by: str, column: str, boundaries: tuple[int, ...] = BUCKETS) -> DataFrame:
    """Counts in (-inf, b0), [b0, b1), ..., [bk, inf) for each ``by``, buckets without values included; boundaries are sorted and made distinct. Nulls are in no bucket."""
    edges = sorted(set(boundaries))
    counts = [F.count_if((F.col(column) >= lo if lo is not None else F.col(column).isNotNull()) & (F.col(column) < hi if hi is not None else F.lit(True))) for lo, hi in zip([None, *edges], [*edges, None])]
    buckets = F.array(*[F.struct(F.lit(lo).cast("bigint").alias("lower"), F.lit(hi).cast("bigint").alias("upper"), n.alias("count")) for lo, hi, n in zip([None, *edges], [*edges, None], counts)])
    return df.groupBy(by).agg(buckets.alias("_b")).select(by, F.explode("_b").alias("_b")).select(by, "_b.lower", "_b.upper", "_b.count")


def breakdown(declarations: DataFrame, expressions: DataFrame) -> DataFrame:
    """Counts and both size distributions by kind, module and visibility in one pass."""
    sizes = expressions.groupBy("decl_id").agg(*[F.max(F.when(F.col("layer") == side, F.col("total_occurrences"))).alias(f"{side}_size") for side in ("statement", "proof")])
    dims = F.array(*[F.struct(F.lit(n).alias("dimension"), F.coalesce(c, F.lit(UNKNOWN)).alias("value")) for n, c in (("kind", "kind"), ("module", "module_name"), ("visibility", "visibility"))])
    rows = declarations.select("decl_id", dims.alias("g")).join(sizes, "decl_id", "left").select("*", F.explode("g").alias("x"))
    figures = [f for side in ("statement", "proof") for f in (F.round(F.avg(f"{side}_size"), 6).alias(f"{side}_mean"), F.max(f"{side}_size").alias(f"{side}_max"), F.round(F.percentile(f"{side}_size", F.lit(0.5)), 6).alias(f"{side}_median"))]
    return rows.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("declarations"), *figures)


def declaration_metrics(declarations: DataFrame, edges: DataFrame, expressions: DataFrame) -> DataFrame:
    """Per declaration and layer: sizes, compression (null for no nodes) and dependency counts."""
    deps = edges.groupBy(F.col("source_id").alias("decl_id"), "layer").agg(
        F.count_if("target_in_corpus").alias("internal_dependencies"), F.count_if(~F.col("target_in_corpus")).alias("external_dependencies"), F.countDistinct("target_module").alias("modules_referenced")
    )
    label = F.when(F.col("layer") == "statement", "statement").when(F.col("kind") == "theorem", "proof").otherwise("implementation")
    rows = expressions.join(declarations.select("decl_id", "name", "kind"), "decl_id").join(deps, ["decl_id", "layer"], "left").fillna(0, ["internal_dependencies", "external_dependencies", "modules_referenced"])
    ratio = F.round(F.try_divide("total_occurrences", "unique_nodes"), 6)
    return rows.select("name", "layer", label.alias("label"), "total_occurrences", "unique_nodes", ratio.alias("compression"), "distinct_constants", "internal_dependencies", "external_dependencies", "modules_referenced")


def export_metrics(declarations: DataFrame, expressions: DataFrame) -> DataFrame:
    """A row per declaration with the sizes of both its expressions, 0 where there is none. Depths are 0 where the corpus doesn't know them."""
    known = expressions if "max_depth" in expressions.columns else expressions.withColumn("max_depth", F.lit(0).cast("bigint"))
    figures = (("occurrences", "total_occurrences"), ("unique_nodes", "unique_nodes"), ("depth", "max_depth"), ("dependencies", "distinct_constants"))
    wide = known.groupBy("decl_id").agg(*[F.max(F.when(F.col("layer") == layer, F.col(c))).alias(f"{side}_{n}") for layer, side in (("statement", "statement"), ("proof", "value")) for n, c in figures])
    axioms = F.greatest(F.size(F.array_distinct(F.filter("axioms", lambda x: x.isNotNull()))), F.lit(0)).cast("bigint")
    rows = declarations.join(wide.hint("merge"), "decl_id", "left")
    return rows.select(
        "name", F.coalesce("module_name", F.lit("")).alias("module"), "kind", F.col("generation_kind").isNotNull().alias("generated"), F.col("start_line").isNotNull().alias("source_backed"),
        F.col("doc_string").isNotNull().alias("has_documentation"), F.coalesce(axioms, F.lit(0)).cast("bigint").alias("axiom_count"), *[F.coalesce(c, F.lit(0)).alias(c) for c in wide.columns if c != "decl_id"],
    )


def constant_frequencies(expressions: DataFrame) -> DataFrame:
    """Occurrences of each named constant per declaration and layer, with its place by (occurrences desc, name); null names are none, null occurrences 0."""
    c = expressions.select("decl_id", "layer", F.explode("constant_frequencies").alias("c")).where("c.name is not null")
    sums = c.groupBy("decl_id", "layer", F.col("c.name").alias("name")).agg(F.sum(F.coalesce("c.occurrences", F.lit(0))).alias("occurrences"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("decl_id", "layer").orderBy(F.desc("occurrences"), "name")).cast("bigint"))


def rank(declarations: DataFrame, edges: DataFrame | None, expressions: DataFrame, metric: str, limit: int) -> DataFrame:
    """The first ``limit`` declarations by (value desc, name), null values as 0. ``metric``: axioms, or statement-/proof-/value- with occurrences, unique-nodes, constants, dependencies or, where the expressions tell it, depth."""
    side, _, what = metric.replace("value-", "proof-").partition("-")
    columns = {"occurrences": "total_occurrences", "unique-nodes": "unique_nodes", "constants": "distinct_constants", "depth": "max_depth"}
    if metric == "axioms":
        values = declarations.select("decl_id", F.size(F.array_distinct(F.filter("axioms", lambda x: x.isNotNull()))).alias("value"))
        values = values.withColumn("value", F.when(F.col("value") > 0, F.col("value")).otherwise(0))
    elif side in ("statement", "proof") and what == "dependencies":
        values = edges.where(F.col("layer") == side).groupBy(F.col("source_id").alias("decl_id")).agg(F.count(F.lit(1)).alias("value"))
    elif side in ("statement", "proof") and what in columns and columns[what] in expressions.columns:
        values = expressions.where(F.col("layer") == side).select("decl_id", F.col(columns[what]).alias("value"))
    else:
        raise ValueError(f"unknown metric {metric!r}")
    rows = declarations.select("decl_id", "name").join(values, "decl_id", "left").select("name", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    top = rows.orderBy(F.desc("value"), "name").limit(limit)  # at most ``limit`` rows reach the window
    return top.select(F.row_number().over(Window.orderBy(F.desc("value"), "name")).cast("bigint").alias("rank"), "name", "value")


def neighbours(edges: DataFrame, own: str, other: str, limit: int) -> DataFrame:
    """Per ``own`` the edges in (``other``, layer) order up to ``limit``, with ``truncated`` where there are more."""
    ordered = Window.partitionBy(own).orderBy(other, "layer")
    counts = edges.groupBy(own).agg((F.count(F.lit(1)) > limit).alias("truncated"))
    placed = edges.select(own, other, "layer", "occurrences", F.row_number().over(ordered).cast("bigint").alias("place")).where(F.col("place") <= limit)
    return placed.join(counts, own)


def rollups(edges: DataFrame, own: str, other: str) -> DataFrame:
    """(``own``, rollup, value, occurrences): the occurrences of every ``own`` by module and by kind at the ``other`` end of its edges; unknown ones are ``<unknown>``."""
    by = F.explode(F.array(*[F.struct(F.lit(n).alias("by"), F.coalesce(f"{other}_{n}", F.lit(UNKNOWN)).alias("value")) for n in ("module", "kind")]))
    rows = edges.select(own, "occurrences", by.alias("g"))
    return rows.groupBy(own, F.col("g.by").alias("rollup"), F.col("g.value").alias("value")).agg(F.sum("occurrences").alias("occurrences"))


def dependents_counts(edges: DataFrame) -> DataFrame:
    """Per target, external ones too: distinct sources, edges, occurrences."""
    return edges.groupBy("target").agg(F.countDistinct("source").alias("direct_dependents"), F.count(F.lit(1)).alias("edges"), F.sum("occurrences").alias("occurrences"))


def search(declarations: DataFrame, edges: DataFrame, query: str, limit: int) -> DataFrame:
    """Visible declarations that hold the trimmed, lower-cased query in name or type, by (name match, direct dependents desc, name); limit between 1 and 50."""
    q = F.lit(query.strip().lower())
    dependents = edges.where("target_id is not null").groupBy(F.col("target_id").alias("decl_id")).agg(F.countDistinct("source_id").alias("direct_dependents"))
    rows = declarations.where(~F.col("hidden")).withColumn("name_match", F.contains(F.lower("name"), q)).where(F.col("name_match") | F.contains(F.lower(F.coalesce("type_text", F.lit(""))), q))
    rows = rows.join(dependents, "decl_id", "left").select("name", "name_match", F.coalesce("direct_dependents", F.lit(0)).alias("direct_dependents"))
    return rows.orderBy(F.desc("name_match"), F.desc("direct_dependents"), "name").limit(min(max(limit, 1), 50))


def export_nodes(declarations: DataFrame, expressions: DataFrame) -> DataFrame:
    size = lambda side, n: expressions.where(F.col("layer") == side).select("decl_id", F.col("total_occurrences").alias(n))
    rows = declarations.join(size("statement", "statement_occurrences"), "decl_id", "left").join(size("proof", "value_occurrences"), "decl_id", "left").fillna(0, ["statement_occurrences", "value_occurrences"])
    return rows.select(
        F.col("name").alias("id"), F.substring_index("name", ".", -1).alias("display_name"), F.col("module_name").alias("module"), "kind", F.col("generation_kind").isNotNull().alias("generated"),
        F.col("start_line").isNotNull().alias("source_backed"), "statement_occurrences", "value_occurrences",
    )
