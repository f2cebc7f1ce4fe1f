"""Constraints on a corpus, as rows (rule, subject, detail); nothing raises until ``require`` is asked to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_KINDS = ("boundVariable", "freeVariable", "metavariable", "sort", "constant", "application", "lambda", "forall", "let", "literal", "metadata", "projection")


def _rows(df: DataFrame, rule: str, subject: str, detail: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.expr(f"cast({subject} as string)").alias("subject"), F.expr(f"cast({detail} as string)").alias("detail"))


def graph_shape(graphs: DataFrame, subject: str) -> DataFrame:
    """``graphs``: subject, root, nodes. Not empty; the root is one of the nodes; ids are 0, 1, ... in order; children come before their parents."""
    checks = [
        ("graph is empty", "coalesce(size(nodes), 0) <= 0"),
        ("root out of bounds", "size(nodes) > 0 and (root is null or root < 0 or root >= size(nodes))"),
        ("id differs from position", "exists(transform(nodes, (n, i) -> n.id is null or n.id <> i), x -> x)"),
        ("child does not precede its node", "exists(nodes, n -> exists(coalesce(n.children, array()), c -> c is null or c < 0 or c >= n.id))"),
    ]
    found = F.explode(F.expr("filter(array(" + ", ".join(f"if({test}, '{rule}', null)" for rule, test in checks) + "), x -> x is not null)"))
    return graphs.select(subject, found.alias("rule")).select("rule", F.col(subject).cast("string").alias("subject"), F.lit(None).cast("string").alias("detail"))


def step_rules(outlines: DataFrame) -> DataFrame:
    """``outlines``: outline_id, complete, truncation_reason, conclusion_step, raw_steps and, where there are any, named_results. One row per broken rule and outline; null steps count as none."""
    s = "filter(coalesce(raw_steps, array()), x -> x is not null)"
    ctx = "filter(coalesce(x.context, array()), c -> c is not null)"
    pre = "coalesce(x.prerequisite_steps, array())"
    first = lambda a, b: f"slice({a}, 1, least(size({a}), size({b}))) <> slice({b}, 1, least(size({a}), size({b})))"
    scope = f"coalesce(filter({s}, y -> y.id = p)[0].scope, array())"
    checks = [
        ("complete exactly without a reason", "complete is not null and complete <> (truncation_reason is null)"),
        ("step listed twice", f"size({s}) <> size(array_distinct(transform({s}, x -> x.id)))"),
        ("step ids are not 0, 1, ... in order", f"exists(transform({s}, (x, i) -> x.id is null or x.id <> i), x -> x)"),
        ("two steps at one place of the term", f"size({s}) <> size(array_distinct(transform({s}, x -> x.proof_term_path)))"),
        ("context id listed twice", f"exists({s}, x -> size({ctx}) <> size(array_distinct(transform({ctx}, c -> c.id))))"),
        ("scope differs from the context", f"exists({s}, x -> coalesce(x.scope, array()) <> transform({ctx}, c -> c.id))"),
        ("prerequisite does not precede its step", f"exists({s}, x -> exists({pre}, p -> p is null or p >= x.id))"),
        ("prerequisite listed twice", f"exists({s}, x -> size({pre}) <> size(array_distinct({pre})))"),
        ("prerequisite in a scope apart", f"exists({s}, x -> exists({pre}, p -> exists({s}, y -> y.id = p) and {first('coalesce(x.scope, array())', scope)}))"),
        ("hypothesis is no assumption of the context", f"exists({s}, x -> exists(coalesce(x.hypothesis_references, array()), h -> h is not null and not exists({ctx}, c -> c.id = h and c.kind = 'assumption')))"),
        ("conclusion names no step of that kind", f"conclusion_step is not null and not exists({s}, x -> x.id = conclusion_step and x.kind = 'conclusion')"),
        ("complete without a conclusion", f"complete and size({s}) > 0 and conclusion_step is null"),
    ]
    if "named_results" in outlines.columns:
        names = "transform(coalesce(named_results, array()), r -> r.name)"
        checks += [
            ("named result listed twice", f"size({names}) <> size(array_distinct({names}))"),
            ("named reference without a result", f"exists({s}, x -> exists(coalesce(x.named_references, array()), n -> n is not null and not array_contains({names}, n)))"),
        ]
    tests = ", ".join(f"if({test}, '{rule}', null)" for rule, test in checks)
    found = F.explode(F.expr(f"filter(array({tests}), x -> x is not null)"))
    return outlines.select("outline_id", found.alias("rule")).select("rule", F.col("outline_id").cast("string").alias("subject"), F.lit(None).cast("string").alias("detail"))


def declaration_rules(corpus) -> DataFrame:
    """Of a ``SnapshotCorpus``: graphs of a right shape; the occurrences in either graph equal its statistics and its constants the listed dependencies; value, statistics and hasValue agree; proof steps only where
    there is a value; every declaration is a symbol and every dependency too."""
    d = corpus.declared
    shape = graph_shape(corpus.graphs.join(d.select("decl_id", "name").hint("merge"), "decl_id").select(F.concat_ws("/", "name", "layer").alias("graph"), "root", "nodes"), "graph")
    sides = F.explode(F.array(F.struct(F.lit("statement").alias("layer"), F.col("typeStats.nodes").alias("nodes"), F.col("statementDependencies").alias("listed")), F.struct(F.lit("proof").alias("layer"), F.col("valueStats.nodes").alias("nodes"), F.col("proofDependencies").alias("listed"))))
    told = d.select("decl_id", "name", sides.alias("s")).select("decl_id", "name", "s.*")
    own = corpus.expressions.select("decl_id", "layer", "total_occurrences", F.array_sort(F.transform("constant_frequencies", lambda c: c["name"])).alias("constants"))
    both = told.join(own.hint("merge"), ["decl_id", "layer"])
    listed = F.array_sort(F.array_distinct(F.coalesce("listed", F.array().cast("array<string>"))))
    named = corpus.symbols.select("name")
    used = d.select("name", F.explode(F.concat(F.coalesce("statementDependencies", F.array().cast("array<string>")), F.coalesce("proofDependencies", F.array().cast("array<string>")))).alias("target")).where("target is not null").distinct()
    parts = [
        shape,
        _rows(both.where("nodes is not null and total_occurrences <> nodes"), "occurrences differ from the statistics", "name", "layer"),
        _rows(both.where(~listed.eqNullSafe(F.col("constants"))), "dependencies differ from the graph's constants", "name", "layer"),
        _rows(d.where("(valueGraph is null) <> (valueStats is null)"), "value graph without statistics or the other way round", "name", "null"),
        _rows(d.where("coalesce(hasValue, false) <> (valueGraph is not null)"), "hasValue differs from the value graph", "name", "null"),
        _rows(d.where("proofSteps is not null and not coalesce(hasValue, false)"), "proof steps without a value", "name", "null"),
        _rows(d.join(named.hint("merge"), "name", "left_anti"), "declaration is no symbol", "name", "null"),
        _rows(used.join(named.select(F.col("name").alias("target")).hint("merge"), "target", "left_anti"), "dependency is no symbol", "name", "target"),
        _rows(corpus.known.groupBy("snapshot", "name").count().where("count > 1"), "symbol name occurs twice", "name", "count"),
        step_rules(corpus.outlines),
    ]
    return reduce(lambda a, b: a.union(b), parts)


def corpus_rules(declarations: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Unique names, known edge targets, positive occurrences, known sources."""
    twice = lambda df, rule: _rows(df.groupBy("name").count().where("count > 1"), rule, "name", "count")
    names = symbols.select(F.col("name").alias("target")).distinct()
    parts = [
        twice(declarations, "declaration name occurs twice"),
        twice(symbols, "symbol name occurs twice"),
        _rows(edges.groupBy("target").count().join(names, "target", "left_anti"), "dependency is no symbol", "target", "count"),
        _rows(edges.where("occurrences is null or occurrences <= 0"), "edge without occurrences", "source", "target"),
        _rows(edges.join(declarations.select(F.col("decl_id").alias("source_id")), "source_id", "left_anti"), "edge without its declaration", "source_id", "target"),
        _rows(declarations.where("name is null or kind is null"), "declaration without name or kind", "decl_id", "null"),
    ]
    return reduce(lambda a, b: a.union(b), parts)


def require(violations: DataFrame) -> None:
    """Raise ValueError with the first violations, if there are any."""
    first = violations.limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{r.rule}: {r.subject}" for r in first))
