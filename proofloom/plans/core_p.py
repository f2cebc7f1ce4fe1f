"""Queries for hot keys (2) and nested records (3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofloom.operators import nested
from proofloom.operators.skew import key_statistics
from proofloom.sources.tables import latest, table

HOT_SHARE = 0.02


def distinct_edges(spark: SparkSession, directory: str) -> DataFrame:
    """Distinct (source_id, target, layer) with target and flag known; is_instance is 0 or 1."""
    edges = table(spark, directory, "dependency_edges").where("target is not null and target_is_instance is not null")
    kept = latest(edges, ["source_id", "target", "layer"], keep=["target_is_instance", "occurrences"])
    return kept.withColumn("is_instance", F.col("target_is_instance").cast("bigint")).drop("target_is_instance")


def p2_targets(spark: SparkSession, directory: str) -> DataFrame:
    """Edges, occurrences and distinct sources of every (is_instance, target)."""
    return key_statistics(distinct_edges(spark, directory), ["is_instance", "target"], "source_id", "occurrences", ("edges", "occurrences", "sources"))


def p2_flags(spark: SparkSession, directory: str) -> DataFrame:
    """Edges, occurrences and distinct sources of either value of the flag."""
    return key_statistics(distinct_edges(spark, directory), ["is_instance"], "source_id", "occurrences", ("edges", "occurrences", "sources"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Targets with at least ``HOT_SHARE`` of the edges of their flag. The flags' totals add up the per-target results, two rows."""
    per_target = p2_targets(spark, directory)
    totals = per_target.groupBy("is_instance").agg(F.sum("edges").alias("all_edges"))
    found = per_target.join(F.broadcast(totals), "is_instance").where(F.col("edges") >= HOT_SHARE * F.col("all_edges"))
    return found.select("is_instance", "target")


RENAMED = {"type_text": "type", "value_text": "value", "var_index": "index"}
IDS = {"raw_steps": "id", "context": "id", "nodes": "id"}


def outlines(spark: SparkSession, directory: str, paths: list[str], once: bool = True, extra: list[str] | None = None) -> DataFrame:
    """outline_id, the columns ``extra`` of an outline and the part of raw_steps that ``paths`` reach, of proof_outlines and the whole payloads of raw_outlines.

    ``once``: one row per outline, the last sent; a payload that isn't whole never stands in for a whole one.
    """
    schema = spark.read.parquet(f"{directory}/proof_outlines.parquet").schema
    steps = T.StructType([schema[c] for c in extra or []] + nested.prune(T.StructType([schema["raw_steps"]]), paths).fields)
    typed = spark.read.schema(T.StructType([schema["outline_id"], *steps.fields, schema["received_at"]])).parquet(f"{directory}/proof_outlines.parquet")
    payloads = table(spark, directory, "raw_outlines").select("outline_id", "payload", "received_at")
    raw = nested.conform(payloads, "payload", steps, "_doc", RENAMED).where("_doc is not null")
    raw = raw.select("outline_id", *[F.col(f"_doc.{f.name}").alias(f.name) for f in steps.fields], "received_at")
    both = typed.unionByName(raw)
    return latest(both, ["outline_id"]) if once else both


def _flat(spark: SparkSession, directory: str, name: str, paths: list[str], once: bool = True, refers: dict | None = None) -> DataFrame:
    """Table ``name`` of the records. Which tables there are follows from the whole type of the records; the scan reads only what ``paths`` name, and of the table so much is filled."""
    rows = outlines(spark, directory, paths, once).drop("received_at")
    whole = spark.read.parquet(f"{directory}/proof_outlines.parquet").schema
    tables = nested.inline_schema(T.StructType([whole["outline_id"], whole["raw_steps"]]), "outline", ["outline_id"])
    return nested.flatten(rows, nested.keep_known(tables, rows.schema), name, ["outline_id"], IDS, refers)


def p3_steps(spark: SparkSession, directory: str) -> DataFrame:
    """One row per step of every outline."""
    return _flat(spark, directory, "raw_steps", ["raw_steps.id", "raw_steps.kind", "raw_steps.proposition"]).drop("place")


def p3_contexts(spark: SparkSession, directory: str) -> DataFrame:
    """One row per context entry, with its step."""
    paths = [f"raw_steps.context.{f}" for f in ("id", "user_name", "kind", "binder_info", "type_text", "value_text")]
    return _flat(spark, directory, "context", ["raw_steps.id", *paths]).drop("place")


def p3_graphs(spark: SparkSession, directory: str) -> DataFrame:
    """One row per graph, the shared table of proposition_graph and type_graph."""
    return _flat(spark, directory, "graph", ["raw_steps.id", "raw_steps.context.id", "raw_steps.proposition_graph", "raw_steps.context.type_graph"])


def p3_nodes(spark: SparkSession, directory: str) -> DataFrame:
    """One row per node of either kind of graph."""
    return _flat(spark, directory, "nodes", ["raw_steps.id", "raw_steps.context.id", "raw_steps.proposition_graph", "raw_steps.context.type_graph"])


def p3_payloads(spark: SparkSession, directory: str) -> DataFrame:
    """How many payloads of raw_outlines are whole, null, blank or broken; copies sent again count each."""
    schema = spark.read.parquet(f"{directory}/proof_outlines.parquet").schema
    payloads = table(spark, directory, "raw_outlines").select("payload")
    return nested.states(nested.conform(payloads, "payload", nested.prune(T.StructType([schema["raw_steps"]]), ["raw_steps.id"]), "_doc", RENAMED), "payload", "_doc")


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Distinct links of nodes to existing nodes in the type_graph of a context entry.

    Resent outlines, steps and nodes fall together in the final distinct, which moves only the links' ids.
    """
    paths = ["raw_steps.id", "raw_steps.context.id", "raw_steps.context.type_graph.nodes.id", "raw_steps.context.type_graph.nodes.children"]
    links = _flat(spark, directory, "children", paths, once=False, refers={"children": ("nodes", "id")})
    return (
        links.where("refers")
        .select(
            "outline_id", F.col("raw_steps_id").alias("step_id"), "context_id", F.col("nodes_id").alias("parent_node"),
            F.col("children_pos").alias("child_pos"), F.col("value").alias("child_node"),
        )
        .distinct()
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_targets, p2_flags, p3_found, p3_steps, p3_contexts, p3_graphs, p3_nodes, p3_payloads)}
