"""Snapshots: one JSON document with declarations, symbols and their expression graphs, schema version 6."""

from __future__ import annotations

import json
import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 6
_NODE = "struct<id:bigint,kind:string,children:array<bigint>,name:string,index:bigint,value:string,binderInfo:string,universeLevels:array<string>>"
_NODES = "array<struct<id:bigint,kind:string,children:array<bigint>,name:string,var_index:bigint,value_text:string,binder_info:string,universe_levels:array<string>>>"  # the same fields as ``functions.dag`` names them
_GRAPH = f"struct<root:bigint,nodes:array<{_NODE}>>"
_STATS = "struct<" + ",".join(f"{n}:bigint" for n in "nodes maxDepth boundVariables freeVariables metavariables sorts constants applications lambdas foralls lets literals metadata projections".split()) + ">"
_POSITION = "struct<line:bigint,column:bigint>"
_CONTEXT = f"struct<id:string,userName:string,kind:string,binderInfo:string,type:string,typeGraph:{_GRAPH},value:string>"
_STEP = (
    f"struct<id:bigint,kind:string,proposition:string,propositionGraph:{_GRAPH},context:array<{_CONTEXT}>,scope:array<string>,proofTermPath:array<bigint>,"
    "prerequisiteSteps:array<bigint>,hypothesisReferences:array<string>,namedReferences:array<string>>"
)
_STEPS = f"struct<complete:boolean,truncationReason:string,visitedTerms:bigint,conclusionStep:bigint,steps:array<{_STEP}>,namedResults:array<struct<name:string,kind:string,moduleName:string,type:string,typeGraph:{_GRAPH}>>>"
_FLAGS = "isInternal:boolean,isPrivate:boolean,isUnsafe:boolean,isPartial:boolean"
_DECLARATION = (
    f"struct<name:string,kind:string,moduleName:string,generationKind:string,{_FLAGS},docString:string,sourceRange:struct<start:{_POSITION},end:{_POSITION}>,levelParameters:array<string>,type:string,hasValue:boolean,"
    f"typeStats:{_STATS},valueStats:{_STATS},typeGraph:{_GRAPH},valueGraph:{_GRAPH},statementDependencies:array<string>,proofDependencies:array<string>,axioms:array<string>,proofSteps:{_STEPS}>"
)
_SYMBOL = f"struct<name:string,kind:string,moduleName:string,generationKind:string,{_FLAGS},isClass:boolean,isInstance:boolean,isProjection:boolean>"
SNAPSHOT = f"schemaVersion bigint, leanVersion string, importedModules array<string>, declarations array<{_DECLARATION}>, symbols array<{_SYMBOL}>"


def load_snapshots(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The documents at ``paths`` (each once), a row each, with the explicit schema and ``snapshot``, their place in the given order. Raises ValueError for blank or missing paths, another version or no modules;
    warns where no declaration is found. A document is read by one task; see ``split_snapshot`` for large ones."""
    paths = list(dict.fromkeys(paths))
    if not paths or any(not p.strip() for p in paths):
        raise ValueError("name at least one snapshot, and no blank path")
    rows = reduce(lambda a, b: a.unionByName(b), [spark.read.schema(SNAPSHOT).json(p, multiLine=True).withColumn("snapshot", F.lit(i)) for i, p in enumerate(paths)])
    bad = rows.where(f"schemaVersion is null or schemaVersion <> {SCHEMA_VERSION} or coalesce(size(importedModules), 0) <= 0").select("schemaVersion").head(1)
    if bad:
        raise ValueError(f"schema version must be {SCHEMA_VERSION} with at least one module, found version {bad[0][0]}")
    if rows.where("size(declarations) > 0").isEmpty():
        logging.getLogger("proofloom").warning("the snapshots hold no declarations")
    return rows


def split_snapshot(path: str, folder: str, lines: int = 100_000) -> None:
    """Write the document at the local ``path`` as JSON lines below ``folder`` (header.json, declarations/, symbols/), files of ``lines`` lines, which ``load_lines`` reads with one task a piece."""
    import os

    with open(path, encoding="utf-8") as f:
        document = json.load(f)
    for part in ("declarations", "symbols"):
        os.makedirs(f"{folder}/{part}", exist_ok=True)
        rows = document.pop(part, None) or []
        for k in range(0, max(len(rows), 1), lines):
            with open(f"{folder}/{part}/{k // lines:06d}.json", "w", encoding="utf-8") as out:
                out.writelines(json.dumps({"decl_id": k + i} | r if part == "declarations" else r) + "\n" for i, r in enumerate(rows[k : k + lines]))
    with open(f"{folder}/header.json", "w", encoding="utf-8") as out:
        json.dump(document, out)


def load_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(declarations with decl_id, symbols) of a folder that ``split_snapshot`` wrote."""
    declared = T.StructType([T.StructField("decl_id", T.LongType()), *T.DataType.fromDDL(_DECLARATION).fields])
    read = lambda schema, part: spark.read.schema(schema).json(f"{folder}/{part}").withColumn("snapshot", F.lit(0))
    return read(declared, "declarations"), read(T.DataType.fromDDL(_SYMBOL), "symbols")


def declarations(snapshots: DataFrame) -> DataFrame:
    """One row per declaration with its ``snapshot``; decl_id runs on from one document to the next, so it is unique over all."""
    held = snapshots.select("snapshot", F.coalesce(F.greatest(F.size("declarations"), F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
    before = Window.orderBy("snapshot").rowsBetween(Window.unboundedPreceding, -1)  # a row per document
    first = held.select("snapshot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = snapshots.select("snapshot", F.posexplode("declarations").alias("_at", "d")).join(F.broadcast(first), "snapshot")
    return rows.select((F.col("first") + F.col("_at")).cast("bigint").alias("decl_id"), "snapshot", "d.*")


def symbols(snapshots: DataFrame) -> DataFrame:
    """One row per symbol and snapshot."""
    return snapshots.select("snapshot", F.explode("symbols").alias("s")).select("s.*", "snapshot")


def graphs_of(declared: DataFrame) -> DataFrame:
    """decl_id, layer, root, nodes of ``declarations``: the statement graph and, where there is a value, the proof graph, fields named as ``functions.dag`` has them."""
    d = declared.select("decl_id", F.explode(F.array(F.struct(F.lit("statement").alias("layer"), F.col("typeGraph").alias("g")), F.struct(F.lit("proof").alias("layer"), F.col("valueGraph").alias("g")))).alias("x"))
    return d.where("x.g is not null").select("decl_id", "x.layer", "x.g.root", F.col("x.g.nodes").cast(_NODES).alias("nodes"))


def graphs(snapshots: DataFrame) -> DataFrame:
    return graphs_of(declarations(snapshots))


def compare(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """``operators.structure.compare_graphs`` of the declarations of ``pairs`` (left_name, right_name, layer)."""
    from proofloom.operators import structure
    from proofloom.plans.corpus import SnapshotCorpus

    return structure.compare_graphs(pairs, SnapshotCorpus.of(snapshots).features)


def merge_snapshots(parts: list[DataFrame]) -> DataFrame:
    """The documents of several loads in one frame. Raises ValueError if two declare the same name or were made by different versions; a symbol that several have counts once, as the first has it (``merge_symbols``)."""
    numbered, shift = [], 0
    for p in parts:
        numbered.append(p.withColumn("snapshot", F.col("snapshot") + F.lit(shift)))
        shift += p.count()  # documents
    merged = reduce(lambda a, b: a.unionByName(b), numbered)
    if merged.select("schemaVersion", "leanVersion").distinct().count() > 1:
        raise ValueError("snapshots of different versions")
    merge_declarations([declarations(merged)])
    return merged


def merge_symbols(parts: list[DataFrame]) -> DataFrame:
    """The union of ``parts`` with the first part's row for a name that several have; ``snapshot`` tells which part. Null names are dropped."""
    marked = reduce(lambda a, b: a.unionByName(b), [p.where("name is not null").withColumn("snapshot", F.lit(i)) for i, p in enumerate(parts)])
    columns = [c for c in marked.columns if c not in ("name", "snapshot")]
    best = marked.groupBy("name").agg(F.min(F.struct("snapshot", *columns)).alias("b"))
    return best.select("name", *[F.col(f"b.{c}") for c in columns], "b.snapshot")


def merge_declarations(parts: list[DataFrame]) -> DataFrame:
    """The union of ``parts``, whose decl_id is unique in each, with ids that run on from one part to the next; raises ValueError if two rows have a name in common."""
    merged, shift = [], 0
    for p in parts:
        merged.append(p.withColumn("decl_id", (F.col("decl_id") + F.lit(shift)).cast("bigint")))
        shift += (p.agg(F.max("decl_id")).first()[0] or 0) + 1
    out = reduce(lambda a, b: a.unionByName(b), merged)
    twice = out.groupBy("name").count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"declaration {twice[0][0]!r} occurs twice")
    return out


# The kinds of generated declarations in the order in which the first that holds counts, and the flag that tells each.
GENERATION_KINDS = {"equationTheorem": "is_equation", "matcher": "is_matcher", "noConfusion": "is_no_confusion", "auxiliaryRecursor": "is_auxiliary_recursor", "recursor": "is_recursor", "projection": "is_projection", "internalName": "is_internal_name"}


def generation_kind(columns: list[str]) -> Column:
    """The generation kind that the flags among ``columns`` tell, null for what was written by hand; unknown flags count as false."""
    return F.coalesce(*[F.when(F.col(flag), F.lit(kind)) for kind, flag in GENERATION_KINDS.items() if flag in columns], F.lit(None).cast("string"))
