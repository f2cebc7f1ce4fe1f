"""The corpus of a directory of tables: declarations, symbols, edges and graphs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofloom.functions import dag
from proofloom.operators import nested
from proofloom.operators.filters import AnalysisFilter, hidden
from proofloom.operators.skew import join_key_values
from proofloom.session import cut
from proofloom.sources import snapshot
from proofloom.sources.tables import latest, table

FLAGS = ["generation_kind", "is_internal", "is_private", "is_unsafe", "is_partial", "is_class", "is_instance", "is_projection"]


@dataclass
class Corpus:
    """Lazily built tables. ``edges`` has one row per (source_id, target, layer); rows without a target are no edges. What is known of a
    target comes from its symbol, else from the edge row; unknown flags are false."""

    spark: SparkSession
    directory: str

    @cached_property
    def declarations(self) -> DataFrame:
        keep = ["name", "kind", "module_name", *FLAGS, "has_value", "start_line", "end_line", "doc_string", "type_text", "axioms"]
        rows = latest(table(self.spark, self.directory, "declarations"), ["decl_id"], keep=keep)
        return rows.withColumn("hidden", hidden())

    @cached_property
    def symbols(self) -> DataFrame:
        """Declarations and library symbols; a declaration goes before a library symbol of the same name."""
        columns = ["name", "kind", "module_name", *FLAGS]
        own = self.declarations.select(*columns, F.col("decl_id"))
        library = table(self.spark, self.directory, "library_symbols").select(*columns, F.lit(None).cast("bigint").alias("decl_id"))
        return own.unionByName(library.join(own.select("name"), "name", "left_anti")).withColumn("hidden", hidden())

    @cached_property
    def edges(self) -> DataFrame:
        return self.edges_of()

    def edges_of(self, f: AnalysisFilter | None = None) -> DataFrame:
        """The edges; with ``f`` those whose source and layer pass it, so that no others are deduplicated, written or joined."""
        keep = ["source", "occurrences", "source_module", "source_kind", "target_module", "target_kind", "target_is_class", "target_is_instance", "target_is_projection"]
        raw = table(self.spark, self.directory, "dependency_edges").where("target is not null")
        if f is not None:
            raw = f.sources(raw.where(f.layers()), self.declarations)  # source_id and layer are keys
        rows = latest(raw, ["source_id", "target", "layer"], keep=keep)
        known = self.symbols.select(
            F.col("name").alias("target"), F.col("kind").alias("s_kind"), F.col("module_name").alias("s_module"), F.col("is_class").alias("s_class"), F.col("is_instance").alias("s_instance"),
            F.col("is_projection").alias("s_projection"), F.col("hidden").alias("s_hidden"), F.col("decl_id").alias("target_id"),
        )
        rows = cut(rows, "edges")
        weights = rows.groupBy("target").agg(F.count(F.lit(1)).alias("_edges"))
        joined = join_key_values(rows, cut(known.join(weights.hint("merge"), "target"), "targets"), ["target"], "_edges")
        flag = lambda a, b: F.coalesce(F.col(a), F.col(b), F.lit(False))
        return joined.select(
            "source_id", "source", "target", "target_id", "layer", "occurrences", "source_module", "source_kind",
            F.coalesce("s_module", "target_module").alias("target_module"), F.coalesce("s_kind", "target_kind").alias("target_kind"),
            F.col("target_id").isNotNull().alias("target_in_corpus"), flag("s_class", "target_is_class").alias("target_is_class"),
            flag("s_instance", "target_is_instance").alias("target_is_instance"), flag("s_projection", "target_is_projection").alias("target_is_projection"),
            F.coalesce("s_hidden", F.lit(False)).alias("target_hidden"),
        ).withColumn("target_infrastructure", F.expr("target_is_class or target_is_instance or target_is_projection"))

    @cached_property
    def fingerprints(self) -> DataFrame:
        """decl_id, fingerprint: equal for declarations that state the same. The tables hold no graphs of statements, so their text stands in."""
        return self.declarations.select("decl_id", F.sha1("type_text").alias("fingerprint"))

    @cached_property
    def expressions(self) -> DataFrame:
        """decl_id, layer, unique_nodes, total_occurrences, distinct_constants, constant_frequencies."""
        return latest(table(self.spark, self.directory, "expression_metrics"), ["decl_id", "layer"], keep=["unique_nodes", "total_occurrences", "distinct_constants", "constant_frequencies"])

    @cached_property
    def outlines(self) -> DataFrame:
        return self.outlines_of(["outline_id", "decl_id", "declaration", "complete", "truncation_reason", "visited_terms", "conclusion_step", "candidate_node_count", "raw_steps"])

    def outlines_of(self, columns: list[str]) -> DataFrame:
        """``columns`` of every outline as it was last sent; dotted names (``raw_steps.id``) take only those fields of the steps. A scan reads nothing else, and steps aren't compared or shuffled:
        the last row of an outline is found by its key, and a row sent again the very same time is told by its place."""
        path = f"{self.directory}/proof_outlines.parquet"
        schema = self.spark.read.parquet(path).schema
        plain = [c for c in columns if "." not in c]
        steps = [c for c in columns if "." in c]
        fields = [schema[c] for c in dict.fromkeys(["outline_id", *plain, "received_at"])] + (nested.prune(T.StructType([schema["raw_steps"]]), steps).fields if steps else [])
        rows = self.spark.read.schema(T.StructType(fields)).parquet(path)
        kept = [f.name for f in fields if f.name not in ("outline_id", "received_at")]
        digest = F.xxhash64(*[F.col(c) for c in kept]) if kept else F.lit(0)
        marked = rows.withColumn("_digest", digest)
        last = marked.groupBy("outline_id").agg(F.max(F.struct(F.col("received_at"), F.col("_digest"))).alias("_last"))
        chosen = marked.join(last.hint("merge"), "outline_id").where(F.col("received_at").eqNullSafe(F.col("_last.received_at")) & (F.col("_digest") == F.col("_last._digest")))
        return chosen.select("outline_id", *kept).dropDuplicates(["outline_id"])

    def filtered(self, f: AnalysisFilter) -> tuple[DataFrame, DataFrame]:
        """(declarations, edges) that pass ``f``; its source and layer are tested before edges are put together."""
        return f.declarations(self.declarations), self.edges_of(f).where(f.target())

    @cached_property
    def expression_nodes(self) -> DataFrame:
        """declaration, layer and the columns of ``functions.dag.node_rows`` for every expression there is; the tables hold none of declarations, so propositions and context types of outlines stand in."""
        from proofloom.plans import q_structure

        return q_structure._nodes(self.spark, self.directory).withColumn("layer", F.lit("statement"))

    def graph(self, f: AnalysisFilter) -> tuple[DataFrame, DataFrame]:
        """(nodes: id, name; links: src, dst, weight, layers) among the declarations that pass ``f``.

        Both ends must pass. Parallel layers fall into one link with the smaller of their occurrences.
        """
        nodes, edges = self.filtered(f)
        nodes = nodes.select(F.col("decl_id").alias("id"), "name", "kind", "module_name")
        inside = edges.where("target_id is not null").join(nodes.select(F.col("id").alias("target_id")).hint("merge"), "target_id", "left_semi")
        links = inside.groupBy(F.col("source_id").alias("src"), F.col("target_id").alias("dst")).agg(F.min("occurrences").alias("weight"), F.count(F.lit(1)).alias("layers"))
        return nodes, links


@dataclass
class SnapshotCorpus(Corpus):
    """The corpus of snapshots: edges, sizes and structure come from the declarations' own graphs."""

    declared: DataFrame = None
    known: DataFrame = None

    @classmethod
    def of(cls, snapshots: DataFrame) -> SnapshotCorpus:
        """Of the rows of ``sources.snapshot.load_snapshots`` or ``merge_snapshots``. Raises ValueError if two declarations have one name."""
        declared = cut(snapshot.declarations(snapshots), "declared")
        snapshot.merge_declarations([declared])
        return cls(snapshots.sparkSession, "", declared, cut(snapshot.symbols(snapshots), "symbols"))

    @cached_property
    def symbols(self) -> DataFrame:
        """A row per symbol, the first snapshot's where several have it."""
        flags = [F.coalesce(F.col(c), F.lit(False)).alias(n) for c, n in (("isInternal", "is_internal"), ("isPrivate", "is_private"), ("isUnsafe", "is_unsafe"), ("isPartial", "is_partial"), ("isClass", "is_class"), ("isInstance", "is_instance"), ("isProjection", "is_projection"))]
        rows = self.known.where("name is not null").select("snapshot", "name", "kind", F.col("moduleName").alias("module_name"), F.col("generationKind").alias("generation_kind"), *flags)
        rest = [c for c in rows.columns if c not in ("name", "snapshot")]
        first = rows.groupBy("name").agg(F.min(F.struct("snapshot", *rest)).alias("b")).select("name", *[F.col(f"b.{c}") for c in rest])
        ids = self.declared.select("name", "decl_id")
        return first.join(ids.hint("merge"), "name", "left").withColumn("hidden", hidden())

    @cached_property
    def declarations(self) -> DataFrame:
        flags = [F.coalesce(F.col(c), F.lit(False)).alias(n) for c, n in (("isInternal", "is_internal"), ("isPrivate", "is_private"), ("isUnsafe", "is_unsafe"), ("isPartial", "is_partial"), ("hasValue", "has_value"))]
        own = self.declared.select(
            "decl_id", "name", "kind", F.col("moduleName").alias("module_name"), F.col("generationKind").alias("generation_kind"), *flags, F.col("sourceRange.start.line").alias("start_line"),
            F.col("sourceRange.end.line").alias("end_line"), F.col("docString").alias("doc_string"), F.col("type").alias("type_text"), "axioms",
        )
        bits = self.symbols.select("name", "is_class", "is_instance", "is_projection")
        return own.join(bits.hint("merge"), "name", "left").withColumn("hidden", hidden())

    @cached_property
    def graphs(self) -> DataFrame:
        return snapshot.graphs_of(self.declared)

    @cached_property
    def expression_nodes(self) -> DataFrame:
        names = self.declared.select("decl_id", F.col("name").alias("declaration"))
        return cut(dag.node_rows(self.graphs.join(names.hint("merge"), "decl_id"), ["decl_id", "declaration", "layer"]), "expression-nodes")

    @cached_property
    def expressions(self) -> DataFrame:
        """decl_id, layer, unique_nodes, total_occurrences, max_depth, distinct_constants, constant_frequencies, kinds, kind_proportions, binders and the root's digests."""
        stats = cut(dag.expression_stats(self.expression_nodes, ["decl_id", "layer"]), "expression-stats")
        frequencies = F.transform(F.array_sort(F.transform(F.map_entries("constants"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))), lambda e: F.struct(e["k"].alias("name"), (-e["n"]).alias("occurrences")))
        return stats.withColumn("constant_frequencies", frequencies).drop("constants")

    @cached_property
    def edges(self) -> DataFrame:
        return self.edges_of()

    def edges_of(self, f: AnalysisFilter | None = None) -> DataFrame:
        """An edge for every constant of a layer's expression, as often as it occurs there; what is known of the target comes from its symbol."""
        used = self.expression_nodes.where("kind = 'constant' and name is not null and multiplicity > 0").groupBy("decl_id", F.col("name").alias("target"), "layer").agg(F.sum("multiplicity").alias("occurrences"))
        used = used.withColumnRenamed("decl_id", "source_id")
        if f is not None:
            used = f.sources(used.where(f.layers()), self.declarations)
        used = cut(used, "edges")
        weights = used.groupBy("target").agg(F.count(F.lit(1)).alias("_edges"))
        bits = self.symbols.select(F.col("name").alias("target"), F.col("kind").alias("target_kind"), F.col("module_name").alias("target_module"), F.col("decl_id").alias("target_id"), *[F.col(c).alias(f"target_{c}") for c in ("is_class", "is_instance", "is_projection")], F.col("hidden").alias("target_hidden"))
        joined = join_key_values(used, cut(bits.join(weights.hint("merge"), "target"), "targets"), ["target"], "_edges")
        own = self.declarations.select(F.col("decl_id").alias("source_id"), F.col("name").alias("source"), F.col("module_name").alias("source_module"), F.col("kind").alias("source_kind"))
        rows = joined.join(own.hint("merge"), "source_id")
        flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("target_is_class", "target_is_instance", "target_is_projection", "target_hidden")]
        return rows.select("source_id", "source", "target", "target_id", "layer", "occurrences", "source_module", "source_kind", "target_module", "target_kind", F.col("target_id").isNotNull().alias("target_in_corpus"), *flags).withColumn(
            "target_infrastructure", F.expr("target_is_class or target_is_instance or target_is_projection")
        )

    @cached_property
    def fingerprints(self) -> DataFrame:
        """decl_id, fingerprint: equal for declarations whose statements are equal up to the names of binders."""
        return self.expressions.where("layer = 'statement'").select("decl_id", F.col("alpha").alias("fingerprint"))

    @cached_property
    def features(self) -> DataFrame:
        """name, layer and what ``operators.structure.compare_graphs`` compares."""
        deps = self.edges.groupBy(F.col("source_id").alias("decl_id"), "layer").agg(F.collect_set("target").alias("deps"))  # a declaration's own constants
        names = self.declared.select("decl_id", "name")
        rows = self.expressions.select("decl_id", "layer", "exact", "alpha", F.col("max_depth").alias("depth"), F.col("unique_nodes").alias("nodes"), F.col("unique_kinds").alias("kinds"))
        rows = rows.join(deps.hint("merge"), ["decl_id", "layer"], "left").join(names.hint("merge"), "decl_id")
        return cut(rows.select("decl_id", "name", "layer", "exact", "alpha", "depth", "nodes", "kinds", F.coalesce("deps", F.array().cast("array<string>")).alias("deps")), "features")

    @cached_property
    def outlines(self) -> DataFrame:
        """The proof steps in the form of the table proof_outlines; outline_id is the decl_id."""
        steps = f"transform(proofSteps.steps, s -> named_struct('id', s.id, 'kind', s.kind, 'proposition', s.proposition, 'proposition_graph', cast(s.propositionGraph as struct<root: bigint, nodes: {snapshot._NODES}>), "
        steps += f"'context', transform(s.context, c -> named_struct('id', c.id, 'user_name', c.userName, 'kind', c.kind, 'binder_info', c.binderInfo, 'type_text', c.type, 'type_graph', cast(c.typeGraph as struct<root: bigint, nodes: {snapshot._NODES}>), 'value_text', c.value)), "
        steps += "'scope', s.scope, 'proof_term_path', array_join(s.proofTermPath, '.'), 'prerequisite_steps', s.prerequisiteSteps, 'hypothesis_references', s.hypothesisReferences, 'named_references', s.namedReferences))"
        return self.declared.where("proofSteps is not null").select(
            F.col("decl_id").alias("outline_id"), "decl_id", F.col("name").alias("declaration"), F.col("proofSteps.complete").alias("complete"), F.col("proofSteps.truncationReason").alias("truncation_reason"),
            F.col("proofSteps.visitedTerms").alias("visited_terms"), F.col("proofSteps.conclusionStep").alias("conclusion_step"), F.expr(steps).alias("raw_steps"), F.col("proofSteps.namedResults").alias("named_results"),
        )

    def outlines_of(self, columns: list[str]) -> DataFrame:
        return self.outlines.select("outline_id", *[c for c in columns if "." not in c and c != "outline_id"], *(["raw_steps"] if any("." in c for c in columns) and "raw_steps" not in columns else []))
