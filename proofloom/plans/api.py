"""What a user calls: the commands of the engine over one corpus, of tables or of snapshots."""

from __future__ import annotations

import argparse
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.operators import graph, groups, lenses, metrics, proof, structure, validate
from proofloom.operators.filters import LAYERS, AnalysisFilter, visibility
from proofloom.plans import q_structure
from proofloom.plans.corpus import Corpus, SnapshotCorpus
from proofloom.reports import render, text
from proofloom.session import cut
from proofloom.sources import snapshot

LENSES = ("influence", "bridge", "neighbors", "proof", "trust")
DISCOVERED = LENSES[:3]
EXPORTS = ("nodes", "edges", "modules", "metrics", "duplicates", "repeated")


def parse_lenses(listed: str) -> list[str]:
    """Comma-separated names; ``all`` stands for every lens, ``neighbours`` for ``neighbors``; each once, in order."""
    out: list[str] = []
    for word in (w.strip().lower() for w in listed.split(",")):
        word = "neighbors" if word == "neighbours" else word
        if word != "all" and word not in LENSES:
            raise ValueError(f"unknown lens {word!r}")
        out.extend(LENSES if word == "all" else [word])
    return list(dict.fromkeys(out))


@dataclass
class Engine:
    """Results for a filter. ``limit`` bounds listings, never what is computed nor what is exported; ``both_layers`` makes lenses answer for either layer, one after the other."""

    spark: SparkSession
    directory: str = ""
    filter: AnalysisFilter = field(default_factory=AnalysisFilter)
    limit: int = 100
    max_depth: int = 32
    minimum_size: int = 4
    support: int = 2
    mode: str = "exact"
    weighted: bool = False
    both_layers: bool = False
    source: Corpus | None = None

    @classmethod
    def of_snapshots(cls, spark: SparkSession, paths: list[str], **options) -> Engine:
        return cls(spark, source=SnapshotCorpus.of(snapshot.load_snapshots(spark, paths)), **options)

    @cached_property
    def corpus(self) -> Corpus:
        return self.source or Corpus(self.spark, self.directory)

    @cached_property
    def _filtered(self) -> tuple[DataFrame, DataFrame]:
        return self.corpus.filtered(self.filter)

    @cached_property
    def _graph(self) -> tuple[DataFrame, DataFrame]:
        nodes, links = self.corpus.graph(self.filter)
        return cut(nodes, "nodes"), cut(links, "links")

    @property
    def _from_snapshots(self) -> bool:
        return isinstance(self.corpus, SnapshotCorpus)

    def _known(self, name: str) -> DataFrame:
        row = self._graph[0].where(F.col("name") == name)
        if row.isEmpty():
            raise KeyError(f"unknown declaration {name!r}")
        return row

    # --- the corpus

    def summary(self) -> DataFrame:
        return metrics.summary(*self._filtered, self.corpus.expressions, self.filter.symbols(self.corpus.symbols))

    def summary_report(self) -> dict[str, DataFrame]:
        """The summary with counts by kind and module, breakdowns, distributions and histograms of both sizes."""
        own = self._filtered[0]
        sizes = self.corpus.expressions.join(own.select("decl_id").hint("merge"), "decl_id", "left_semi")
        return {
            "summary": self.summary(), "by_kind": metrics.group_counts(own, "kind"), "by_module": metrics.group_counts(own, "module_name"), "distributions": metrics.distribution(sizes, ["layer"], "total_occurrences"),
            "histograms": metrics.histogram(sizes, "layer", "total_occurrences"), "breakdown": metrics.breakdown(own.withColumn("visibility", visibility()), self.corpus.expressions),
        }

    def declaration(self, name: str) -> DataFrame:
        return self.corpus.declarations.where(F.col("name") == name)

    def declaration_report(self, name: str) -> dict[str, DataFrame]:
        """The declaration with its sizes by layer, dependencies and dependents; KeyError for an unknown name."""
        row = self.declaration(name)
        if row.isEmpty():
            raise KeyError(f"unknown declaration {name!r}")
        own = self.corpus.expressions.join(row.select("decl_id").hint("merge"), "decl_id", "left_semi")
        return {"declaration": row, "metrics": own, "dependencies": self.dependencies(name), "dependents": self.dependents(name)}

    def symbol(self, name: str) -> DataFrame:
        return self.corpus.symbols.where(F.col("name") == name)

    def rank(self, metric: str) -> DataFrame:
        return metrics.rank(*self._filtered, self.corpus.expressions, metric, self.limit)

    def modules(self) -> DataFrame:
        return metrics.module_rollup(self._filtered[1])

    def search(self, query: str, limit: int = 12) -> DataFrame:
        return metrics.search(self.corpus.declarations, self.corpus.edges, query, limit)

    def violations(self) -> DataFrame:
        """Broken rules of the corpus and, of snapshots, of every declaration's own record."""
        rules = validate.corpus_rules(self.corpus.declarations, self.corpus.symbols, self.corpus.edges)
        return rules.union(validate.declaration_rules(self.corpus)) if self._from_snapshots else rules

    # --- dependencies

    def dependencies(self, name: str, transitive: bool = False) -> DataFrame:
        if transitive:
            return self._walk(name, False)
        return self._neighbours(self._filtered[1].where(F.col("source") == name), "source", "target")

    def dependents(self, name: str, transitive: bool = False) -> DataFrame:
        """Direct dependents of any symbol, external ones too; transitive ones of declarations."""
        if transitive:
            return self._walk(name, True)
        return self._neighbours(self._filtered[1].where(F.col("target") == name), "target", "source")

    def _neighbours(self, edges: DataFrame, own: str, other: str) -> DataFrame:
        """The first ``limit`` edges of one name by (``other``, layer): each task keeps its first ones, so no task takes all of a hot name; truncated says whether there are more."""
        first = edges.orderBy(other, "layer").limit(self.limit + 1).collect()
        rows = [(r[own], r[other], r.layer, r.occurrences, k, len(first) > self.limit) for k, r in enumerate(first[: self.limit], 1)]
        return self.spark.createDataFrame(rows, f"{own} string, {other} string, layer string, occurrences bigint, place bigint, truncated boolean")

    def rollups(self, name: str, reverse: bool = False) -> DataFrame:
        """Occurrences of all of a name's dependencies (or dependents) by module and kind, whatever the limit."""
        own, other = ("target", "source") if reverse else ("source", "target")
        return metrics.rollups(self._filtered[1].where(F.col(own) == name), own, other).orderBy("rollup", F.desc("occurrences"), "value")

    def _walk(self, name: str, reverse: bool) -> DataFrame:
        """In the order in which a breadth-first search meets them; truncated says whether the limit left some out."""
        nodes, links = self._graph
        found = graph.traverse(nodes, links, self._known(name), self.max_depth, reverse).where("depth > 0")
        first = found.orderBy("depth", "path").limit(self.limit + 1).select(F.element_at("path", -1).alias("name"), "depth", "path_weight").collect()
        rows = [(r.name, r.depth, r.path_weight, k, len(first) > self.limit) for k, r in enumerate(first[: self.limit], 1)]
        return self.spark.createDataFrame(rows, "name string, depth bigint, path_weight bigint, place bigint, truncated boolean")

    def path(self, source: str, target: str) -> DataFrame:
        """nodes, layers and occurrences of the shortest path, which may end in an external symbol; no row if there is none. KeyError for names that are no declaration and no symbol."""
        if self._filtered[0].where(F.col("name") == source).isEmpty() or self.symbol(target).isEmpty():
            raise KeyError(f"unknown name, {source!r} or {target!r}")
        return graph.shortest_path(self._filtered[1], source, target, self.max_depth)

    def shared_dependencies(self, names: list[str]) -> DataFrame:
        """Targets that every one of the distinct ``names`` depends on."""
        wanted = list(dict.fromkeys(names))
        rows = self._filtered[1].where(F.col("source").isin(wanted)).groupBy("target").agg(F.countDistinct("source").alias("n"))
        return rows.where(F.col("n") == len(wanted)).select("target").orderBy("target").limit(self.limit)

    def graph(self) -> dict[str, DataFrame]:
        nodes, links = self._graph
        points, cut_edges = graph.cut_structure(nodes, links)
        ranked = graph.degrees(nodes, links).join(graph.pagerank(nodes, links, self.weighted).hint("merge"), "id").join(graph.betweenness(nodes, links).hint("merge"), "id")
        sized = lambda parts: parts.join(parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")).hint("merge"), "component").join(nodes.select("id", "name").hint("merge"), "id").orderBy(F.desc("size"), "component", "name")
        return {
            "centrality": ranked.orderBy(F.round("rank", 12).desc(), "name"), "weak": sized(graph.weak_components(nodes, links)), "strong": sized(graph.strong_components(nodes, links)),
            "articulation_points": points.join(nodes.hint("merge"), "id").select("name").orderBy("name"), "bridges": cut_edges, "communities": graph.communities(graph.label_propagation(nodes, links)),
        }

    def rankings(self, by: str = "load_bearing") -> DataFrame:
        """Visible theorems by load_bearing (edges that rest on one), connected (edges on either side) or bridge (betweenness), the more load-bearing first among equals, then by name."""
        if by not in ("load_bearing", "connected", "bridge"):
            raise ValueError(f"unknown ranking {by!r}")
        nodes, links = self._graph
        rows = graph.degrees(nodes, links).join(graph.betweenness(nodes, links).hint("merge"), "id").where("kind = 'theorem'")
        ranked = rows.select("name", F.col("in_degree").alias("load_bearing"), (F.col("in_degree") + F.col("out_degree")).alias("connected"), F.round("betweenness", 6).alias("bridge"))
        return ranked.orderBy(F.desc(by), F.desc("load_bearing"), "name").limit(self.limit)

    # --- structure

    def compare(self, left: str, right: str) -> DataFrame:
        """A row for every layer that both have; KeyError if there is none."""
        layers = [self.filter.layer] if self.filter.layer else LAYERS
        pair = self.spark.createDataFrame([(0, left, right, layer) for layer in layers], "comparison_id bigint, left_name string, right_name string, layer string")
        if self._from_snapshots:
            found = structure.compare_graphs(pair, self.corpus.features)
        else:
            found = structure.compare(pair, q_structure._features(self.spark, self.directory)).drop("comparison_id")
        if found.isEmpty():
            raise KeyError("no layer that both declarations have")
        return found

    @cached_property
    def _expressions(self) -> DataFrame:
        """The nodes of the expressions of declarations that pass the filter, of its layer."""
        nodes = self.corpus.expression_nodes.where(self.filter.layers())
        if not self._from_snapshots:
            return nodes
        return nodes.join(self._filtered[0].select("decl_id").hint("merge"), "decl_id", "left_semi")

    def duplicates(self) -> DataFrame:
        """Groups of declarations with the same whole expression, largest first."""
        return structure.duplicates(self._expressions, self.mode, self.support).orderBy(F.desc("size"), "first_declaration", "fingerprint")

    def repeated(self) -> DataFrame:
        """Subexpressions found in several declarations, largest first."""
        return structure.repeated(self._expressions, self.mode, self.minimum_size, self.support).orderBy(F.desc("size"), F.desc("declarations"), "fingerprint")

    def repeated_in(self, name: str) -> DataFrame:
        found = structure.repeated(self._expressions, self.mode, self.minimum_size, self.support)
        return structure.repeated_in(self._expressions, found, name, self.mode, self.minimum_size).orderBy(F.desc("size"), F.desc("declarations"), "fingerprint").limit(self.limit)

    def endpoints(self, technical: bool = False, theorems: bool = True, definitions: bool = True) -> tuple[DataFrame, DataFrame]:
        """(end points, grouped edges) of the graph that is drawn: declarations and groups of those that state the same."""
        shown = self.corpus.declarations.where(groups.shown(technical, theorems, definitions)).select("decl_id", "name", "kind", "type_text")
        ends = groups.endpoints(shown, self.corpus.fingerprints)
        return ends, groups.between(self._filtered[1], ends)

    def witnesses(self, prerequisite: str, user: str, limit: int = 3) -> DataFrame:
        """(direction, nodes, layers, occurrences): what connects two end points. The first edge between their members names the two declarations; then the shortest way from the user's down to the
        prerequisite's, and, with a limit above 1, the other way round if there is one. KeyError if no edge connects them."""
        _, met = self.endpoints(technical=True)
        first = groups.first_witnesses(met.where((F.col("prerequisite") == prerequisite) & (F.col("user") == user))).first()
        if first is None:
            raise KeyError(f"no dependency connects {prerequisite!r} and {user!r}")
        every = self.corpus.filtered(AnalysisFilter.all())[1]
        ways = [("down", first.source, first.target)] + ([("up", first.target, first.source)] if limit > 1 else [])
        return reduce(lambda a, b: a.unionByName(b), [graph.shortest_path(every, a, b, self.max_depth).withColumn("direction", F.lit(n)) for n, a, b in ways])

    def fingerprint(self) -> str:
        """A digest of the corpus: of version, modules, names and statements' structure."""
        own = self.corpus.declarations.select("decl_id", "name", F.col("type_text").alias("digest"))
        if self._from_snapshots:
            own = self.corpus.declared.select("decl_id", "name").join(self.corpus.expressions.where("layer = 'statement'").select("decl_id", F.col("exact").alias("digest")).hint("merge"), "decl_id", "left")
        return groups.fingerprint(own, str(snapshot.SCHEMA_VERSION), []).first().fingerprint

    # --- proofs

    def _outline(self, name: str) -> dict:
        row = self.corpus.outlines.where(F.col("declaration") == name).orderBy("outline_id").first()
        if row is None:
            raise KeyError(f"no proof steps of {name!r}")
        return row.asDict(recursive=True)

    def proof_steps(self, name: str, step: int | None = None) -> dict:
        """One declaration's proof steps with their edges and, if asked for, everything about a step (KeyError for an unknown one)."""
        o = self._outline(name)
        steps = [s for s in o["raw_steps"] or [] if s is not None]
        report = {k: o[k] for k in ("declaration", "complete", "truncation_reason", "visited_terms", "conclusion_step")} | {"steps": steps, "edges": proof.edge_rows(steps, o["conclusion_step"]), "named_results": o.get("named_results") or []}
        return report | {"selected": proof.inspect(steps, o["conclusion_step"], step) if step is not None else None}

    def proof_outline(self, name: str) -> dict | None:
        o = self._outline(name)
        made = proof.outline(o["raw_steps"], o["conclusion_step"])
        return made and made | {"declaration": name, "complete": o["complete"], "truncation_reason": o["truncation_reason"], "rules": list(proof.RETENTION)}

    # --- lenses

    def _layers(self, lens: str) -> list[str]:
        if self.both_layers:
            return list(LAYERS)
        return [self.filter.layer or ("statement" if lens == "neighbors" else "proof")]

    def _visible(self) -> DataFrame:
        return cut(self.filter.declarations(self.corpus.declarations).where("kind = 'theorem'").select(F.col("decl_id").alias("id"), "name", "type_text"), "visible")

    @cached_property
    def _lens_graphs(self) -> dict:
        return {}

    def _lens_graph(self, layer: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(nodes, links, visible theorems, their regions): the paths of a layer go over hidden declarations too."""
        if layer not in self._lens_graphs:
            nodes, links = self.corpus.graph(replace(self.filter, include_generated=True, include_infrastructure=True, layer=layer))
            nodes, links, shown = cut(nodes, "nodes"), cut(links, "links"), self._visible()
            self._lens_graphs[layer] = (nodes, links, shown, cut(lenses.regions(nodes, links, shown, layer), "regions"))
        return self._lens_graphs[layer]

    def regions(self, layer: str) -> DataFrame:
        return self._lens_graph(layer)[3]

    def _influence(self, layer: str) -> DataFrame:
        _, links, shown, region = self._lens_graph(layer)
        return lenses.influence_reason(lenses.influence(links, shown, region, self.max_depth)).withColumn("layer", F.lit(layer))

    def _bridge(self, layer: str) -> DataFrame:
        nodes, links, shown, region = self._lens_graph(layer)
        return lenses.bridge_reason(lenses.bridges(nodes, links, shown, region)).withColumn("layer", F.lit(layer))

    def _neighbors(self, layer: str, name: str | None = None) -> DataFrame:
        theorems = self._visible().select("name")
        asked = theorems if name is None else theorems.where(F.col("name") == name)
        top = 3 if name is None else self.limit
        if self._from_snapshots:
            rows = self.corpus.features.where(F.col("layer") == layer).join(theorems.hint("merge"), "name", "left_semi")
            return lenses.neighbor_reason(structure.graph_neighbours(rows, asked, top))
        rows = q_structure._features(self.spark, self.directory).where(F.col("layer") == layer).join(theorems.hint("merge"), "name", "left_semi")
        return structure.neighbours(cut(rows.select("name", "deps", "unique_nodes"), "features"), asked, top).withColumn("layer", F.lit(layer))

    def _each(self, lens: str, make) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [make(layer) for layer in self._layers(lens)])

    def discover(self, lens: str = "all") -> dict[str, DataFrame]:
        """The theorems that stand out by influence, bridging or likeness, best first, at most ``limit`` a lens. Proof and trust look at one theorem and are no discoveries."""
        wanted = [w for w in parse_lenses(lens) if w in DISCOVERED or "all" not in lens]
        if any(w not in DISCOVERED for w in wanted):
            raise ValueError("discover takes influence, bridge and neighbors")
        out: dict[str, DataFrame] = {}
        if "influence" in wanted:
            out["influence"] = self._each("influence", self._influence).orderBy(F.desc("reachable"), F.desc("direct"), "name", "layer").limit(self.limit)
        if "bridge" in wanted:
            out["bridge"] = self._each("bridge", self._bridge).orderBy(F.desc("articulation"), F.desc("region_pairs"), F.desc("betweenness"), "name", "layer").limit(self.limit)
        if "neighbors" in wanted:
            score = "combined_score" if self._from_snapshots else "score"
            rows = cut(self._each("neighbors", self._neighbors), "neighbors")
            best = rows.where("place = 1").orderBy(F.desc(score), "query", "layer").limit(self.limit).select("query", "layer")
            out["neighbors"] = rows.join(best.hint("merge"), ["query", "layer"], "left_semi").orderBy("query", "layer", "place")
        return out

    def inspect(self, name: str, lens: str = "all") -> dict[str, DataFrame | dict | None]:
        """Evidence about one theorem (KeyError if it is unknown or no theorem), however small: influence with its dependents and witness paths, bridging with its pairs of regions and witnesses, its nearest
        theorems, the outline of its proof, and what its trust rests on."""
        row = self._filtered[0].where((F.col("name") == name) & (F.col("kind") == "theorem"))
        if row.isEmpty():
            raise KeyError(f"no theorem {name!r}")
        root = row.select(F.col("decl_id").alias("id"))
        out: dict[str, DataFrame | dict | None] = {}
        wanted = parse_lenses(lens)
        if "influence" in wanted:
            parts = {layer: self._lens_graph(layer) for layer in self._layers("influence")}
            both = lambda make: reduce(lambda a, b: a.unionByName(b), [make(*g).withColumn("layer", F.lit(layer)) for layer, g in parts.items()])
            out["influence"] = both(lambda nodes, links, shown, region: lenses.influence_members(links, shown, region, root, self.max_depth)).orderBy("layer", "dependent")
            out["influence_paths"] = both(lambda nodes, links, shown, region: lenses.influence_witnesses(nodes, links, shown, root, self.max_depth)).orderBy("layer", "place")
        if "bridge" in wanted:
            pairs = self._each("bridge", lambda layer: lenses.bridge_pairs(self._lens_graph(layer)[1], self.regions(layer)).where(F.col("name") == name).withColumn("layer", F.lit(layer)))
            out["bridge"] = self._each("bridge", self._bridge).where(F.col("name") == name)
            out["bridge_pairs"] = pairs.orderBy("layer", "from_region", "to_region")
            out["bridge_paths"] = lenses.bridge_witnesses(pairs).orderBy("place")
        if "neighbors" in wanted:
            out["neighbors"] = self._each("neighbors", lambda layer: self._neighbors(layer, name)).orderBy("layer", "place")
        if "proof" in wanted:
            try:
                out["proof"] = self.proof_outline(name)
            except KeyError:
                out["proof"] = None
        if "trust" in wanted:
            out["trust"] = self._trust(row)
        return out

    def _trust(self, theorems: DataFrame) -> DataFrame:
        flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
        steps = self.corpus.outlines.select(F.col("declaration").alias("name"), F.lit(True).alias("steps_available"), F.col("complete").alias("steps_complete"), "truncation_reason", "visited_terms", F.greatest(F.size("raw_steps"), F.lit(0)).alias("step_count"))
        axioms = F.array_sort(F.array_distinct(F.filter(F.coalesce("axioms", F.array()), lambda x: x.isNotNull())))
        own = theorems.select(
            "name", F.array_join(axioms, ";").alias("axioms"), flag("is_internal"), flag("is_private"), F.col("generation_kind").isNotNull().alias("is_generated"), flag("is_unsafe"), flag("is_partial"),
            F.coalesce("has_value", F.lit(False)).alias("has_proof"), F.col("start_line").isNotNull().alias("source_available"), "start_line", "end_line", F.col("doc_string").isNotNull().alias("doc_available"), "doc_string",
        )
        return own.join(steps.hint("merge"), "name", "left").withColumn("steps_available", F.coalesce("steps_available", F.lit(False)))

    # --- output

    def export(self, what: str) -> DataFrame:
        """Every row of an export. Of duplicates and repeated structures a row per member or place; ``write_export`` joins a group's members in one cell."""
        if what not in EXPORTS:
            raise ValueError(f"unknown export {what!r}")
        if what == "nodes":
            return metrics.export_nodes(self._filtered[0], self.corpus.expressions)
        if what == "edges":
            columns = ["source", "target", F.initcap("layer").alias("layer"), "occurrences", "target_in_corpus", "source_module", "target_module", "target_kind", "target_is_class", "target_is_instance", "target_is_projection"]
            return self._filtered[1].select(*columns)
        if what == "modules":
            return self.modules()
        if what == "metrics":
            return metrics.export_metrics(self._filtered[0], self.corpus.expressions)
        nodes = self._expressions
        if what == "duplicates":
            rows = structure.members(nodes, structure.duplicates(nodes, self.mode, self.support), self.mode)
            return rows.select("fingerprint", F.col("size").alias("expression_size"), F.col("depth").alias("expression_depth"), F.col("occurrences").alias("total_occurrences"), "declaration").orderBy(F.desc("expression_size"), "fingerprint", "declaration")
        rows = structure.locations(nodes, structure.repeated(nodes, self.mode, self.minimum_size, self.support), self.mode, self.minimum_size)
        return rows.select(
            "fingerprint", F.col("size").alias("expression_size"), F.col("depth").alias("expression_depth"), F.col("declarations").alias("unique_declarations"), F.col("occurrences").alias("total_occurrences"), "declaration",
            F.initcap("layer").alias("layer"), "node", "location_occurrences",
        ).orderBy(F.desc("expression_size"), F.desc("unique_declarations"), "fingerprint", "declaration", "node")

    def lines(self, df: DataFrame, form: str, export: bool = False) -> Iterator[str]:
        """``df`` whole, as json lines or, for exports only, csv; the driver holds one partition of it at a time."""
        if form == "json":
            yield from (r.json + "\n" for r in render.to_json(df).toLocalIterator())
        elif form == "csv":
            if not export:
                raise ValueError("csv is for exports")
            yield from render.csv_rows(df.columns, df.toLocalIterator())
        else:
            raise ValueError(f"unknown format {form!r}")

    def write_export(self, what: str, path: str) -> None:
        """An export as one CSV file at the local ``path``, line by line; the members of a group of duplicates stand in one cell, joined by semicolons."""
        df = self.export(what)
        with open(path, "w", encoding="utf-8", newline="") as out:
            rows = df.toLocalIterator()
            if what == "duplicates":
                out.writelines(render.csv_grouped(df.columns, rows, "declaration", "declarations"))
            else:
                out.writelines(render.csv_rows(df.columns, rows))

    def emit(self, df: DataFrame, form: str = "text", title: str = "", export: bool = False) -> str:
        """Text: the first ``limit`` rows, with a line that says so if there are more. Json lines and, for exports only, csv: all rows."""
        if form == "text":
            got = df.limit(self.limit + 1).collect()
            return render.table(title, got[: self.limit], df.columns, len(got) > self.limit)
        return "".join(self.lines(df, form, export))


def run(spark: SparkSession, argv: list[str], corpus: Corpus | None = None) -> str:
    """A command line as text: [options] command [arguments]; without a command the summary. Raises ValueError or KeyError for what is unknown."""
    p = argparse.ArgumentParser("proofloom", exit_on_error=False)
    p.add_argument("command", nargs="?", default="summary")
    p.add_argument("arguments", nargs="*")
    p.add_argument("--tables", default="")
    p.add_argument("--import", dest="snapshots", action="append", default=[])
    p.add_argument("--format", default="text", choices=("text", "json", "csv"))
    p.add_argument("--layer", default=None, choices=(*LAYERS, "both"))
    p.add_argument("--lens", default="all")
    for name, default in (("limit", 100), ("max-depth", 32), ("min-size", 4), ("support", 2)):
        p.add_argument(f"--{name}", type=int, default=default)
    for flag in ("include-generated", "include-infrastructure", "internal-only", "source-backed-only", "weighted", "alpha", "transitive"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--kind")
    p.add_argument("--module")
    p.add_argument("--step", type=int)
    try:
        o = p.parse_args(argv)
    except (argparse.ArgumentError, SystemExit) as error:
        raise ValueError(str(error)) from error
    if corpus is None and not (o.tables or o.snapshots):
        raise ValueError("name tables or at least one snapshot")
    chosen = AnalysisFilter(o.include_generated, o.include_infrastructure, o.internal_only, o.source_backed_only, o.kind, o.module, None if o.layer == "both" else o.layer)
    options = {"filter": chosen, "limit": o.limit, "max_depth": o.max_depth, "minimum_size": o.min_size, "support": o.support, "mode": "alpha" if o.alpha else "exact", "weighted": o.weighted, "both_layers": o.layer == "both"}
    e = Engine(spark, o.tables, source=corpus, **options) if corpus or o.tables else Engine.of_snapshots(spark, o.snapshots, **options)
    a, form = o.arguments, o.format
    if form == "csv" and o.command != "export":
        raise ValueError("csv is for exports")

    def tables(named: dict) -> str:
        if form == "json":
            return "".join(f'{{"section":"{k}"}}\n' + (e.emit(v, "json") if isinstance(v, DataFrame) else render.json_text(v) + "\n") for k, v in named.items())
        return "\n".join(e.emit(v, "text", k) if isinstance(v, DataFrame) else text.value(k, v) for k, v in named.items())

    one = lambda df, title: e.emit(df, form, title)
    commands = {
        "summary": lambda: text.summary(e.summary_report(), e.limit) if form == "text" else tables(e.summary_report()),
        "declaration": lambda: text.declaration(e.declaration_report(a[0]), e.limit) if form == "text" else tables(e.declaration_report(a[0])),
        "proof-steps": lambda: text.proof_steps(e.proof_steps(a[0], o.step)) if form == "text" else render.json_text(e.proof_steps(a[0], o.step)) + "\n",
        "dependencies": lambda: text.dependencies(a[0], e.dependencies(a[0], o.transitive), None if o.transitive else e.rollups(a[0]), e.limit) if form == "text" else one(e.dependencies(a[0], o.transitive), ""),
        "dependents": lambda: text.dependencies(a[0], e.dependents(a[0], o.transitive), None if o.transitive else e.rollups(a[0], True), e.limit) if form == "text" else one(e.dependents(a[0], o.transitive), ""),
        "path": lambda: text.path(e.path(a[0], a[1]).first()) if form == "text" else one(e.path(a[0], a[1]), ""),
        "rank": lambda: render.ranking(a[0], e.rank(a[0]).collect()) if form == "text" else one(e.rank(a[0]), ""),
        "compare": lambda: text.comparison(e.compare(a[0], a[1]).collect()) if form == "text" else one(e.compare(a[0], a[1]), ""),
        "duplicates": lambda: text.groups("Duplicates", e.duplicates(), e.limit) if form == "text" else one(e.duplicates(), ""),
        "repeated-structures": lambda: text.groups("Repeated structures", e.repeated(), e.limit) if form == "text" else one(e.repeated(), ""),
        "modules": lambda: one(e.modules().orderBy(F.desc("occurrences"), "source_module", "target_module", "layer"), "Modules"),
        "graph": lambda: text.graph(e.graph(), e.limit) if form == "text" else tables(e.graph()),
        "discover": lambda: text.discovery(e.discover(o.lens), e.limit) if form == "text" else tables(e.discover(o.lens)),
        "inspect": lambda: text.lenses(a[0], e.inspect(a[0], o.lens), e.limit) if form == "text" else tables(e.inspect(a[0], o.lens)),
        "rankings": lambda: one(e.rankings(*a[:1]), "Theorems"),
        "search": lambda: one(e.search(a[0]), "Search"),
        "validate": lambda: one(e.violations(), "Violations"),
        "export": lambda: e.emit(e.export(a[0]), form if form != "text" else "csv", export=True),
        "help": p.format_help,
    }
    if o.command not in commands:
        raise ValueError(f"unknown command {o.command!r}")
    try:
        return commands[o.command]()
    except IndexError as error:
        raise ValueError(f"{o.command} needs more arguments") from error
