"""Listings, summaries, distributions, rankings and direct dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.operators import metrics
from proofloom.operators.filters import AnalysisFilter, visibility
from proofloom.plans.corpus import Corpus

DEFAULT = AnalysisFilter()


def module_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences by source module, target module and layer."""
    _, edges = Corpus(spark, d).filtered(DEFAULT)
    return metrics.module_rollup(edges)


def declarations_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = DEFAULT.declarations(Corpus(spark, d).declarations)
    return rows.select("decl_id", "name", "kind", "module_name", visibility().alias("visibility"), "has_value", F.col("start_line").isNotNull().alias("source_backed"), "type_text", F.col("generation_kind").isNotNull().alias("generated"), F.col("doc_string").isNotNull().alias("documented"))


def symbols_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = DEFAULT.symbols(Corpus(spark, d).symbols)
    return rows.select("name", "kind", "module_name", F.col("decl_id").isNotNull().alias("in_corpus"))


def edges_filtered(spark: SparkSession, d: str) -> DataFrame:
    _, edges = Corpus(spark, d).filtered(DEFAULT)
    return edges.select("source", "target", "layer", "occurrences", "target_in_corpus", "target_kind", "target_module")


def edges_internal_proof(spark: SparkSession, d: str) -> DataFrame:
    _, edges = Corpus(spark, d).filtered(AnalysisFilter(internal_only=True, source_backed_only=True, kind="theorem", layer="proof"))
    return edges.select("source", "target", "occurrences")


def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    declarations, edges = c.filtered(DEFAULT)
    return metrics.summary(declarations, edges, c.expressions, DEFAULT.symbols(c.symbols))


def counts_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return metrics.group_counts(DEFAULT.declarations(Corpus(spark, d).declarations), "kind")


def counts_by_module(spark: SparkSession, d: str) -> DataFrame:
    return metrics.group_counts(DEFAULT.declarations(Corpus(spark, d).declarations), "module_name")


def breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Counts and size distributions by kind, by module and by visibility."""
    c = Corpus(spark, d)
    return metrics.breakdown(AnalysisFilter.all().declarations(c.declarations).withColumn("visibility", visibility()), c.expressions)


def size_distribution(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    sizes = c.expressions.join(DEFAULT.declarations(c.declarations), "decl_id", "left_semi")
    return metrics.distribution(sizes, ["layer"], "total_occurrences")


def size_histogram(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    sizes = c.expressions.join(DEFAULT.declarations(c.declarations), "decl_id", "left_semi")
    return metrics.histogram(sizes, "layer", "total_occurrences")


def declaration_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    declarations, edges = c.filtered(DEFAULT)
    return metrics.declaration_metrics(declarations, edges, c.expressions)


def constant_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return metrics.constant_frequencies(Corpus(spark, d).expressions)


def _rank(metric: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        c = Corpus(spark, d)
        declarations = DEFAULT.declarations(c.declarations)
        edges = c.filtered(DEFAULT)[1] if metric.endswith("dependencies") else None
        return metrics.rank(declarations, edges, c.expressions, metric, 100)

    query.__name__ = f"rank_{metric.replace('-', '_')}"
    return query


def direct_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Targets of every declaration in (target, layer) order, at most 500 each, with a mark where more were cut off."""
    _, edges = Corpus(spark, d).filtered(DEFAULT)
    return metrics.neighbours(edges, "source", "target", 500)


def direct_dependents(spark: SparkSession, d: str) -> DataFrame:
    _, edges = Corpus(spark, d).filtered(DEFAULT)
    return metrics.dependents_counts(edges)


def dependency_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of every declaration's dependencies by target module and by target kind."""
    _, edges = Corpus(spark, d).filtered(DEFAULT)
    return metrics.rollups(edges, "source", "target")


def dependents_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of every target's dependents by source module and by source kind."""
    _, edges = Corpus(spark, d).filtered(DEFAULT)
    return metrics.rollups(edges, "target", "source")


def dependents_listed(spark: SparkSession, d: str) -> DataFrame:
    """Sources of every target in (source, layer) order, at most 500 each, with a mark where more were cut off."""
    _, edges = Corpus(spark, d).filtered(DEFAULT)
    return metrics.neighbours(edges, "target", "source", 500)


def search(spark: SparkSession, d: str) -> DataFrame:
    """Visible declarations whose name or type text holds the query, names first, then by direct dependents."""
    c = Corpus(spark, d)
    return metrics.search(c.declarations, c.edges, "hinge", 12)


def trust(spark: SparkSession, d: str) -> DataFrame:
    rows = Corpus(spark, d).declarations.where("kind = 'theorem' and not hidden")
    return rows.select(
        "name", F.array_join(F.array_sort(F.array_distinct(F.filter(F.coalesce("axioms", F.array()), lambda x: x.isNotNull()))), ";").alias("axioms"), F.coalesce("is_unsafe", F.lit(False)).alias("is_unsafe"),
        F.coalesce("is_partial", F.lit(False)).alias("is_partial"), F.col("start_line").isNotNull().alias("source_available"), F.col("doc_string").isNotNull().alias("doc_available"), F.coalesce("has_value", F.lit(False)).alias("has_proof"),
    )


def export_nodes(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    return metrics.export_nodes(DEFAULT.declarations(c.declarations), c.expressions)


def export_edges(spark: SparkSession, d: str) -> DataFrame:
    _, edges = Corpus(spark, d).filtered(DEFAULT)
    return edges.select(
        "source", "target", F.initcap("layer").alias("layer"), "occurrences", "target_in_corpus", "source_module", "target_module", "target_kind", "target_is_class", "target_is_instance", "target_is_projection"
    )


def export_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    return metrics.export_metrics(DEFAULT.declarations(c.declarations), c.expressions)


def merged_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Declarations and all that edges name merged as symbols, the first part's row wins; with where each came from."""
    c = Corpus(spark, d)
    from proofloom.sources.snapshot import merge_symbols

    base = c.declarations.select("name", "kind", "module_name")
    other = c.edges.select(F.col("target").alias("name"), F.col("target_kind").alias("kind"), F.col("target_module").alias("module_name")).groupBy("name").agg(F.max("kind").alias("kind"), F.max("module_name").alias("module_name"))
    return merge_symbols([base, other])


RANKS = [f"{side}-{m}" for side in ("statement", "proof") for m in ("occurrences", "unique-nodes", "constants", "dependencies")] + ["axioms"]
QUERIES = {
    f.__name__: f
    for f in (
        module_rollup, declarations_filtered, symbols_filtered, edges_filtered, edges_internal_proof, corpus_summary, counts_by_kind, counts_by_module, breakdown, size_distribution, size_histogram,
        declaration_metrics, constant_frequencies, *map(_rank, RANKS), direct_dependencies, direct_dependents, dependency_rollups, search, trust, export_nodes, export_edges, export_metrics, merged_symbols, dependents_rollups, dependents_listed,
    )
}

BASE = """d as (select distinct on (decl_id) *, generation_kind is not null or coalesce(is_internal, false) or coalesce(is_private, false) hidden from declarations order by decl_id, received_at desc),
sym as (select name, kind, module_name, is_class, is_instance, is_projection, hidden, decl_id from d union all
  select name, kind, module_name, is_class, is_instance, is_projection, generation_kind is not null or coalesce(is_internal, false) or coalesce(is_private, false), null from library_symbols where name not in (select name from d)),
e0 as (select distinct on (source_id, target, layer) * from dependency_edges where target is not null order by source_id, target, layer, received_at desc),
e as (select e0.source_id, e0.source, e0.target, sym.decl_id target_id, e0.layer, e0.occurrences, e0.source_module, e0.source_kind, coalesce(sym.module_name, e0.target_module) target_module,
  coalesce(sym.kind, e0.target_kind) target_kind, sym.decl_id is not null target_in_corpus, coalesce(sym.is_class, e0.target_is_class, false) target_is_class,
  coalesce(sym.is_instance, e0.target_is_instance, false) target_is_instance, coalesce(sym.is_projection, e0.target_is_projection, false) target_is_projection, coalesce(sym.hidden, false) target_hidden
  from e0 left join sym on e0.target = sym.name),
v as (select * from d where not hidden),
f as (select * from e where not target_hidden and not target_is_class and not target_is_instance and not target_is_projection and source_id in (select decl_id from v)),
x as (select distinct on (decl_id, layer) * from expression_metrics order by decl_id, layer, received_at desc),
xv as (select * from x where decl_id in (select decl_id from v))"""

_Q = "round({f}, 6) {n}"


def _dist(column: str) -> str:
    parts = [f"count({column}) count", f"min({column}) min", f"max({column}) max", f"round(avg({column}), 6) mean", f"round(stddev_pop({column}), 6) stddev"]
    parts += [f"round(quantile_cont({column}, {q / 100}), 6) p{q}" for q in (50, 75, 90, 95, 99)]
    return ", ".join(parts)


def _rank_sql(metric: str) -> str:
    side, _, what = metric.partition("-")
    if metric == "axioms":
        value = "select decl_id, len(list_distinct(list_filter(axioms, lambda a: a is not null))) val from v"
    elif what == "dependencies":
        value = f"select source_id decl_id, count(*) val from f where layer = '{side}' group by 1"
    else:
        column = {"occurrences": "total_occurrences", "unique-nodes": "unique_nodes", "constants": "distinct_constants"}[what]
        value = f"select decl_id, {column} val from x where layer = '{side}'"
    return f"""with {BASE}, vals as ({value}), r as (select v.name, coalesce(vals.val, 0)::bigint as "value" from v left join vals on v.decl_id = vals.decl_id)
select rank, name, "value" from (select row_number() over (order by "value" desc, name) rank, name, "value" from r) where rank <= 100"""


SQL = {
    "module_rollup": f"with {BASE} select coalesce(source_module, '<unknown>') source_module, coalesce(target_module, '<unknown>') target_module, layer, sum(occurrences)::bigint occurrences from f group by 1, 2, 3",
    "declarations_filtered": f"with {BASE} select decl_id, name, kind, module_name, case when is_internal then 'internal' when is_private then 'private' else 'public' end visibility, has_value, start_line is not null source_backed, type_text, generation_kind is not null as generated, doc_string is not null documented from v",
    "symbols_filtered": f"with {BASE} select name, kind, module_name, decl_id is not null in_corpus from sym where not hidden and not coalesce(is_class, false) and not coalesce(is_instance, false) and not coalesce(is_projection, false)",
    "edges_filtered": f"with {BASE} select source, target, layer, occurrences, target_in_corpus, target_kind, target_module from f",
    "edges_internal_proof": f"with {BASE} select source, target, occurrences from f where target_in_corpus and layer = 'proof' and source_id in (select decl_id from v where kind = 'theorem' and start_line is not null)",
    "corpus_summary": f"""with {BASE} select (select count(*) from v) declarations, (select count(*) from v where kind = 'theorem') theorems, (select count(*) from v where has_value) with_value,
(select count(*) from v where start_line is not null) source_backed, (select count(distinct module_name) from v) modules, (select count(generation_kind) from v) as generated,
(select count(*) from sym where not hidden and not coalesce(is_class, false) and not coalesce(is_instance, false) and not coalesce(is_projection, false)) symbols,
(select sum(total_occurrences)::bigint from xv where layer = 'statement') statement_occurrences, (select sum(unique_nodes)::bigint from xv where layer = 'statement') statement_unique_nodes,
(select sum(total_occurrences)::bigint from xv where layer = 'proof') proof_occurrences, (select sum(unique_nodes)::bigint from xv where layer = 'proof') proof_unique_nodes,
(select count(*) from f) edges, (select count(*) from f where target_in_corpus) internal_edges, (select sum(occurrences)::bigint from f) edge_occurrences""",
    "counts_by_kind": f"with {BASE} select coalesce(kind, '<unknown>') kind, count(*) declarations from v group by 1",
    "counts_by_module": f"with {BASE} select coalesce(module_name, '<unknown>') module_name, count(*) declarations from v group by 1",
    "breakdown": f"""with {BASE}, w as (select decl_id, coalesce(kind, '<unknown>') kind, coalesce(module_name, '<unknown>') module_name, case when is_internal then 'internal' when is_private then 'private' else 'public' end visibility from d),
s as (select decl_id, max(total_occurrences) filter (layer = 'statement') statement_size, max(total_occurrences) filter (layer = 'proof') proof_size from x group by 1),
g as (select 'kind' dimension, kind as "value", decl_id from w union all select 'module', module_name, decl_id from w union all select 'visibility', visibility, decl_id from w)
select dimension, "value", count(*) declarations, round(avg(statement_size), 6) statement_mean, max(statement_size) statement_max, round(quantile_cont(statement_size, 0.5), 6) statement_median,
round(avg(proof_size), 6) proof_mean, max(proof_size) proof_max, round(quantile_cont(proof_size, 0.5), 6) proof_median from g left join s on g.decl_id = s.decl_id group by 1, 2""",
    "size_distribution": f"with {BASE} select layer, {_dist('total_occurrences')} from xv group by 1",
    "size_histogram": f"""with {BASE}, b as (select unnest([10, 50, 100, 250, 500, 1000, 2500, 5000]) as hi), bs as (select lag(hi) over (order by hi) lo, hi from b union all select 5000, null),
l as (select distinct layer from xv) select l.layer, lo::bigint lower, hi::bigint upper, count(xv.decl_id) "count" from l cross join bs left join xv on xv.layer = l.layer and (lo is null or total_occurrences >= lo) and (hi is null or total_occurrences < hi) group by 1, 2, 3""",
    "declaration_metrics": f"""with {BASE}, dep as (select source_id decl_id, layer, count(*) filter (target_in_corpus) internal_dependencies, count(*) filter (not target_in_corpus) external_dependencies, count(distinct target_module) modules_referenced from f group by 1, 2)
select v.name, xv.layer, case when xv.layer = 'statement' then 'statement' when v.kind = 'theorem' then 'proof' else 'implementation' end label, total_occurrences, unique_nodes, round(total_occurrences / nullif(unique_nodes, 0), 6) compression, distinct_constants,
coalesce(internal_dependencies, 0) internal_dependencies, coalesce(external_dependencies, 0) external_dependencies, coalesce(modules_referenced, 0) modules_referenced
from xv join v on xv.decl_id = v.decl_id left join dep on dep.decl_id = xv.decl_id and dep.layer = xv.layer""",
    "constant_frequencies": f"""with {BASE}, c as (select decl_id, layer, unnest(constant_frequencies) c from x), g as (select decl_id, layer, c.name as name, sum(coalesce(c.occurrences, 0))::bigint occurrences from c where c.name is not null group by 1, 2, 3)
select *, row_number() over (partition by decl_id, layer order by occurrences desc, name) place from g""",
    **{f"rank_{m.replace('-', '_')}": _rank_sql(m) for m in RANKS},
    "direct_dependencies": f"""with {BASE}, r as (select source, target, layer, occurrences, row_number() over (partition by source order by target, layer) place, count(*) over (partition by source) n from f)
select source, target, layer, occurrences, place, n > 500 truncated from r where place <= 500""",
    "direct_dependents": f"with {BASE} select target, count(distinct source) direct_dependents, count(*) edges, sum(occurrences)::bigint occurrences from f group by 1",
    "dependency_rollups": f"""with {BASE} select source, 'module' as rollup, coalesce(target_module, '<unknown>') as "value", sum(occurrences)::bigint occurrences from f group by all
union all select source, 'kind', coalesce(target_kind, '<unknown>'), sum(occurrences)::bigint from f group by all""",
    "search": f"""with {BASE}, dep as (select target_id, count(distinct source_id) direct_dependents from e where target_id is not null group by 1)
select name, contains(lower(name), 'hinge') name_match, coalesce(direct_dependents, 0) direct_dependents from v left join dep on v.decl_id = dep.target_id
where contains(lower(name), 'hinge') or contains(lower(coalesce(type_text, '')), 'hinge') order by 2 desc, 3 desc, 1 limit 12""",
    "trust": f"""with {BASE} select name, array_to_string(list_sort(list_distinct(list_filter(coalesce(axioms, []), lambda a: a is not null))), ';') axioms, coalesce(is_unsafe, false) is_unsafe, coalesce(is_partial, false) is_partial,
start_line is not null source_available, doc_string is not null doc_available, coalesce(has_value, false) has_proof from v where kind = 'theorem'""",
    "export_nodes": f"""with {BASE} select v.name id, split_part(v.name, '.', -1) display_name, v.module_name as "module", v.kind, v.generation_kind is not null generated, start_line is not null source_backed,
coalesce(a.total_occurrences, 0) statement_occurrences, coalesce(b.total_occurrences, 0) value_occurrences from v left join x a on a.decl_id = v.decl_id and a.layer = 'statement' left join x b on b.decl_id = v.decl_id and b.layer = 'proof'""",
    "export_edges": f"with {BASE} select source, target, upper(layer[1]) || layer[2:] layer, occurrences, target_in_corpus, source_module, target_module, target_kind, target_is_class, target_is_instance, target_is_projection from f",
    "export_metrics": f"""with {BASE}, w as (select decl_id, max(total_occurrences) filter (layer = 'statement') statement_occurrences, max(unique_nodes) filter (layer = 'statement') statement_unique_nodes, max(distinct_constants) filter (layer = 'statement') statement_dependencies,
  max(total_occurrences) filter (layer = 'proof') value_occurrences, max(unique_nodes) filter (layer = 'proof') value_unique_nodes, max(distinct_constants) filter (layer = 'proof') value_dependencies from x group by 1)
select name, coalesce(module_name, '') "module", kind, generation_kind is not null as generated, start_line is not null source_backed, doc_string is not null has_documentation, coalesce(len(list_distinct(list_filter(axioms, lambda a: a is not null))), 0) axiom_count,
coalesce(w.statement_occurrences, 0) statement_occurrences, coalesce(w.statement_unique_nodes, 0) statement_unique_nodes, 0::bigint statement_depth, coalesce(w.statement_dependencies, 0) statement_dependencies,
coalesce(w.value_occurrences, 0) value_occurrences, coalesce(w.value_unique_nodes, 0) value_unique_nodes, 0::bigint value_depth, coalesce(w.value_dependencies, 0) value_dependencies from v left join w on v.decl_id = w.decl_id""",
    "dependents_rollups": f"""with {BASE} select target, 'module' as rollup, coalesce(source_module, '<unknown>') as "value", sum(occurrences)::bigint occurrences from f group by all
union all select target, 'kind', coalesce(source_kind, '<unknown>'), sum(occurrences)::bigint from f group by all""",
    "dependents_listed": f"""with {BASE}, r as (select source, target, layer, occurrences, row_number() over (partition by target order by source, layer) place, count(*) over (partition by target) n from f)
select target, source, layer, occurrences, place, n > 500 truncated from r where place <= 500""",
    "merged_symbols": f"""with {BASE} select name, kind, module_name, 0 snapshot from d union all
select target, max(target_kind), max(target_module), 1 from e where target not in (select name from d) group by 1""",
}
