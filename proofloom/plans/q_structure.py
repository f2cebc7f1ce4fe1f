"""Expression structure, similarity of declarations, equivalence groups, proof steps and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions import dag
from proofloom.functions.text import node_label
from proofloom.operators import groups, proof, structure, validate
from proofloom.operators.filters import AnalysisFilter
from proofloom.plans import core_p, core_p_sql
from proofloom.plans.corpus import Corpus
from proofloom.plans.q_metrics import BASE
from proofloom.session import cut
from proofloom.sources.tables import latest, table

DEFAULT = AnalysisFilter()
ONCE = "filter(raw_steps, (x, i) -> x is not null and x.id is not null and array_position(transform(raw_steps, s -> s.id), x.id) = i + 1)"


def _told(spark: SparkSession, d: str, fields: list[str], extra: list[str] | None = None) -> DataFrame:
    """outline_id, ``extra`` and the distinct steps (by id) of every outline, of proof_outlines and of the whole payloads of raw_outlines, with ``fields`` of each step."""
    rows = core_p.outlines(spark, d, [f"raw_steps.{f}" for f in dict.fromkeys(["id", *fields])], extra=extra).drop("received_at")
    return rows.withColumn("raw_steps", F.expr(ONCE))


def _steps(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """outline_id, conclusion_step and the distinct steps of every outline, exploded to ``fields``."""
    rows = _told(spark, d, list(fields), ["conclusion_step"]).select("outline_id", "conclusion_step", F.explode("raw_steps").alias("s"))
    return rows.select("outline_id", "conclusion_step", F.col("s.id").alias("step_id"), *[F.col(f"s.{f}").alias(f) for f in fields])


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _told(spark, d, ["kind", "proposition", "prerequisite_steps", "named_references"], ["conclusion_step"]).select("outline_id", "conclusion_step", F.col("raw_steps").alias("steps"))


def _graphs(spark: SparkSession, d: str) -> DataFrame:
    """outline_id, declaration, step_id, context_id (null for the step's proposition), root and nodes of the propositions and the context entries' types, over
    proof_outlines and the whole payloads of raw_outlines. Steps and entries count once by their ids; an unknown declaration of a payload is told by its outline."""
    graphs = [f"raw_steps.{at}.{f}" for at in ("proposition_graph", "context.type_graph") for f in ("root", "nodes")]
    rows = core_p.outlines(spark, d, ["raw_steps.id", "raw_steps.context.id", *graphs]).drop("received_at")
    names = latest(table(spark, d, "declarations"), ["decl_id"], keep=["name"])
    raw = table(spark, d, "raw_outlines").groupBy("outline_id").agg(F.max("decl_id").alias("decl_id")).join(names.hint("merge"), "decl_id", "left")
    owners = Corpus(spark, d).outlines_of(["declaration"]).unionByName(raw.select("outline_id", F.coalesce("name", F.concat(F.lit("outline:"), "outline_id")).alias("declaration")))
    steps = rows.join(owners.hint("merge"), "outline_id").select("outline_id", "declaration", F.explode(F.expr(ONCE)).alias("s"))
    entries = "filter(s.context, (x, i) -> x is not null and (x.id is null or array_position(transform(s.context, c -> c.id), x.id) = i + 1))"
    own = "array(named_struct('context_id', cast(null as string), 'graph', s.proposition_graph))"
    both = F.expr(f"concat({own}, coalesce(transform({entries}, x -> named_struct('context_id', x.id, 'graph', x.type_graph)), array()))")
    parts = steps.select("outline_id", "declaration", F.col("s.id").alias("step_id"), F.posexplode(both).alias("place", "g"))  # place 0 is the proposition
    return parts.select("outline_id", "declaration", "step_id", "place", "g.context_id", "g.graph.root", "g.graph.nodes")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return cut(dag.node_rows(_graphs(spark, d), ["outline_id", "declaration", "step_id", "place", "context_id"]), "expression-nodes")


def expression_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, occurrences, depth and distinct constants of every step's proposition (context_id null) and of the types of its context entries."""
    n = _nodes(spark, d)
    return n.groupBy("outline_id", "step_id", "place", "context_id").agg(
        F.count(F.lit(1)).alias("unique_nodes"), F.sum("multiplicity").alias("occurrences"), F.max(F.when(F.col("is_root"), F.col("depth"))).alias("depth"),
        F.countDistinct(F.when(F.col("kind") == "constant", F.col("name"))).alias("constants"),
    ).drop("place")


def kind_proportions(spark: SparkSession, d: str) -> DataFrame:
    """Unique nodes and occurrences of each node kind in all outlines' propositions and context types; the tables hold no graphs of declarations."""
    return _nodes(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("unique_nodes"), F.sum("multiplicity").alias("occurrences"))


def duplicates_exact(spark: SparkSession, d: str) -> DataFrame:
    return structure.duplicates(_nodes(spark, d))


def duplicates_alpha(spark: SparkSession, d: str) -> DataFrame:
    return structure.duplicates(_nodes(spark, d), "alpha")


def repeated_structures(spark: SparkSession, d: str) -> DataFrame:
    return structure.repeated(_nodes(spark, d))


def repeated_for_declaration(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return structure.repeated_by_declaration(nodes, structure.repeated(nodes))


def node_labels(spark: SparkSession, d: str) -> DataFrame:
    """How often each node label stands in the propositions of all outlines."""
    nodes = _steps(spark, d, "proposition_graph").select(F.explode("proposition_graph.nodes").alias("n")).where("n is not null")
    return nodes.groupBy(node_label(F.col("n")).alias("label")).agg(F.count(F.lit(1)).alias("nodes"))


def _features(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    deps = latest(table(spark, d, "declarations"), ["decl_id"], keep=["name", "statement_dependencies", "proof_dependencies"])
    both = F.explode(F.array(F.struct(F.lit("statement").alias("layer"), F.col("statement_dependencies").alias("d")), F.struct(F.lit("proof").alias("layer"), F.col("proof_dependencies").alias("d"))))
    sets = deps.select("decl_id", "name", both.alias("x")).select("decl_id", "name", "x.layer", F.array_distinct(F.filter(F.coalesce("x.d", F.array()), lambda v: v.isNotNull())).alias("deps"))
    return sets.join(c.expressions.select("decl_id", "layer", "unique_nodes", "total_occurrences"), ["decl_id", "layer"])


def compare_declarations(spark: SparkSession, d: str) -> DataFrame:
    """The compared pairs, measured again from the corpus."""
    pairs = table(spark, d, "declaration_comparisons").select("comparison_id", "left_name", "right_name", "layer").distinct()
    return structure.compare(pairs, _features(spark, d))


def neighbors_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest theorems of every hundredth theorem, by statement."""
    theorems = DEFAULT.declarations(Corpus(spark, d).declarations).where("kind = 'theorem'").select("decl_id")
    rows = cut(_features(spark, d).where("layer = 'statement'").join(theorems, "decl_id", "left_semi"), "features")
    return structure.neighbours(rows.select("name", "deps", "unique_nodes"), rows.where("decl_id % 100 = 0").select("name"))


def _ends(spark: SparkSession, d: str, seen=None) -> tuple[DataFrame, DataFrame]:
    """(end points of the declarations that are shown, the edges between different ones)."""
    c = Corpus(spark, d)
    rows = c.declarations.where(~F.col("hidden") if seen is None else seen).select("decl_id", "name", "kind", "type_text")
    ends = groups.endpoints(rows, c.fingerprints)
    return ends, cut(groups.between(c.filtered(DEFAULT)[1], ends), "between")


def equivalence_groups(spark: SparkSession, d: str) -> DataFrame:
    """Visible declarations of the same kind and statement."""
    c = Corpus(spark, d)
    found = groups.equivalence_groups(DEFAULT.declarations(c.declarations).select("decl_id", "name", "kind", "type_text"), c.fingerprints).where("members > 1")
    return found.select("group_id", F.concat(F.lit("group:"), "representative").alias("endpoint"), "kind", "members", "first_member")


def equivalence_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Groups of conclusions that are equal up to the names of binders."""
    steps = _steps(spark, d, "kind", "proposition").where("step_id = conclusion_step").select("outline_id", "step_id", F.col("kind").alias("step_kind"), "proposition")
    roots = _nodes(spark, d).where("is_root and place = 0").select("outline_id", "step_id", "declaration", "alpha").join(steps, ["outline_id", "step_id"])
    best = F.min(F.struct(F.octet_length("proposition").alias("n"), F.col("declaration")))
    groups = roots.groupBy("step_kind", "alpha").agg(F.countDistinct("declaration").alias("members"), best.alias("b"))
    return groups.where("members > 1").select(F.col("alpha").alias("group_id"), "members", F.col("b.declaration").alias("representative"))


def grouped_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between groups and single declarations, from the prerequisite to its user."""
    return groups.grouped_edges(_ends(spark, d)[1])


def group_dependents(spark: SparkSession, d: str) -> DataFrame:
    return groups.dependents(_ends(spark, d)[1])


def theorem_edges(spark: SparkSession, d: str) -> DataFrame:
    """Grouped edges where only theorems are shown."""
    return groups.grouped_edges(_ends(spark, d, groups.shown(definitions=False))[1])


def top_labels(spark: SparkSession, d: str) -> DataFrame:
    """The five end points that most declarations use."""
    ends, met = _ends(spark, d)
    return groups.labels(groups.graph(met, ends))


def bootstrap_counts(spark: SparkSession, d: str) -> DataFrame:
    """Visible declarations and theorems, theorems with an outline, groups of several, and connections between end points."""
    c = Corpus(spark, d)
    own = DEFAULT.declarations(c.declarations)
    ends, met = _ends(spark, d)
    parts = [
        own.agg(F.count(F.lit(1)).alias("declarations"), F.count_if(F.col("kind") == "theorem").alias("theorems")), bootstrap(spark, d).agg(F.count(F.lit(1)).alias("outlined")),
        ends.where("group_size > 1").agg(F.countDistinct("endpoint").alias("groups")), groups.grouped_edges(met).agg(F.count(F.lit(1)).alias("connections")),
    ]
    names = [x for p in parts for x in p.columns]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).agg(*[F.max(x).alias(x) for x in names])


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Visible theorems that have a proof outline."""
    c = Corpus(spark, d)
    outlined = table(spark, d, "proof_outlines").select("decl_id").distinct()
    return DEFAULT.declarations(c.declarations).where("kind = 'theorem'").join(outlined, "decl_id", "left_semi").select("name", "module_name")


def witness_edges(spark: SparkSession, d: str) -> DataFrame:
    """For every pair of endpoints the first edge that witnesses it, by source, target and layer."""
    return groups.first_witnesses(_ends(spark, d)[1])


def proof_edges(spark: SparkSession, d: str) -> DataFrame:
    return proof.per_record(_records(spark, d), ["outline_id"], proof.edge_rows, "prerequisite bigint, step bigint")


def proof_closure(spark: SparkSession, d: str) -> DataFrame:
    """Direct prerequisites and dependents and all that every step rests on."""
    return proof.per_record(_records(spark, d), ["outline_id"], proof.closure_rows, "step bigint, prerequisites bigint, dependents bigint, ancestors bigint")


def proof_paths(spark: SparkSession, d: str) -> DataFrame:
    """How many ways lead from every step to the conclusion, the longest, and how many of them ``proof_paths_listed`` lists."""
    return proof.per_record(_records(spark, d), ["outline_id"], proof.path_rows, "step bigint, listed bigint, longest bigint, truncated boolean, paths string")


def proof_paths_listed(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred ways of every step to the conclusion."""
    rows = proof.per_record(_records(spark, d), ["outline_id"], proof.listed_paths, "step bigint, place bigint, path array<bigint>")
    return rows.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


def proof_prerequisites(spark: SparkSession, d: str) -> DataFrame:
    """Every step with the ids of its direct prerequisites, direct dependents and all it rests on."""
    names = ("direct_prerequisites", "direct_dependents", "transitive_prerequisites")
    rows = proof.per_record(_records(spark, d), ["outline_id"], proof.prerequisite_rows, "step bigint, " + ", ".join(f"{n} array<bigint>" for n in names))
    return rows.select("outline_id", "step", *[F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in names])


def proof_edge_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per outline the condensed edges, their ways and the longest."""
    return proof_outline_edges(spark, d).groupBy("outline_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("paths").alias("paths"), F.max("longest").alias("longest"))


def proof_outline(spark: SparkSession, d: str) -> DataFrame:
    return proof.per_record(_records(spark, d), ["outline_id"], proof.outline_node_rows, "step bigint, kind string, proposition string, candidates bigint")


def proof_outline_edges(spark: SparkSession, d: str) -> DataFrame:
    return proof.per_record(_records(spark, d), ["outline_id"], proof.outline_edge_rows, "source bigint, target bigint, paths bigint, longest bigint, sample string")


def outline_rarity(spark: SparkSession, d: str) -> DataFrame:
    """Per step the frequency, within its outline, of its rarest meaningful reference."""
    uses = _steps(spark, d, "named_references").select("outline_id", "step_id", F.explode("named_references").alias("name")).where(F.col("name").isNotNull() & proof.meaningful(F.col("name")))
    counts = uses.groupBy("outline_id", "name").agg(F.count(F.lit(1)).alias("uses"))
    return uses.join(counts, ["outline_id", "name"]).groupBy("outline_id", "step_id").agg(F.min("uses").alias("rarity"))


def validation_violations(spark: SparkSession, d: str) -> DataFrame:
    c = Corpus(spark, d)
    edges = table(spark, d, "dependency_edges").where("target is not null").select("source_id", "source", "target", "layer", "occurrences").distinct()
    return validate.corpus_rules(c.declarations, c.symbols, edges)


def validation_graphs(spark: SparkSession, d: str) -> DataFrame:
    graphs = _graphs(spark, d).select(F.concat_ws("/", "outline_id", "step_id", "context_id").alias("graph"), "root", "nodes")
    return validate.graph_shape(graphs, "graph")


def validation_steps(spark: SparkSession, d: str) -> DataFrame:
    fields = ["context.id", "context.kind", "scope", "proof_term_path", "kind", "prerequisite_steps", "hypothesis_references"]
    return validate.step_rules(core_p.outlines(spark, d, [f"raw_steps.{f}" for f in ["id", *fields]], extra=["complete", "truncation_reason", "conclusion_step"]))


def shared_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """For every compared pair the targets that both sides depend on, by the corpus's visible edges."""
    c = Corpus(spark, d)
    edges = c.filtered(DEFAULT)[1].select("source", "target").distinct()
    sets = cut(edges.groupBy("source").agg(F.sort_array(F.collect_list("target")).alias("targets")), "targets-of")  # as long as a declaration's own list
    pairs = table(spark, d, "declaration_comparisons").select("comparison_id", "left_name", "right_name").distinct()
    both = pairs.join(sets.toDF("left_name", "l"), "left_name").join(sets.toDF("right_name", "r"), "right_name")
    shared = F.array_sort(F.array_intersect("l", "r"))
    return both.select("comparison_id", F.size(shared).cast("bigint").alias("shared"), F.array_join(shared, ";").alias("targets"))


def declaration_dependents(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sources of every declaration, whatever the filter."""
    edges = Corpus(spark, d).edges.where("target_in_corpus")
    return edges.groupBy("target").agg(F.countDistinct("source_id").alias("direct_dependents"))


def visible_graph(spark: SparkSession, d: str) -> DataFrame:
    """The end points of the grouped graph: groups with several members, and single declarations, with their direct dependents."""
    ends, met = _ends(spark, d)
    return groups.graph(met, ends)


def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A digest of the names and statements of all declarations; the tables have no version and no imported modules."""
    return groups.fingerprint(Corpus(spark, d).declarations.select("decl_id", "name", F.col("type_text").alias("digest")), "", [])


def proof_layers(spark: SparkSession, d: str) -> DataFrame:
    """The layer of every step: one below the deepest of its prerequisites."""
    return proof.per_record(_records(spark, d), ["outline_id"], proof.layer_rows, "step bigint, layer bigint")


QUERIES = {
    f.__name__: f
    for f in (
        shared_dependencies, declaration_dependents, visible_graph, corpus_fingerprint, proof_layers, expression_sizes, kind_proportions, duplicates_exact, duplicates_alpha, repeated_structures, repeated_for_declaration, node_labels, compare_declarations, neighbors_top3, equivalence_groups,
        equivalence_graphs, grouped_edges, group_dependents, bootstrap, witness_edges, proof_edges, proof_closure, proof_paths, proof_outline, proof_outline_edges, outline_rarity, validation_violations,
        validation_graphs, validation_steps, theorem_edges, top_labels, bootstrap_counts, proof_paths_listed, proof_prerequisites, proof_edge_totals,
    )
}

FEATURES = f"""{BASE},
sets as (select decl_id, name, 'statement' layer, list_distinct(list_filter(coalesce(statement_dependencies, []), lambda a: a is not null)) deps from d
  union all select decl_id, name, 'proof', list_distinct(list_filter(coalesce(proof_dependencies, []), lambda a: a is not null)) from d),
ft as (select s.*, x.unique_nodes, x.total_occurrences from sets s join x on s.decl_id = x.decl_id and s.layer = x.layer)"""


def _ratio(a: str, b: str) -> str:
    return f"case when greatest({a}, {b}) > 0 then least({a}, {b})::double / greatest({a}, {b}) else 1.0 end"


_L, _IDS = core_p_sql._list, "[try_cast(a->>'$' as bigint) for a in {}]"
STEPS = f"""po as (select distinct on (outline_id) * from proof_outlines order by outline_id, received_at desc),
wh as (select outline_id, arg_max(payload::json, received_at) j from raw_outlines where json_valid(payload) group by 1),
rl as (select outline_id, try_cast(j->>'$.conclusionStep' as bigint) conclusion_step, j, {_L("(j->'$.rawSteps')")} steps from wh),
s0 as (select outline_id, conclusion_step, unnest(raw_steps) s, generate_subscripts(raw_steps, 1) pos from po),
j0 as (select outline_id, conclusion_step, unnest(steps) s, generate_subscripts(steps, 1) pos from rl),
s1 as (select outline_id, conclusion_step, pos, s.id step, s.kind kind, s.proposition proposition, s.prerequisite_steps pre, s.named_references refs, [n for n in s.proposition_graph.nodes if n is not null] nodes from s0 where s.id is not null
  union all select outline_id, conclusion_step, pos, try_cast(s->>'$.id' as bigint), s->>'$.kind', s->>'$.proposition', {_IDS.format(_L("(s->'$.prerequisiteSteps')"))}, [a->>'$' for a in {_L("(s->'$.namedReferences')")}],
  [struct_pack(id := try_cast(n->>'$.id' as bigint), kind := n->>'$.kind', children := {_IDS.format(_L("(n->'$.children')"))}, name := n->>'$.name', var_index := try_cast(n->>'$.index' as bigint), value_text := n->>'$.value',
    binder_info := n->>'$.binderInfo', universe_levels := [a->>'$' for a in {_L("(n->'$.universeLevels')")}]) for n in {_L("(s->'$.propositionGraph.nodes')")} if json_type(n) <> 'NULL'] from j0 where json_type(s) <> 'NULL' and try_cast(s->>'$.id' as bigint) is not null),
st as (select outline_id, conclusion_step, step, kind, proposition, pre, refs, nodes from (select *, row_number() over (partition by outline_id, step order by pos) k from s1) where k = 1)"""
_NODE = f"""case when json_type(n) = 'NULL' then null else struct_pack(id := try_cast(n->>'$.id' as bigint), kind := n->>'$.kind', children := {_IDS.format(_L("(n->'$.children')"))}, name := n->>'$.name', var_index := try_cast(n->>'$.index' as bigint),
  value_text := n->>'$.value', binder_info := n->>'$.binderInfo', universe_levels := [a->>'$' for a in {_L("(n->'$.universeLevels')")}]) end"""
_TYPED = "[case when n is null then null else struct_pack(id := n.id, kind := n.kind, children := n.children, name := n.name, var_index := n.var_index, value_text := n.value_text, binder_info := n.binder_info, universe_levels := n.universe_levels) end for n in {}]"
# gr: every proposition and context type (step, context_id, place, root, nodes) with a key gk; steps and entries count once by their ids
GRAPHS = f"""{STEPS},
t1 as (select outline_id, s.id step, s from s0 where s.id is not null qualify row_number() over (partition by outline_id, s.id order by pos) = 1),
j1 as (select outline_id, try_cast(s->>'$.id' as bigint) step, s from j0 where json_type(s) <> 'NULL' and try_cast(s->>'$.id' as bigint) is not null qualify row_number() over (partition by outline_id, step order by pos) = 1),
tc as (select outline_id, step, c, place from (select outline_id, step, unnest(s.context) c, generate_subscripts(s.context, 1) place from t1) where c is not null qualify c.id is null or row_number() over (partition by outline_id, step, c.id order by place) = 1),
jc0 as (select outline_id, step, {_L("(s->'$.context')")} l from j1),
jc as (select outline_id, step, c, place from (select outline_id, step, unnest(l) c, generate_subscripts(l, 1) place from jc0) where json_type(c) <> 'NULL' qualify c->>'$.id' is null or row_number() over (partition by outline_id, step, c->>'$.id' order by place) = 1),
g0 as (select outline_id, step, null::varchar context_id, 0 place, s.proposition_graph.root root, {_TYPED.format('s.proposition_graph.nodes')} nodes from t1
  union all select outline_id, step, c.id, place, c.type_graph.root, {_TYPED.format('c.type_graph.nodes')} from tc
  union all select outline_id, step, null, 0, try_cast(s->>'$.propositionGraph.root' as bigint), [{_NODE} for n in {_L("(s->'$.propositionGraph.nodes')")}] from j1
  union all select outline_id, step, c->>'$.id', place, try_cast(c->>'$.typeGraph.root' as bigint), [{_NODE} for n in {_L("(c->'$.typeGraph.nodes')")}] from jc),
gr as materialized (select *, concat_ws('/', outline_id, step, place) gk from g0)"""
# nd: the distinct nodes of each graph; lk: their children that are there; ways: a row for every way down from a root
NODES = f"""{GRAPHS},
nd as materialized (select gk, outline_id, step, place, context_id, root, n.id id, n.kind kind, n.name as name, n.var_index var_index, n.value_text value_text, n.binder_info binder_info, n.universe_levels universe_levels, n.children children
  from (select gk, outline_id, step, place, context_id, root, unnest(nodes) n, generate_subscripts(nodes, 1) pos from gr) where n is not null and n.id is not null qualify row_number() over (partition by gk, n.id order by pos) = 1),
lk as materialized (select a.gk, a.id, b.id child, a.pos from (select gk, id, unnest(children) c, generate_subscripts(children, 1) pos from nd) a join nd b on a.gk = b.gk and a.c = b.id),
ways as (select gk, id, 1 depth from nd where id = root union all select w.gk, lk.child, w.depth + 1 from ways w join lk on w.gk = lk.gk and w.id = lk.id where w.depth < 500)"""


def _digests(levels: int = 40) -> str:
    """``dg`` (gk, id, exact, alpha, size, depth) of every node, from the leaves up, and ``node``, these with what else a node has: multiplicity, is_root, declaration."""
    fields = lambda name: "''" + "".join(f" || coalesce(octet_length(encode(({f})::varchar))::varchar || ':' || ({f})::varchar, '-')" for f in ("nd.kind", name, "nd.var_index", "nd.value_text", "nd.binder_info"))
    tail = " || coalesce(array_to_string([coalesce(octet_length(encode(u))::varchar || ':' || u, '-') for u in nd.universe_levels], ''), '') || '|' || count(k.child) || '|' || coalesce(string_agg(d.{} , '' order by k.pos), '')"
    alpha = "case when nd.kind in ('lambda', 'forall', 'let') then null else nd.name end"
    own = f"md5(any_value({fields('nd.name')}){tail.format('exact')}) exact, md5(any_value({fields(alpha)}){tail.format('alpha')}) alpha, 1 + coalesce(sum(d.size), 0) size, 1 + coalesce(max(d.depth), 0) depth"
    own = own.replace("[coalesce(octet_length(encode(u))::varchar || ':' || u, '-') for u in nd.universe_levels]", "[coalesce(octet_length(encode(u))::varchar || ':' || u, '-') for u in any_value(nd.universe_levels)]")
    parts = ["hp as (select gk, id, 0 h from nd where not exists (select 1 from lk where lk.gk = nd.gk and lk.id = nd.id) union select lk.gk, lk.id, h + 1 from hp join lk on lk.gk = hp.gk and lk.child = hp.id)", "ht as materialized (select gk, id, max(h) h from hp group by 1, 2)", "a0 as materialized (select null::varchar gk, null::bigint id, null::varchar exact, null::varchar alpha, null::bigint size, null::bigint depth where false)"]
    for k in range(levels):
        parts.append(f"m{k} as materialized (select nd.gk, nd.id, {own} from nd join ht on ht.gk = nd.gk and ht.id = nd.id and ht.h = {k} left join lk k on k.gk = nd.gk and k.id = nd.id left join a{k} d on d.gk = k.gk and d.id = k.child group by nd.gk, nd.id)")
        parts.append(f"a{k + 1} as materialized (select * from a{k} union all select gk, id, exact, alpha, size::bigint, depth::bigint from m{k})")
    names = """ow as (select outline_id, declaration from po union all select r.outline_id, coalesce(d.name, 'outline:' || r.outline_id) from (select outline_id, max(decl_id) decl_id from raw_outlines group by 1) r
  left join (select decl_id, arg_max(name, received_at) as name from declarations group by 1) d on r.decl_id = d.decl_id)"""
    node = f"node as materialized (select nd.*, ow.declaration, nd.id is not distinct from nd.root is_root, a.exact, a.alpha, a.size, a.depth, coalesce(w.n, 0) multiplicity from nd join a{levels} a on a.gk = nd.gk and a.id = nd.id join ow on ow.outline_id = nd.outline_id left join (select gk, id, count(*) n from ways group by 1, 2) w on w.gk = nd.gk and w.id = nd.id)"
    return ", ".join([*parts, names, node])


DIGESTS = f"{NODES}, {_digests()}"
REPEATED = f"""{DIGESTS}, pr as (select exact fingerprint, declaration, sum(multiplicity)::bigint n, any_value(size) size, any_value(depth) depth from node where size >= 4 group by 1, 2),
rp as (select fingerprint, any_value(size) size, any_value(depth) depth, count(*) declarations, sum(n)::bigint occurrences from pr group by 1 having count(*) >= 2)"""


def _duplicates_sql(mode: str) -> str:
    return f"""with recursive {DIGESTS}, r as (select {mode} fingerprint, declaration, count(*) n, any_value(size) size, any_value(depth) depth from node where is_root group by 1, 2)
select fingerprint, any_value(size) size, any_value(depth) depth, count(*) declarations, sum(n)::bigint occurrences, min(declaration) first_declaration from r group by 1 having count(*) >= 2"""


EDGES = f"""{STEPS},
p0 as (select outline_id, step, unnest(pre) p from st), pe as (select distinct p0.outline_id, p0.p prerequisite, p0.step from p0 join st on p0.outline_id = st.outline_id and p0.p = st.step where p0.p < p0.step)"""
GROUPS = f"""{BASE},
gr as (select kind, type_text, count(*) n, arg_min(name, (octet_length(encode(type_text)), name)) rep, bit_xor(('0x' || left(md5(name), 15))::bigint) gid, min(name) first_member from v where type_text is not null group by 1, 2),
ends as (select v.decl_id, v.name, v.kind, case when n > 1 then 'group:' || rep else 'decl:' || v.name end endpoint, coalesce(n, 1) n from v left join gr on v.kind = gr.kind and v.type_text = gr.type_text),
ge as (select f.*, u.endpoint "user", p.endpoint prerequisite from f join ends u on f.source_id = u.decl_id join ends p on f.target_id = p.decl_id where u.endpoint <> p.endpoint)"""
MEANT = "not starts_with({n}, 'inst') and not contains({n}, '.to') and not contains({n}, '.match_') and {n} not in (" + ", ".join(f"'{x}'" for x in proof.PLUMBING) + ")"
# sc: the conclusion and all it rests on; vi: what an outline of up to 240 steps shows; wy: the ways between two shown steps over hidden ones
OUTLINE = f"""{EDGES}, cl as (select outline_id, step, prerequisite a from pe union select cl.outline_id, cl.step, pe.prerequisite from cl join pe on cl.outline_id = pe.outline_id and cl.a = pe.step),
sc as (select outline_id, step from st where step = conclusion_step union select cl.outline_id, a from cl join st on cl.outline_id = st.outline_id and cl.step = st.step where st.step = st.conclusion_step),
vi as (select sc.outline_id, sc.step, kind, proposition from sc join st on sc.outline_id = st.outline_id and sc.step = st.step
  where st.step = conclusion_step or kind in ('localFact', 'branchConclusion') or kind = 'namedApplication' and len([x for x in refs if x is not null and {MEANT.format(n='x')}]) > 0),
wy as (select outline_id, step source, step here, [step] path from vi union all select wy.outline_id, source, pe.step, list_append(path, pe.step) from wy join pe on wy.outline_id = pe.outline_id and wy.here = pe.prerequisite
  join sc on sc.outline_id = pe.outline_id and sc.step = pe.step left join vi on vi.outline_id = wy.outline_id and vi.step = wy.here where wy.here = wy.source or vi.step is null),
oe as (select wy.outline_id, source, here target, count(*) paths, max(len(path))::bigint longest, arg_min(array_to_string(path, '>'), list_reverse(path)) sample from wy join vi on vi.outline_id = wy.outline_id and vi.step = here where here <> source group by 1, 2, 3)"""

SQL = {
    "proof_outline": f"with recursive {OUTLINE} select outline_id, step, kind, proposition, count(*) over (partition by outline_id) candidates from vi",
    "proof_outline_edges": f"with recursive {OUTLINE} select outline_id, source, target, paths, longest, sample from oe",
    "proof_edge_totals": f"with recursive {OUTLINE} select outline_id, count(*) as edges, sum(paths)::bigint paths, max(longest) longest from oe group by 1",
    "shared_dependencies": f"""with {BASE}, p as (select distinct comparison_id, left_name, right_name from declaration_comparisons), s as (select source, list_sort(list(distinct target)) t from f group by 1),
i as (select comparison_id, list_sort(list_intersect(a.t, b.t)) t from p join s a on p.left_name = a.source join s b on p.right_name = b.source)
select comparison_id, len(t)::bigint "shared", array_to_string(t, ';') targets from i""",
    "declaration_dependents": f"with {BASE} select target, count(distinct source_id) direct_dependents from e where target_in_corpus group by 1",
    "visible_graph": f"""with {GROUPS}, o as (select endpoint, count(*) members from ends group by 1), g as (select prerequisite, count(distinct source_id) n from ge group by 1)
select endpoint, members, coalesce(n, 0) direct_dependents from o left join g on o.endpoint = g.prerequisite""",
    "corpus_fingerprint": f"""with {BASE}, h as (select sha256(concat_ws('|', decl_id, name, type_text)) h from d),
w as (select count(*) n, {', '.join(f"bit_xor(('0x' || substr(h, {1 + 15 * k}, 15))::bigint) w{k}" for k in range(4))} from h)
select n declarations, sha256(concat_ws('|', '', '', n, w0, w1, w2, w3)) fingerprint from w""",
    "proof_layers": f"""with recursive {EDGES}, ly as (select outline_id, step, 0 as depth from st union select ly.outline_id, pe.step, ly.depth + 1 from ly join pe on ly.outline_id = pe.outline_id and ly.step = pe.prerequisite)
select outline_id, step, max(depth)::bigint layer from ly group by 1, 2""",
    "node_labels": f"""with {STEPS}, nd as (select unnest(nodes) n from st)
select concat_ws(' ', n.kind, n.name, '#' || n.var_index, n.binder_info, n.value_text, case when len(n.universe_levels) > 0 then 'levels=' || array_to_string(n.universe_levels, ',') end) as "label", count(*) nodes from nd where n is not null group by 1""",
    "compare_declarations": f"""with {FEATURES}, pairs as (select distinct comparison_id, left_name, right_name, layer from declaration_comparisons),
c as (select p.*, l.deps ld, r.deps rd, len(list_intersect(l.deps, r.deps)) sh, {_ratio('l.unique_nodes', 'r.unique_nodes')} sr, {_ratio('l.total_occurrences', 'r.total_occurrences')} oc
  from pairs p join ft l on p.left_name = l.name and p.layer = l.layer join ft r on p.right_name = r.name and p.layer = r.layer),
j as (select *, case when len(ld) + len(rd) - sh > 0 then sh / (len(ld) + len(rd) - sh) else 1.0 end dj from c)
select comparison_id, left_name, right_name, layer, sh::bigint "shared", (len(ld) - sh)::bigint left_only, (len(rd) - sh)::bigint right_only, round(dj, 6) dependency_jaccard, round(sr, 6) size_ratio, round(oc, 6) occurrence_ratio, round((dj + sr + oc) / 3, 6) combined_score from j""",
    "neighbors_top3": f"""with {FEATURES}, t as (select * from ft where layer = 'statement' and decl_id in (select decl_id from v where kind = 'theorem')),
m as (select a.name query, b.name as name, len(list_intersect(a.deps, b.deps)) sh, len(a.deps) + len(b.deps) total, {_ratio('a.unique_nodes', 'b.unique_nodes')} r from t a join t b on a.name <> b.name where a.decl_id % 100 = 0),
sc as (select query, name, round(((case when total - sh > 0 then sh / (total - sh) else 1.0 end) + r) / 2, 6) score from m)
select * from (select *, row_number() over (partition by query order by score desc, name) place from sc) where place <= 3""",
    "equivalence_groups": f"with {GROUPS} select gid group_id, 'group:' || rep endpoint, kind, n members, first_member from gr where n > 1",
    "theorem_edges": f"""with {GROUPS.replace("from v where type_text", "from v where kind = 'theorem' and type_text").replace("from v left join gr", "from (select * from v where kind = 'theorem') v left join gr")} select prerequisite, "user", sum(occurrences)::bigint occurrences, coalesce(sum(occurrences) filter (layer = 'statement'), 0)::bigint statement_occurrences, coalesce(sum(occurrences) filter (layer = 'proof'), 0)::bigint proof_occurrences from ge group by 1, 2""",
    "top_labels": f"""with {GROUPS}, o as (select distinct endpoint from ends), g as (select prerequisite, count(distinct source_id) n from ge group by 1)
select endpoint, coalesce(n, 0) direct_dependents from o left join g on o.endpoint = g.prerequisite order by 2 desc, 1 limit 5""",
    "bootstrap_counts": f"""with {GROUPS} select (select count(*) from v) declarations, (select count(*) from v where kind = 'theorem') theorems, (select count(*) from v where kind = 'theorem' and decl_id in (select decl_id from proof_outlines)) outlined,
(select count(distinct endpoint) from ends where n > 1) as "groups", (select count(*) from (select distinct prerequisite, "user" from ge)) connections""",
    "proof_prerequisites": f"""with recursive {EDGES}, cl as (select outline_id, step, prerequisite a from pe union select cl.outline_id, cl.step, pe.prerequisite from cl join pe on cl.outline_id = pe.outline_id and cl.a = pe.step),
g as (select outline_id, step, 'd' k, prerequisite x from pe union all select outline_id, prerequisite, 'u', step from pe union all select outline_id, step, 't', a from cl),
l as (select outline_id, step, {', '.join(f"coalesce(array_to_string(list_sort(list(x) filter (k = '{k}')), ','), '') {k}" for k in 'dut')} from g group by 1, 2)
select st.outline_id, st.step, coalesce(d, '') direct_prerequisites, coalesce(u, '') direct_dependents, coalesce(t, '') transitive_prerequisites from st left join l on st.outline_id = l.outline_id and st.step = l.step""",
    "proof_paths": f"""with recursive {EDGES}, ends as (select outline_id, step from st where step = conclusion_step),
pp as (select outline_id, step, 1 len from ends union all select pp.outline_id, pe.prerequisite, len + 1 from pp join pe on pp.outline_id = pe.outline_id and pp.step = pe.step),
c as (select outline_id, step, count(*) n, max(len) longest from pp group by 1, 2)
select st.outline_id, st.step, least(coalesce(n, 0), 100) listed, coalesce(longest, 0)::bigint longest, coalesce(n, 0) > 100 truncated, coalesce(n, 0)::varchar paths from st left join c on st.outline_id = c.outline_id and st.step = c.step""",
    "proof_paths_listed": f"""with recursive {EDGES}, ends as (select outline_id, step from st where step = conclusion_step),
pp as (select outline_id, step, [step] path from ends union all select pp.outline_id, pe.prerequisite, list_prepend(pe.prerequisite, path) from pp join pe on pp.outline_id = pe.outline_id and pp.step = pe.step)
select outline_id, step, place, array_to_string(path, '>') path from (select *, row_number() over (partition by outline_id, step order by path) place from pp) where place <= 100""",
    "grouped_edges": f"""with {GROUPS} select prerequisite, "user", sum(occurrences)::bigint occurrences, coalesce(sum(occurrences) filter (layer = 'statement'), 0)::bigint statement_occurrences, coalesce(sum(occurrences) filter (layer = 'proof'), 0)::bigint proof_occurrences from ge group by 1, 2""",
    "group_dependents": f"with {GROUPS} select prerequisite, count(distinct source_id) direct_dependents from ge group by 1",
    "witness_edges": f"""with {GROUPS} select prerequisite, "user", source, target, layer from (select *, row_number() over (partition by prerequisite, "user" order by source, target, layer) k from ge) where k = 1""",
    "bootstrap": f"with {BASE} select name, module_name from v where kind = 'theorem' and decl_id in (select decl_id from proof_outlines)",
    "proof_edges": f"with {EDGES} select outline_id, prerequisite, step from pe",
    "proof_closure": f"""with recursive {EDGES}, cl as (select outline_id, step, prerequisite a from pe union select cl.outline_id, cl.step, pe.prerequisite from cl join pe on cl.outline_id = pe.outline_id and cl.a = pe.step)
select st.outline_id, st.step, coalesce(p.n, 0) prerequisites, coalesce(q.n, 0) dependents, coalesce(c.n, 0) ancestors from st
left join (select outline_id, step, count(*) n from pe group by 1, 2) p on p.outline_id = st.outline_id and p.step = st.step
left join (select outline_id, prerequisite, count(*) n from pe group by 1, 2) q on q.outline_id = st.outline_id and q.prerequisite = st.step
left join (select outline_id, step, count(*) n from cl group by 1, 2) c on c.outline_id = st.outline_id and c.step = st.step""",
    "outline_rarity": f"""with {STEPS}, u as (select outline_id, step, unnest(refs) name from st), m as (select * from u where name is not null and {MEANT.format(n='name')}), c as (select outline_id, name, count(*) n from m group by 1, 2)
select m.outline_id, m.step step_id, min(c.n) rarity from m join c on m.outline_id = c.outline_id and m.name = c.name group by 1, 2""",
    "expression_sizes": f"""with recursive {NODES}, w as (select gk, count(*) n, max(depth) depth from ways group by 1)
select any_value(outline_id) outline_id, any_value(step) step_id, any_value(context_id) context_id, count(*) unique_nodes, coalesce(any_value(w.n), 0) occurrences, any_value(w.depth)::bigint depth, count(distinct nd.name) filter (nd.kind = 'constant') constants
from nd left join w on nd.gk = w.gk group by nd.gk""",
    "kind_proportions": f"""with recursive {NODES}, w as (select gk, id, count(*) n from ways group by 1, 2)
select kind, count(*) unique_nodes, coalesce(sum(n), 0)::bigint occurrences from nd left join w on nd.gk = w.gk and nd.id = w.id group by 1""",
    "duplicates_exact": _duplicates_sql("exact"),
    "duplicates_alpha": _duplicates_sql("alpha"),
    "repeated_structures": f"with recursive {REPEATED} select * from rp",
    "repeated_for_declaration": f"with recursive {REPEATED} select declaration, count(*) as \"groups\", max(pr.size) largest from pr join rp on pr.fingerprint = rp.fingerprint group by 1",
    "equivalence_graphs": f"""with recursive {DIGESTS}, e as (select st.kind step_kind, alpha, declaration, st.proposition from node join st on st.outline_id = node.outline_id and st.step = node.step where is_root and place = 0 and st.step = conclusion_step)
select alpha group_id, count(distinct declaration) members, arg_min(declaration, (octet_length(encode(proposition)), declaration)) representative from e group by step_kind, alpha having count(distinct declaration) > 1""",
    "validation_graphs": f"""with {GRAPHS}, r as (select concat_ws('/', outline_id, step, context_id) subject, unnest([case when coalesce(len(nodes), 0) = 0 then 'graph is empty' end,
  case when len(nodes) > 0 and (root is null or root < 0 or root >= len(nodes)) then 'root out of bounds' end,
  case when len([x for x, i in nodes if x.id is null or x.id <> i - 1]) > 0 then 'id differs from position' end,
  case when len([x for x in nodes if len([c for c in coalesce(x.children, []) if c is null or c < 0 or c >= x.id]) > 0]) > 0 then 'child does not precede its node' end]) rule from gr)
select rule, subject, null::varchar detail from r where rule is not null""",
    "validation_steps": f"""with {STEPS},
vs as (select outline_id, complete, truncation_reason reason, conclusion_step conclusion, [struct_pack(id := x.id, kind := x.kind, path := array_to_string([coalesce(a::varchar, 'n') for a in x.proof_term_path], '.'), ctx := [struct_pack(id := c.id, kind := c.kind) for c in x.context if c is not null],
    scope := coalesce(x.scope, []), pre := coalesce(x.prerequisite_steps, []), hyp := coalesce(x.hypothesis_references, [])) for x in coalesce(raw_steps, []) if x is not null] s from po
  union all select outline_id, try_cast(j->>'$.complete' as boolean), j->>'$.truncationReason', conclusion_step, [struct_pack(id := try_cast(x->>'$.id' as bigint), kind := x->>'$.kind', path := array_to_string([coalesce(try_cast(a->>'$' as bigint)::varchar, 'n') for a in {_L("(x->'$.proofTermPath')")}], '.'),
    ctx := [struct_pack(id := c->>'$.id', kind := c->>'$.kind') for c in {_L("(x->'$.context')")} if json_type(c) <> 'NULL'], scope := coalesce([a->>'$' for a in {_L("(x->'$.scope')")}], []),
    pre := coalesce({_IDS.format(_L("(x->'$.prerequisiteSteps')"))}, []), hyp := coalesce([a->>'$' for a in {_L("(x->'$.hypothesisReferences')")}], [])) for x in coalesce(steps, []) if json_type(x) <> 'NULL'] from rl),
vst as (select outline_id, unnest(s) x, s from vs), lone as (select outline_id, complete, reason, conclusion, s from vs),
rules as (
  select 'complete exactly without a reason' rule, outline_id from lone where complete is not null and complete <> (reason is null)
  union all select 'step listed twice', outline_id from lone where len(s) <> len(list_distinct([coalesce(x.id::varchar, '') for x in s]))
  union all select 'step ids are not 0, 1, ... in order', outline_id from lone where len([x for x, i in s if x.id is null or x.id <> i - 1]) > 0
  union all select 'two steps at one place of the term', outline_id from lone where len(s) <> len(list_distinct([coalesce(x.path, chr(1)) for x in s]))
  union all select distinct 'context id listed twice', outline_id from vst where len(coalesce(x.ctx, [])) <> len(list_distinct([coalesce(c.id, chr(1)) for c in coalesce(x.ctx, [])]))
  union all select distinct 'scope differs from the context', outline_id from vst where x.scope <> [c.id for c in coalesce(x.ctx, [])]
  union all select distinct 'prerequisite does not precede its step', outline_id from vst where len([p for p in x.pre if p is null or p >= x.id]) > 0
  union all select distinct 'prerequisite listed twice', outline_id from vst where len(x.pre) <> len(list_distinct([coalesce(p::varchar, '') for p in x.pre]))
  union all select distinct 'prerequisite in a scope apart', a.outline_id from (select outline_id, x, s, unnest(x.pre) p from vst) a where len([y for y in s if y.id = p]) > 0
    and x.scope[1:least(len(x.scope), len([y for y in s if y.id = p][1].scope))] <> [y for y in s if y.id = p][1].scope[1:least(len(x.scope), len([y for y in s if y.id = p][1].scope))]
  union all select distinct 'hypothesis is no assumption of the context', outline_id from vst where len([h for h in x.hyp if h is not null and len([c for c in coalesce(x.ctx, []) if c.id = h and c.kind = 'assumption']) = 0]) > 0
  union all select 'conclusion names no step of that kind', outline_id from lone where conclusion is not null and len([x for x in s if x.id = conclusion and x.kind = 'conclusion']) = 0
  union all select 'complete without a conclusion', outline_id from lone where complete and len(s) > 0 and conclusion is null)
select rule, outline_id::varchar subject, null::varchar detail from rules""",
    "validation_violations": f"""with {BASE}, de as (select distinct source_id, source, target, layer, occurrences from dependency_edges where target is not null)
select 'declaration name occurs twice' rule, name subject, count(*)::varchar detail from d group by name having count(*) > 1
union all select 'symbol name occurs twice', name, count(*)::varchar from sym group by name having count(*) > 1
union all select 'dependency is no symbol', target, count(*)::varchar from de where target not in (select name from sym) group by target
union all select 'edge without occurrences', source, target from de where occurrences is null or occurrences <= 0
union all select 'edge without its declaration', source_id::varchar, target from de where source_id not in (select decl_id from d)
union all select 'declaration without name or kind', decl_id::varchar, null from d where name is null or kind is null""",
}
