"""SQL counterparts of the queries in ``core_p``."""

EDGES = """edges as (
  select source_id, target, layer, max(target_is_instance)::int::bigint is_instance, max(occurrences) occurrences
  from dependency_edges where target is not null and target_is_instance is not null group by 1, 2, 3)"""


def _list(x: str) -> str:
    """JSON value as a list: itself, or a list of one where the brackets are missing."""
    return f"case when {x} is null or json_type({x}) = 'NULL' then null when json_type({x}) = 'ARRAY' then cast({x} as json[]) else [{x}] end"


def _each(value: str, source: str, keep: str, name: str, sub: str | None = None) -> str:
    pos = f", generate_subscripts({value}, 1) - 1 as {name}_pos" if sub is None else ""
    return f"select {keep}, unnest({value}) as {name}{pos} from {source}"


P3_LATEST = """typed as (select outline_id, arg_max(raw_steps, received_at) steps, max(received_at) r from proof_outlines group by 1),
whole as (select outline_id, payload::json j, received_at from raw_outlines where json_valid(payload)),
raw as (select outline_id, arg_max(j, received_at) j from whole group by 1),
raw_lists as (select outline_id, {steps} steps from raw)""".format(steps=_list("(j->'$.rawSteps')"))

P3_STEPS = f"""{P3_LATEST},
ts as (select outline_id, unnest(steps) s, generate_subscripts(steps, 1) - 1 p from typed),
js as (select outline_id, unnest(steps) s, generate_subscripts(steps, 1) - 1 p from raw_lists)"""

P3_CONTEXTS = f"""{P3_STEPS},
tc as (select outline_id, p, s.id sid, unnest(s.context) c, generate_subscripts(s.context, 1) - 1 q from ts where s is not null),
jl as (select outline_id, p, try_cast(s->>'$.id' as bigint) sid, {_list("(s->'$.context')")} cs from js where json_type(s) <> 'NULL'),
jc as (select outline_id, p, sid, unnest(cs) c, generate_subscripts(cs, 1) - 1 q from jl)"""

P3_FOUND = f"""with ts as (select outline_id, unnest(raw_steps) s from proof_outlines),
tc as (select outline_id, s.id sid, unnest(s.context) c from ts),
tn as (select outline_id, sid, c.id cid, [x.id for x in c.type_graph.nodes] ids, unnest(c.type_graph.nodes) n from tc),
tl as (select outline_id, sid, cid, ids, n.id pid, unnest(n.children) child, generate_subscripts(n.children, 1) - 1 pos from tn),
whole as (select outline_id, payload::json j from raw_outlines where json_valid(payload)),
l1 as (select outline_id, {_list("(j->'$.rawSteps')")} steps from whole),
js as (select outline_id, unnest(steps) s from l1),
l2 as (select outline_id, try_cast(s->>'$.id' as bigint) sid, {_list("(s->'$.context')")} cs from js),
jc as (select outline_id, sid, unnest(cs) c from l2),
l3 as (select outline_id, sid, c->>'$.id' cid, {_list("(c->'$.typeGraph.nodes')")} ns from jc),
jn as (select outline_id, sid, cid, [try_cast(x->>'$.id' as bigint) for x in ns] ids, unnest(ns) n from l3),
l4 as (select outline_id, sid, cid, ids, try_cast(n->>'$.id' as bigint) pid, {_list("(n->'$.children')")} ks from jn),
jl as (select outline_id, sid, cid, ids, pid, unnest(ks) child, generate_subscripts(ks, 1) - 1 pos from l4),
links as (select outline_id, sid, cid, ids, pid, pos, child from tl
  union all select outline_id, sid, cid, ids, pid, pos, try_cast(child->>'$' as bigint) from jl)
select distinct outline_id, sid step_id, cid context_id, pid parent_node, pos::bigint child_pos, child child_node
from links where list_contains(ids, child)"""

_FIELDS = "n.id id, n.kind kind, n.name as name, n.var_index var_index, n.value_text value_text, n.binder_info binder_info"
_JSON_FIELDS = "try_cast(n->>'$.id' as bigint), n->>'$.kind', n->>'$.name', try_cast(n->>'$.index' as bigint), n->>'$.value', n->>'$.binderInfo'"


def _nodes_sql() -> str:
    """Every node of both kinds of graph, of typed and of raw outlines."""
    keys = "outline_id, p::bigint raw_steps_pos"
    parts = []
    for rows, step, ctx, listed, place, fields, alive in (
        ("ts", "s.id", "null::bigint context_pos, null::varchar context_id", "s.proposition_graph.nodes", "proposition_graph", _FIELDS, "n is not null"),
        ("js", "try_cast(s->>'$.id' as bigint)", "null::bigint context_pos, null::varchar context_id", _list("(s->'$.propositionGraph.nodes')"), "proposition_graph", _JSON_FIELDS, "json_type(n) <> 'NULL'"),
        ("tc", "sid", "q::bigint context_pos, c.id context_id", "c.type_graph.nodes", "context.type_graph", _FIELDS, "n is not null"),
        ("jc", "sid", "q::bigint context_pos, c->>'$.id' context_id", _list("(c->'$.typeGraph.nodes')"), "context.type_graph", _JSON_FIELDS, "json_type(n) <> 'NULL'"),
    ):
        source = f"(select * from {rows} where json_type(s) <> 'NULL')" if rows == "js" else rows
        inner = f"select {keys}, {step} raw_steps_id, {ctx}, {listed} l from {source}"
        parts.append(f"select outline_id, raw_steps_pos, raw_steps_id, context_pos, context_id, 'raw_steps.{place}.nodes' place, k nodes_pos, {fields} from (select * exclude l, unnest(l) n, (generate_subscripts(l, 1) - 1)::bigint k from ({inner})) where {alive}")
    return f"with {P3_CONTEXTS} " + " union all ".join(parts)


SQL = {
    "p3_nodes": _nodes_sql(),
    "p3_payloads": "select case when payload is null then 'null' when trim(payload) = '' then 'blank' when json_valid(payload) and json_type(payload) = 'OBJECT' then 'whole' else 'broken' end state, count(*) texts from raw_outlines group by 1",
    "p2_targets": f"with {EDGES} select is_instance, target, count(*)::bigint edges, sum(occurrences)::bigint occurrences, count(distinct source_id)::bigint sources from edges group by 1, 2",
    "p2_flags": f"with {EDGES} select is_instance, count(*)::bigint edges, sum(occurrences)::bigint occurrences, count(distinct source_id)::bigint sources from edges group by 1",
    "p2_found": f"with {EDGES}, totals as (select is_instance, count(*) n from edges group by 1) "
    "select e.is_instance, e.target from edges e join totals t on e.is_instance = t.is_instance group by 1, 2, t.n having count(*) >= 0.02 * t.n",
    "p3_found": P3_FOUND,
    "p3_steps": f"""with {P3_STEPS}
select outline_id, p::bigint raw_steps_pos, s.id id, s.kind kind, s.proposition proposition from ts where s is not null
union all select outline_id, p::bigint, try_cast(s->>'$.id' as bigint), s->>'$.kind', s->>'$.proposition' from js where json_type(s) <> 'NULL'""",
    "p3_contexts": f"""with {P3_CONTEXTS}
select outline_id, p::bigint raw_steps_pos, sid raw_steps_id, q::bigint context_pos, c.id id, c.user_name user_name, c.kind kind, c.binder_info binder_info, c.type_text type_text, c.value_text value_text from tc where c is not null
union all select outline_id, p::bigint, sid, q::bigint, c->>'$.id', c->>'$.userName', c->>'$.kind', c->>'$.binderInfo', c->>'$.type', c->>'$.value' from jc where json_type(c) <> 'NULL'""",
    "p3_graphs": f"""with {P3_CONTEXTS}
select outline_id, p::bigint raw_steps_pos, s.id raw_steps_id, null::bigint context_pos, null::varchar context_id, 'raw_steps.proposition_graph' place, s.proposition_graph.root root from ts where s.proposition_graph is not null
union all select outline_id, p::bigint, try_cast(s->>'$.id' as bigint), null, null, 'raw_steps.proposition_graph', try_cast(s->>'$.propositionGraph.root' as bigint) from js where json_type(s->'$.propositionGraph') <> 'NULL'
union all select outline_id, p::bigint, sid, q::bigint, c.id, 'raw_steps.context.type_graph', c.type_graph.root from tc where c.type_graph is not null
union all select outline_id, p::bigint, sid, q::bigint, c->>'$.id', 'raw_steps.context.type_graph', try_cast(c->>'$.typeGraph.root' as bigint) from jc where json_type(c->'$.typeGraph') <> 'NULL'""",
}
