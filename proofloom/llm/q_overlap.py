"""Queries of problem 5: similar sets of dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import overlap
from proofloom.sources.tables import latest, table

THRESHOLD, LEAST = "0.7", 4


def _sets(spark: SparkSession, directory: str) -> DataFrame:
    declarations = latest(table(spark, directory, "declarations"), ["decl_id"], keep=["statement_dependencies", "proof_dependencies"])
    comparisons = latest(table(spark, directory, "declaration_comparisons"), ["comparison_id"], order=None, keep=["shared_dependencies"])
    two = F.explode(
        F.array(
            F.struct(F.lit("statement").alias("set_field"), F.col("statement_dependencies").alias("items")),
            F.struct(F.lit("proof").alias("set_field"), F.col("proof_dependencies").alias("items")),
        )
    )
    return (
        declarations.select(F.col("decl_id").alias("id"), two.alias("s"))
        .select("s.set_field", "id", "s.items")
        .unionByName(comparisons.select(F.lit("shared").alias("set_field"), F.col("comparison_id").alias("id"), F.col("shared_dependencies").alias("items")))
    )


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """All pairs of ids with at least ``LEAST`` names each and a Jaccard similarity of at least ``THRESHOLD``."""
    return overlap.expand(*overlap.similar_sets(_sets(spark, directory), THRESHOLD, LEAST))


def p5_pairs(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of classes with shared dependencies and dependency_jaccard."""
    _, pairs = overlap.similar_sets(_sets(spark, directory), THRESHOLD, LEAST)
    return pairs.select("set_field", "left_id", "right_id", F.array_join(F.array_sort("shared_items"), ";").alias("shared_dependencies"), F.round("jaccard", 6).alias("dependency_jaccard"))


def p5_links(spark: SparkSession, directory: str) -> DataFrame:
    """One row per record: class and number of similar classes."""
    return overlap.links_per_record(*overlap.similar_sets(_sets(spark, directory), THRESHOLD, LEAST))


SETS = """d as (select decl_id, arg_max(statement_dependencies, received_at) s, arg_max(proof_dependencies, received_at) p from declarations group by 1),
c as (select comparison_id, max(shared_dependencies) s from declaration_comparisons group by 1),
raw as (select 'statement' set_field, decl_id id, s items from d union all select 'proof', decl_id, p from d union all select 'shared', comparison_id, s from c),
sets as (select set_field, id, list_sort(list_distinct(list_filter(items, lambda x: x is not null))) items from raw where len(list_distinct(list_filter(items, lambda x: x is not null))) >= 4),
members as (select set_field, id, min(id) over (partition by set_field, items) class_id, items, len(items) n from sets),
tokens as (select set_field, id, n, unnest(items) token from members where id = class_id),
met as (select a.set_field, a.id left_id, b.id right_id, count(*) shared, any_value(a.n + b.n) n, string_agg(a.token, ';' order by a.token) shared_dependencies
  from tokens a join tokens b on a.set_field = b.set_field and a.token = b.token and a.id < b.id group by 1, 2, 3),
pairs as (select *, shared / (n - shared) dependency_jaccard from met where shared * 10 >= 7 * (n - shared))"""

SQL = {
    "p5_found": f"""with {SETS}
select p.set_field, least(a.id, b.id) left_id, greatest(a.id, b.id) right_id from pairs p
join members a on p.set_field = a.set_field and p.left_id = a.class_id join members b on p.set_field = b.set_field and p.right_id = b.class_id
union all select a.set_field, a.id, b.id from members a join members b on a.set_field = b.set_field and a.class_id = b.class_id and a.id < b.id""",
    "p5_pairs": f"with {SETS} select set_field, left_id, right_id, shared_dependencies, round(dependency_jaccard, 6) dependency_jaccard from pairs",
    "p5_links": f"""with {SETS}, ends as (select set_field, left_id id from pairs union all select set_field, right_id from pairs),
degree as (select set_field, id, count(*) links from ends group by 1, 2)
select m.set_field, m.id, m.class_id, coalesce(d.links, 0)::bigint links from members m left join degree d on m.set_field = d.set_field and m.class_id = d.id""",
}

QUERIES = {f.__name__: f for f in (p5_found, p5_pairs, p5_links)}
