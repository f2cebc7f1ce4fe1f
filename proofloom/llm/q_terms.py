"""Queries of problem 1 (term frequencies) and 4 (distinctive terms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import distinct_terms, terms
from proofloom.sources.tables import latest, table


def _nodes(spark: SparkSession, directory: str, fields: list[str]) -> DataFrame:
    nodes = table(spark, directory, "proof_outline_nodes")
    return latest(nodes, ["outline_id", "raw_step_id"], keep=["decl_id", *fields])


def _mentions(nodes: DataFrame, column: str, name: str) -> DataFrame:
    return nodes.select(F.lit(name).alias("term_field"), F.explode(column).alias("term"), F.col("decl_id").alias("record"))


def p1_terms(spark: SparkSession, directory: str) -> DataFrame:
    """Occurrences, records (declarations) and mark of every constant and named reference."""
    metrics = latest(table(spark, directory, "expression_metrics"), ["decl_id", "layer"], keep=["constant_frequencies"])
    constants = metrics.select("decl_id", F.explode("constant_frequencies").alias("c")).select(
        F.lit("constant").alias("term_field"), F.col("c.name").alias("term"), F.col("decl_id").alias("record"), F.col("c.occurrences").alias("n")
    )
    names = _mentions(_nodes(spark, directory, ["named_references"]), "named_references", "named_reference").withColumn("n", F.lit(1).cast("bigint"))
    totals = [
        table(spark, directory, t).select(F.lit(f).alias("term_field"), "decl_id").groupBy("term_field").agg(F.countDistinct("decl_id").alias("all_records"))
        for t, f in (("expression_metrics", "constant"), ("proof_outline_nodes", "named_reference"))
    ]
    return terms.mark_terms(terms.term_counts(constants.unionByName(names)), totals[0].unionByName(totals[1]))


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """The terms too rare or too common to tell declarations apart."""
    return p1_terms(spark, directory).where("mark is not null").select("term_field", "term", "mark")


def _scored(spark: SparkSession, directory: str) -> DataFrame:
    nodes = _nodes(spark, directory, ["named_references", "hypothesis_references"])
    rows = _mentions(nodes, "named_references", "named_reference").unionByName(_mentions(nodes, "hypothesis_references", "hypothesis_reference"))
    return distinct_terms.ppmi(rows)


def p4_scores(spark: SparkSession, directory: str) -> DataFrame:
    """PPMI of every term of a declaration, with the counts it rests on."""
    return _scored(spark, directory).drop("score", "terms").withColumnRenamed("record", "decl_id")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Terms whose score can be that of a leader in 2 to 5 declarations, and that are one: no other term of the declaration is used as often."""
    return distinct_terms.leading_terms(_scored(spark, directory), 2, 5).select("term_field", F.col("record").alias("decl_id"), "term")


NODES = """nodes as (select outline_id, raw_step_id, max(decl_id) decl_id, arg_max(named_references, received_at) named_references,
  arg_max(hypothesis_references, received_at) hypothesis_references from proof_outline_nodes group by 1, 2)"""

P1 = f"""with metrics as (select decl_id, layer, arg_max(constant_frequencies, received_at) cf from expression_metrics group by 1, 2),
{NODES},
ex as (select decl_id, unnest(cf) c from metrics),
mentions as (select 'constant' term_field, c.name term, decl_id, coalesce(c.occurrences, 0) n from ex
  union all select 'named_reference', unnest(named_references), decl_id, 1 from nodes),
totals as (select 'constant' term_field, count(distinct decl_id) t from expression_metrics
  union all select 'named_reference', count(distinct decl_id) from proof_outline_nodes),
counts as (select term_field, term, sum(n)::bigint occurrences, count(distinct decl_id)::bigint records from mentions where term is not null group by 1, 2),
marked as (select c.*, case when records < 3 then 'rare' when records > 0.2 * t then 'common' end mark from counts c join totals t on c.term_field = t.term_field)"""

P4 = f"""with {NODES},
mentions as (select 'named_reference' term_field, decl_id, unnest(named_references) term from nodes
  union all select 'hypothesis_reference', decl_id, unnest(hypothesis_references) from nodes),
joint as (select term_field, decl_id, term, count(*)::bigint n from mentions where term is not null group by 1, 2, 3),
of_term as (select term_field, term, sum(n)::bigint term_count, count(*)::bigint records from joint group by 1, 2),
of_record as (select term_field, decl_id, sum(n)::bigint record_count, max(n) top, sum((n)::double) s from joint group by 1, 2),
field as (select term_field, sum(pow(record_count::double, 0.75)) z from of_record group by 1),
leaders as (select j.term_field, j.decl_id, count(*) k from joint j join of_record r on j.term_field = r.term_field and j.decl_id = r.decl_id and j.n = r.top group by 1, 2)"""

SQL = {
    "p1_terms": f"{P1} select term_field, term, occurrences, records, mark from marked",
    "p1_found": f"{P1} select term_field, term, mark from marked where mark is not null",
    "p4_scores": f"""{P4} select j.term_field, j.decl_id, j.term, j.n, t.term_count, t.records, r.record_count,
  round(greatest(0, ln(j.n::double * z / (t.term_count::double * pow(r.record_count::double, 0.75)))), 6) ppmi
from joint j join of_term t on j.term_field = t.term_field and j.term = t.term
join of_record r on j.term_field = r.term_field and j.decl_id = r.decl_id join field f on j.term_field = f.term_field""",
    "p4_found": f"""{P4} select j.term_field, j.decl_id, j.term from joint j join of_term t on j.term_field = t.term_field and j.term = t.term
join of_record r on j.term_field = r.term_field and j.decl_id = r.decl_id and j.n = r.top
join leaders l on j.term_field = l.term_field and j.decl_id = l.decl_id where l.k = 1 and t.records between 2 and 5""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p4_found, p4_scores)}
