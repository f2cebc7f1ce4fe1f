"""How distinctive a term is for a record: positive pointwise mutual information.

The record is the context. With n(t, r) the joint count, the score is
max(0, ln(n(t, r) * Z / (n(t) * n(r)**a))), Z the sum of n(r)**a over all records: marginals and joint counts come from
group-bys with map-side combines, the marginals reach the joint counts by joins that serve hot keys apart. The score also finds the terms that lead
their record although few records have them: ``leading_terms`` proves how low the score of such a term can be, and looks at no row below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.operators.skew import join_key_values
from proofloom.session import cut

SMOOTHING = 0.75


def ppmi(rows: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """One row per (term_field, record, term): n, term_count, records (distinct records of the term), record_count, terms (distinct terms of the record), score and ppmi,
    which is the score, but not below 0, rounded to 6 digits.

    ``rows``: term_field, record, term; one row per use. Null terms and null records are left out; the empty string is a term. Each field
    is a collection of its own. Every joint pair gets a row, also with a score below 0. No rows give no rows.
    """
    joint = cut(rows.where("term is not null and record is not null").groupBy("term_field", "record", "term").agg(F.count(F.lit(1)).alias("n")), "joint")
    of_term = cut(joint.groupBy("term_field", "term").agg(F.sum("n").alias("term_count"), F.count(F.lit(1)).alias("records")), "of-term")
    of_record = cut(joint.groupBy("term_field", "record").agg(F.sum("n").alias("record_count"), F.count(F.lit(1)).alias("terms")), "of-record")
    field = of_record.groupBy("term_field").agg(F.sum(F.pow(F.col("record_count").cast("double"), F.lit(smoothing))).alias("_z"))
    scored = join_key_values(joint, of_term, ["term_field", "term"], "records")
    scored = join_key_values(scored, of_record, ["term_field", "record"], "terms")
    scored = scored.join(F.broadcast(field), "term_field")  # one row per field name
    expected = F.col("term_count").cast("double") * F.pow(F.col("record_count").cast("double"), F.lit(smoothing))
    scored = scored.withColumn("score", F.log(F.col("n").cast("double") * F.col("_z") / expected))
    ppmi = F.round(F.greatest(F.lit(0.0), F.col("score")), 6)
    return scored.select("term_field", "record", "term", "n", "term_count", "records", "record_count", "terms", "score", ppmi.alias("ppmi"))


def lowest_score(scored: DataFrame, most_records: int) -> DataFrame:
    """(term_field, lowest): no term that leads a record without a tie and has at most ``most_records`` records scores less there.

    Such a term has n >= (record_count + terms - 1) / terms, as each of the record's other terms has n - 1 at most. Its other records add at most (most_records - 1) * M, M
    the field's greatest n of a term with that few records, so n / term_count >= n / (n + (most_records - 1) * M), which grows with n. What else the score holds is
    the record's own and read off any of its rows: score - ln(n / term_count).
    """
    greatest = scored.where(F.col("records") <= most_records).groupBy("term_field").agg(F.max("n").alias("_m"))
    least_n = F.ceil((F.col("record_count") + F.col("terms") - 1) / F.col("terms"))
    share = least_n / (least_n + (most_records - 1) * F.col("_m"))
    bound = F.log(share) + F.col("score") - F.log(F.col("n") / F.col("term_count"))
    return scored.join(F.broadcast(greatest), "term_field").groupBy("term_field").agg((F.min(bound) - F.lit(1e-9)).alias("lowest"))  # one row per field name


def leading_terms(scored: DataFrame, least_records: int, most_records: int) -> DataFrame:
    """Rows of ``ppmi`` whose term is used in its record more often than any other (no tie) and occurs in the given number of records.

    The score finds the candidates (see ``lowest_score``); they are then held against the greatest count of their record and how many terms have it, which two
    aggregates tell that combine before the shuffle.
    """
    scored = cut(scored, "scored")
    able = scored.join(F.broadcast(lowest_score(scored, most_records)), "term_field").where((F.col("score") >= F.col("lowest")) & F.col("records").between(least_records, most_records))
    tied = scored.groupBy("term_field", "record", "n").agg(F.count(F.lit(1)).alias("_tied"))
    top = tied.groupBy("term_field", "record").agg(F.max(F.struct("n", "_tied")).alias("_top"))
    top = top.where("_top._tied = 1").select("term_field", "record", F.col("_top.n").alias("n"))
    return able.join(top.hint("merge"), ["term_field", "record", "n"], "left_semi").select("term_field", "record", "term", "records", "score")
