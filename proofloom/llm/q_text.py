"""Queries of problems 6 (token ids), 7 (mixing sources) and 8 (truncated texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import encode, mix, truncation
from proofloom.session import cut
from proofloom.sources.tables import table


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode(table(spark, directory, "documents").select("doc_id", "text"))


def p6_decoded(spark: SparkSession, directory: str) -> DataFrame:
    """Every document's text from its token ids; null and empty texts come out empty."""
    return encode.decode(p6_ids(spark, directory))


def p7_mix_plan(spark: SparkSession, directory: str) -> mix.Mix:
    documents = table(spark, directory, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    counted = cut(encode.token_counts(documents, out="size"), "token-counts")
    return mix.mix_sources(counted, table(spark, directory, "source_weights"))


def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    """The plan, what was emitted and the actual share of every source."""
    return p7_mix_plan(spark, directory).shares()


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    """Weighted sources whose documents, all emitted as often as may be, don't make up their share of the mix."""
    return p7_shares(spark, directory).where("short").select("source")


def p7_mix(spark: SparkSession, directory: str) -> DataFrame:
    """The mix itself: a row per use of a document."""
    emitted = p7_mix_plan(spark, directory).emitted
    return emitted.select(F.col("id").alias("doc_id"), "source", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"))


def _chars_mix(spark: SparkSession, directory: str) -> mix.Mix:
    documents = table(spark, directory, "documents").select(F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("size"))
    return mix.mix_sources(documents, table(spark, directory, "source_weights"))


def p7_chars_mix(spark: SparkSession, directory: str) -> DataFrame:
    """The same mix by characters instead of tokens, which SQL can sample too: every emitted document and its copies."""
    return _chars_mix(spark, directory).emitted.withColumnRenamed("id", "doc_id")


def p7_chars_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Plan and shares of the mix by characters."""
    return _chars_mix(spark, directory).shares()


def p8_scores(spark: SparkSession, directory: str) -> DataFrame:
    """Ending, limit, posterior and verdict of every document."""
    documents = table(spark, directory, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return truncation.truncated(documents).withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    """The documents that broke off."""
    return p8_scores(spark, directory).where("truncated").select("doc_id")


def p8_sources(spark: SparkSession, directory: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.rates_by_source(p8_scores(spark, directory))


CHARS = """w as (select source, greatest(coalesce(target_weight, 0), 0) target_weight, greatest(coalesce(max_repeats, 1), 0)::bigint max_repeats from source_weights where source is not null),
docs as (select doc_id, source, coalesce(n_chars, 0)::bigint size from documents),
held as (select source, count(*) documents, sum(size)::bigint tokens from docs group by 1),
p0 as (select w.*, coalesce(documents, 0) documents, coalesce(tokens, 0) tokens, (select coalesce(sum(tokens), 0)::bigint from held where source in (select source from w)) all_tokens from w left join held on w.source = held.source),
p1 as (select *, target_weight * all_tokens wanted, tokens * max_repeats >= target_weight * all_tokens reachable from p0),
p2 as (select *, case when wanted > 0 and documents > 0 then least(case when tokens > 0 then wanted / tokens else max_repeats::double end, max_repeats::double) else 0 end expected_copies from p1),
numbered as (select doc_id, docs.source, size, expected_copies e, ('0x' || left(md5(docs.source || ':0'), 13))::bigint / 4503599627370496.0::double o, row_number() over (partition by docs.source order by size, doc_id) k
  from docs join p2 on docs.source = p2.source where expected_copies > 0),
emitted as (select doc_id, source, size, least(floor(k * e + o) - floor((k - 1) * e + o), ceil(e))::bigint copies from numbered),
mixed as (select source, sum(copies)::bigint mix_documents, sum(copies * size)::bigint mix_size from emitted where copies > 0 group by 1)"""

SQL = {
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p7_chars_mix": f"with {CHARS} select doc_id, source, size, copies from emitted where copies > 0",
    "p7_chars_shares": f"""with {CHARS} select p2.*, coalesce(mix_documents, 0) mix_documents, coalesce(mix_size, 0) mix_size,
  round(coalesce(mix_size, 0) / (select sum(mix_size) from mixed), 6) actual_share, coalesce(mix_documents, 0) = documents * max_repeats and coalesce(mix_size, 0) < wanted as short from p2 left join mixed on p2.source = mixed.source""",
}

QUERIES = {f.__name__: f for f in (p6_ids, p6_decoded, p7_found, p7_shares, p7_mix, p7_chars_mix, p7_chars_shares, p8_found, p8_scores, p8_sources)}
