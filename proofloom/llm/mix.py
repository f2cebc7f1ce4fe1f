"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's wanted tokens over its tokens, at most the source's cap. The
expected copies are summed up along the source's documents, ordered by size, one random offset is added, and a document is emitted
once for every integer that its stretch crosses: so many copies as expected, rounded one way or the other, and the rounding evens out over
all sizes. The sums need each document's exact place in its source, which is found without any task taking a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.operators.skew import join_key_values, number_within_keys
from proofloom.session import cut


@dataclass
class Mix:
    """``plan``: a row per weighted source, told from totals before any document is emitted; ``emitted``: (id, source, size, copies), copies > 0."""

    plan: DataFrame
    emitted: DataFrame

    def shares(self) -> DataFrame:
        """``plan`` with what was emitted: mix_documents, mix_size, actual_share (of the whole mix; null if the mix is empty), and short: every document was emitted
        as often as its source's cap allows, and together they are still smaller than the source's share."""
        own = cut(self.emitted.groupBy("source").agg(F.sum("copies").alias("mix_documents"), F.sum(F.col("copies") * F.col("size")).alias("mix_size")), "mix-shares")
        report = self.plan.join(own, "source", "left").fillna(0, ["mix_documents", "mix_size"])
        whole = own.agg(F.sum("mix_size")).first()[0] or 0
        share = F.round(F.col("mix_size") / F.lit(float(whole)), 6) if whole else F.lit(None).cast("double")
        short = (F.col("mix_documents") == F.col("documents") * F.col("max_repeats")) & (F.col("mix_size") < F.col("wanted"))
        return report.withColumn("actual_share", share).withColumn("short", short)


def mix_sources(documents: DataFrame, weights: DataFrame, size: int | None = None, seed: int = 0) -> Mix:
    """``documents``: id, source, size (>= 0); ``weights``: source (unique), target_weight, max_repeats.

    ``size`` is the size of the mix, by default that of all documents with a weighted source. Documents whose source is null or not weighted are no part of
    the mix; a null size counts as 0; repeated ids are records of their own. A null, zero or negative weight wants nothing, a null cap allows
    one use, a negative one none. A source that can't reach its share even at its cap is used up to the cap and has reachable = false; so is one whose documents are all empty; a source without
    documents has 0 tokens. Same input and seed, same mix. Empty tables give an empty mix.
    """
    weights = weights.where("source is not null").select(
        "source", F.greatest(F.coalesce(F.col("target_weight"), F.lit(0.0)), F.lit(0.0)).alias("target_weight"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).cast("bigint").alias("max_repeats")
    )
    docs = documents.select("id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size"))
    held = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("tokens"))
    plan = weights.join(held, "source", "left").fillna(0, ["documents", "tokens"])
    plan = cut(plan, "mix-totals")
    plan = plan.withColumn("all_tokens", F.lit(plan.agg(F.sum("tokens")).first()[0] or 0).cast("bigint"))
    wanted = F.col("target_weight") * (F.lit(size) if size is not None else F.col("all_tokens"))
    reach = F.col("tokens") * F.col("max_repeats")
    most = F.col("max_repeats").cast("double")
    expected = F.when((wanted > 0) & (F.col("documents") > 0), F.least(F.coalesce(F.try_divide(wanted, F.col("tokens")), most), most)).otherwise(F.lit(0.0))
    plan = cut(plan.select("source", "target_weight", "max_repeats", "documents", "tokens", "all_tokens", wanted.cast("double").alias("wanted"), (reach >= wanted).alias("reachable"), expected.alias("expected_copies")), "mix-plan")
    used = plan.where("expected_copies > 0 and documents > 0").select("source", "documents", "expected_copies")
    known = join_key_values(docs, used, ["source"], "documents").where("expected_copies is not null").drop("documents")
    numbered = number_within_keys(known, ["source"], ["size", "id"])
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", "source", F.lit(seed))), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
    crossed = F.floor(F.col("_number") * F.col("expected_copies") + offset) - F.floor((F.col("_number") - 1) * F.col("expected_copies") + offset)
    emitted = numbered.withColumn("copies", F.least(crossed, F.ceil("expected_copies"))).where("copies > 0")
    return Mix(plan, emitted.select("id", "source", "size", "copies"))
