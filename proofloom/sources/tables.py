"""Parquet tables of one directory, and rows that were sent more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; a scan that filters and projections reach."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def latest(df: DataFrame, keys: list[str], order: str | None = "received_at", keep: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order``, ties settled by the greatest remaining values.

    Only ``keys`` and ``keep`` (all other columns by default) are carried through the shuffle, after a
    map-side combine, so copies of one row never travel together. Null keys compare equal and form a
    group; a null ``order`` ranks lowest. An empty table gives an empty table. Maps are not accepted in ``keep``.
    """
    rest = [c for c in (keep if keep is not None else df.columns) if c not in keys and c != order]
    ranked = ([F.col(f"`{order}`").alias("_order")] if order else []) + [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)]
    if not ranked:
        return df.select(*[F.col(f"`{k}`") for k in keys]).distinct()
    best = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max(F.struct(*ranked)).alias("_best"))
    return best.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"_best._{i}").alias(c) for i, c in enumerate(rest)], *([F.col("_best._order").alias(order)] if order and (keep is None or order in keep) else []))
