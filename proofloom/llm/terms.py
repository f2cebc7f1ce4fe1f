"""Frequency of every distinct term, by recursive radix spilling.

Every (term, record) row is written with a 64-bit radix key: the upper half from the hash of the term, the lower half
from the hash of the record. Partitions are prefixes of this key. A partition that holds too many bytes
is split by further bits, again and again: first by those that tell terms apart, then by the record's, so even the rows of one
overwhelming term split up, into partitions with disjoint records whose counts add up. One shuffle puts the partitions on the executors' disks, and DuckDB aggregates
the raw rows of each inside its task, out of core beyond a memory limit. Only terms that were split by record are merged afterwards.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.session import cut, shared_local_path

LEAF_BYTES = 32 << 20
ROW_BYTES = 48  # of a row besides its term
TERM_BITS, MOST_BITS = 32, 62
DUCKDB_MB = 256

RESULT = "term_field string, term string, split boolean, occurrences bigint, records bigint"


def _prefix(bits: int) -> Column:
    """The first ``bits`` of the key, a one before them, which keeps prefixes of different lengths apart."""
    return F.shiftrightunsigned("_radix", 64 - bits).bitwiseOR(F.lit(1 << bits))


def _oversized(rows: DataFrame, bits: int, leaf_bytes: int) -> DataFrame:
    """(_prefix, _bytes) of the partitions to split. There is at most one for every ``leaf_bytes`` of rows, so the table takes under a millionth of their size and may be broadcast."""
    size = rows.groupBy(_prefix(bits).alias("_prefix")).agg(F.sum("_bytes").alias("_bytes"))
    return cut(size.where(F.col("_bytes") > leaf_bytes), "oversized")


def _leaves(rows: DataFrame, bits: int, leaf_bytes: int) -> tuple[list[tuple[int, DataFrame]], int, DataFrame | None]:
    """([(bits, the partitions of that length to split)], bits of the last split, the partitions that further bits can't split: rows of one term and record each)."""
    levels: list[tuple[int, DataFrame]] = []
    part, before = rows, math.inf
    while True:
        over = _oversized(part, bits, leaf_bytes)
        largest = over.agg(F.max("_bytes")).first()[0]
        if largest is None:
            return levels, bits, None
        if bits == MOST_BITS or bits > TERM_BITS and largest > 0.75 * before:
            return levels, bits, over.select("_prefix")
        levels.append((bits, over.select("_prefix")))
        part = part.withColumn("_prefix", _prefix(bits)).join(F.broadcast(over.select("_prefix")), "_prefix", "left_semi").drop("_prefix")
        more = max(1, math.ceil(math.log2(largest / leaf_bytes)) + 1)
        before = largest if bits >= TERM_BITS else math.inf
        bits = min(TERM_BITS if bits < TERM_BITS else MOST_BITS, bits + more)


def _spill_folder(shared: str | None) -> str:
    """Where DuckDB spills: below the shared scratch folder if that is mounted here, else in the folder in which Spark keeps this executor's own spills."""
    root = shared or os.environ["SPARK_LOCAL_DIRS"].split(",")[0]
    return os.path.join(root, f"duckdb-{uuid.uuid4().hex}")


def _duckdb_counts(memory_mb: int, shared: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import shutil

        import duckdb

        first = next(batches, None)
        if first is None:
            return
        spill = _spill_folder(shared)
        con = duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": spill, "preserve_insertion_order": False})

        def chain():
            yield first
            yield from batches

        try:
            con.register("rows_in", pa.RecordBatchReader.from_batches(first.schema, chain()))
            query = """
                select term_field, term, split, sum(n)::bigint occurrences, count(record)::bigint records
                from (select term_field, term, split, record, sum(coalesce(n, 0)) n from rows_in group by all) group by all"""
            result = con.sql(query)
            yield from result.to_arrow_reader(65536) if hasattr(result, "to_arrow_reader") else result.fetch_arrow_reader(65536)
        finally:
            con.close()
            shutil.rmtree(spill, ignore_errors=True)

    return run


def term_counts(rows: DataFrame, leaf_bytes: int = LEAF_BYTES, bits: int | None = None, memory_mb: int = DUCKDB_MB) -> DataFrame:
    """Occurrences and records of every distinct (term_field, term).

    ``rows``: term_field string, term string, record bigint, n bigint (occurrences in this row). Null terms are no terms; the empty
    string is one. A null n counts as no occurrence, yet its record is counted; a null record adds occurrences but no record. Repeated rows
    add up. No rows give no terms. No term is dropped or capped. ``bits``: of the first partitions, by default some for every task.
    """
    spark = rows.sparkSession
    half = F.lit(0xFFFFFFFF).cast("bigint")
    key = F.shiftleft(F.xxhash64("term_field", "term").bitwiseAND(half), 32).bitwiseOR(F.xxhash64("record", F.lit(7)).bitwiseAND(half))
    size = F.octet_length("term") + F.coalesce(F.octet_length("term_field"), F.lit(0)) + ROW_BYTES
    named = rows.where("term is not null").select("term_field", "term", "record", "n")
    spilled = cut(named.withColumn("_radix", key).withColumn("_bytes", size.cast("bigint")), "radix")
    whole = spilled.agg(F.sum("_bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * -(-whole // leaf_bytes))
    first = bits or min(TERM_BITS, math.ceil(math.log2(parts)) + 5)
    levels, last, stuck = _leaves(spilled, first, leaf_bytes)
    placed = spilled.withColumn("_leaf", _prefix(first)).withColumn("split", F.lit(False))
    for (_, over), deeper in zip(levels, [*[b for b, _ in levels[1:]], last]):
        hit = F.broadcast(over.select(F.col("_prefix").alias("_leaf"), F.lit(True).alias("_hit")))  # see _oversized
        placed = placed.join(hit, "_leaf", "left").withColumn("_leaf", F.when(F.col("_hit"), _prefix(deeper)).otherwise(F.col("_leaf")))
        placed = placed.withColumn("split", F.col("split") | (F.coalesce("_hit", F.lit(False)) & F.lit(deeper > TERM_BITS))).drop("_hit")
    columns = ["term_field", "term", "split", "record", "n", "_leaf"]
    if stuck is not None:
        # one term of one record many times over: the only rows that Spark adds up before, as no hash tells them apart
        hit = F.broadcast(stuck.select(F.col("_prefix").alias("_leaf"), F.lit(True).alias("_hit")))
        marked = placed.join(hit, "_leaf", "left")
        added = marked.where("_hit").groupBy("term_field", "term", "split", "record", "_leaf").agg(F.sum("n").alias("n"))
        placed = marked.where("_hit is null").select(*columns).unionByName(added.select(*columns))
    placed = placed.repartition(parts, "_leaf").select("term_field", "term", "split", "record", "n")
    counted = cut(placed.mapInArrow(_duckdb_counts(memory_mb, shared_local_path(spark)), RESULT), "term-counts")
    # a term that was split by record has one partial row in each partition, with disjoint records
    merged = counted.where("split").groupBy("term_field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return counted.where("not split").drop("split").unionByName(merged)


def mark_terms(counts: DataFrame, totals: DataFrame, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
    """``counts`` with ``mark``: `rare` below ``rare_below`` records, `common` above the share ``common_above`` of the field's records, else null.

    ``totals``: term_field, all_records; one row per field. A term that is both (tiny collections) is `rare`. A field without a total has no common terms.
    """
    joined = counts.join(F.broadcast(totals), "term_field", "left")
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * F.col("all_records"), "common")
    return joined.withColumn("mark", mark).drop("all_records")
