"""Work per key without tasks that hold most of the rows.

``number_within_keys`` numbers the rows of every key exactly: rows are counted per input partition and
key, the counts are summed up over the partitions, and each row adds its place inside its partition.
``key_statistics`` cuts the numbered rows of every key into chunks of equal size, evaluates the chunks
on their own and merges their boundary states in order. ``join_key_values`` attaches a value per key
where a few keys hold most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.session import cut

CHUNK_ROWS = 1 << 16
HOT_KEYS = 1000
RANGE_ROWS = 1 << 22


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    test = left[names[0]].eqNullSafe(right[names[0]])
    for n in names[1:]:
        test = test & left[n].eqNullSafe(right[n])
    return test


def number_within_keys(df: DataFrame, keys: list[str], order: list[str], number: str = "_number", partitions: int | None = None, amount: str | None = None) -> DataFrame:
    """``df`` with a bigint column ``number``: 1, 2, ... within each key, in ``order`` (nulls first).

    Same values as ``row_number`` over (keys, order, hash of the row), but no task takes a whole key: the
    largest group is one key's share of one range partition. No keys: all rows are numbered. With ``amount`` the column holds
    the sum of that column over the rows before. Rows alike in every column are interchangeable
    and get consecutive numbers. Null keys are a key of their own. Empty input gives an empty result. Without ``partitions`` there are as many ranges as
    keep ``RANGE_ROWS`` rows each, at least those of spark.sql.shuffle.partitions.
    """
    spark = df.sparkSession
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    base = cut(df.withColumn("__tie", tie), "to-number")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // RANGE_ROWS))
    placed = base.repartitionByRange(n, *[F.col(f"`{c}`").asc_nulls_first() for c in order], F.col("__tie"))
    placed = cut(placed.withColumn("__part", F.spark_partition_id()), "placed")
    size = F.count(F.lit(1)) if amount is None else F.coalesce(F.sum(amount), F.lit(0))
    counts = placed.groupBy("__part", *keys).agg(size.alias("__rows"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range, at most
    offsets = counts.select("__part", *keys, F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part", *keys).orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order], "__tie")
    place = F.row_number().over(inside) if amount is None else F.coalesce(F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = placed.withColumn("__place", place)
    joined = rows.join(offsets.hint("merge"), _same(rows, offsets, ["__part", *keys]), "inner")
    return joined.select(*[rows[c] for c in df.columns], (F.col("__offset") + F.col("__place")).alias(number))


def key_statistics(df: DataFrame, keys: list[str], distinct: str, total: str, names: tuple[str, str, str] = ("rows", "total", "distinct"), chunk_rows: int = CHUNK_ROWS, partitions: int | None = None) -> DataFrame:
    """Per key: the number of rows, the sum of ``total`` (0 if all are null) and the number of distinct non-null ``distinct``.

    The rows of a key are numbered in the order of ``distinct`` and processed in chunks of ``chunk_rows``
    numbers. A chunk's state is (rows, total, distinct values, first value, last value); neighbouring chunks
    of a key share a value exactly if the last of one is the first of the next, so the states merge in order
    to exact figures. Null keys form a key; an empty table gives no keys.
    """
    value, amount = F.col("_value"), F.col("_amount")
    base = df.select(*keys, F.col(f"`{distinct}`").alias("_value"), F.col(f"`{total}`").alias("_amount"))
    numbered = number_within_keys(base, keys, ["_value"], partitions=partitions)
    chunked = numbered.withColumn("__chunk", F.floor((F.col("_number") - 1) / F.lit(chunk_rows)))
    runs = chunked.groupBy(*keys, "__chunk", value).agg(F.count(F.lit(1)).alias("__rows"), F.sum(amount).alias("__sum"))
    states = runs.groupBy(*keys, "__chunk").agg(
        F.sum("__rows").alias("__rows"), F.sum("__sum").alias("__sum"), F.count(value).alias("__distinct"), F.min(value).alias("__first"), F.max(value).alias("__last")
    )
    along = Window.partitionBy(*keys).orderBy("__chunk")
    shared = F.coalesce((F.lag("__last").over(along) == F.col("__first")).cast("bigint"), F.lit(0))
    merged = states.withColumn("__shared", shared).groupBy(*keys)
    return merged.agg(
        F.sum("__rows").alias(names[0]), F.coalesce(F.sum("__sum"), F.lit(0)).alias(names[1]), F.sum(F.col("__distinct") - F.col("__shared")).alias(names[2])
    )


def join_key_values(big: DataFrame, values: DataFrame, on: list[str], weight: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """``big`` with the columns of ``values``, whose ``on`` is unique and whose ``weight`` is about the number of rows of ``big`` with that key.

    A key with more than 1/``hot_keys`` of the rows is hot: its rows are spread over one salt per 1/``hot_keys`` that it holds, and its values are
    repeated for every salt, so no task gets much more than that share. Salts number fewer than twice ``hot_keys``. Both sides learn of them from a broadcast
    of (hash of the key, salts), fewer than ``hot_keys`` rows of 12 bytes whatever the values hold; the join itself is a merge of two shuffled sides, so no
    estimate of a size makes it a broadcast. Rows whose key has no value, or is null, keep nulls. ``values`` should be cheap to read again (see ``session.cut``).
    """
    extra = [c for c in values.columns if c not in on]
    rows = values.agg(F.sum(weight)).first()[0] or 0
    key_hash = F.xxhash64(*[F.col(f"`{c}`") for c in on])
    salts = F.ceil(F.col(weight) * hot_keys / F.lit(max(rows, 1))).cast("int")
    hot = values.where(F.col(weight) * hot_keys > F.lit(rows)).groupBy(key_hash.alias("__hash")).agg(F.max(salts).alias("__salts"))
    missing = F.lit(False)
    for c in on:
        missing = missing | F.col(f"`{c}`").isNull()
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in big.columns])
    left = big.withColumn("__hash", key_hash).join(F.broadcast(hot), "__hash", "left")
    left = left.withColumn("__salt", F.when(missing, -1 - F.pmod(spread, F.lit(1 << 20))).otherwise(F.pmod(spread, F.coalesce("__salts", F.lit(1)))).cast("int")).select(*[F.col(f"`{c}`") for c in big.columns], "__salt")
    right = values.withColumn("__hash", key_hash).join(F.broadcast(hot), "__hash", "left")
    right = right.select(*[F.col(c).alias(f"__c_{c}") for c in on], F.struct(*extra).alias("__value"), F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)).alias("__salt_c"))
    test = left["__salt"] == right["__salt_c"]
    for c in on:
        test = test & (left[c] == right[f"__c_{c}"])
    joined = left.join(right.hint("merge"), test, "left")
    return joined.select(*[left[c] for c in big.columns], *[joined["__value"][c].alias(c) for c in extra])
