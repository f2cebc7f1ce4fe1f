"""Module rollup kept up to date from a stream of dependency edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_edges(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Edges as they arrive in the folder ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def rollup(edges: DataFrame, late: str = "7 days") -> DataFrame:
    """Occurrences by module pair and layer; an edge sent again within ``late`` of its first arrival counts once, the state of older edges is dropped. Null targets are no edges."""
    timed = edges.where("target is not null").withColumn("received_at", F.col("received_at").cast("timestamp"))
    once = timed.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["source_id", "target", "layer"])
    modules = [F.coalesce(c, F.lit("<unknown>")).alias(c) for c in ("source_module", "target_module")]
    return once.groupBy(*modules, "layer").agg(F.sum("occurrences").alias("occurrences"))


def start(result: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Run ``result`` over what is there now; every batch replaces the Parquet table at ``path`` with the rollup so far, so no result is held by the driver."""

    def write(rows: DataFrame, _: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    return result.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
