"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SMALL_ROWS, SMALL_BYTES = 100_000, 4 << 20
_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def local_session(cpus: int | str = "*", partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("proofloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only for a local master that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="proofloom-")
    return f"file://{_own[app]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch root, removed when the driver ends."""
    path = f"{scratch_root(spark)}/proofloom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


def shared_local_path(spark: SparkSession) -> str | None:
    """The scratch root as a plain path if it lies on a mounted file system, else None."""
    root = scratch_root(spark)
    if root.startswith("file:"):
        return "/" + root[5:].lstrip("/")
    return root if root.startswith("/") and "://" not in root else None


def _stored_bytes(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def cut(df: DataFrame, label: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back: the lineage ends there,
    columns stay prunable, and a lost executor takes nothing with it.

    The planner knows such a table by its compressed size and would broadcast what takes many times as much in memory. So joins with it are merge joins, unless all
    its columns have a fixed width and it has at most ``SMALL_ROWS`` rows (told by the footers of its files, if these are small): some megabytes that may be broadcast.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    fixed = all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) for f in df.schema)
    small = fixed and _stored_bytes(spark, path) <= SMALL_BYTES and back.count() <= SMALL_ROWS
    return back if small else back.hint("merge")


def clear_scratch() -> None:
    """Remove everything that ``cut`` wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            local = path[7:] if path.startswith("file://") else path
            if os.path.isdir(local):
                import shutil

                shutil.rmtree(local, ignore_errors=True)


atexit.register(clear_scratch)
