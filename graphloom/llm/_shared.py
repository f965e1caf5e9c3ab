"""The folder that driver and executors share, and tables kept there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where unset, a folder of its own.

    In local mode that is a temporary folder, on a cluster a folder beside the
    warehouse tables, which executors share.
    """
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir") or (set_dir.get() if set_dir.isDefined() else None)
    if named is None:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        named = tempfile.mkdtemp(prefix="graphloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    if not set_dir.isDefined():
        sc.setCheckpointDir(named)
    return re.sub(r"^file:/+", "file:///", named)


_MADE: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; clean_up() removes it."""
    _MADE.append(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clean_up(spark: SparkSession) -> int:
    """Remove the indexes, archives and stage tables that this process wrote to the shared folder; how many there were.

    To be called when their results have been read: queries are lazy. Checkpoints go
    with their tables if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    return sum(remove(spark, path) for path in list(_MADE))


def remove(spark: SparkSession, path: str) -> bool:
    """Remove a folder in any file system that Spark can open; whether it was there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if path in _MADE:
        _MADE.remove(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder; lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch that goes to Python.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have the session send Python batches of BATCH_BYTES at most, or of what is set, if less.

    Spark's own batches of whole texts take up to 64 MB, beside as much again while
    they grow, in the executor for each task and again in each worker. Results do not
    depend on it. It stays set, since plans are lazy.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    least = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) if now else 0
    if not 0 < least <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def bytes_of(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's input size, for partition counts only; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


#: Rows up to which a table of short rows is broadcast.
SMALL = 200_000


def if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df with a broadcast hint if a count shows that it is small; results do not depend on it."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
