"""An extra beyond batch use: a stream of changed files kept as a current table.

Each micro-batch replaces the rows of its paths, so a batch that is delivered twice
changes nothing. Paths are dealt into buckets by hash; a batch writes the buckets
that it touches, under a version of its own, and leaves the others where they are. A
reader takes the newest complete version of each bucket. A removed path stays as a
row without content, so that a bucket never vanishes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extraction
from ..plans.session import settle
from ..sources.scan import classify

#: Buckets of a table; a batch rewrites those that hold one of its paths.
BUCKETS = 64
FILE_SCHEMA = "path string, content string, version long"


def latest(changes: DataFrame) -> DataFrame:
    """The newest row of each path."""
    newest = changes.groupBy("path").agg(F.max_by(F.struct("content", "version"), "version").alias("x"))
    return newest.select("path", "x.content", "x.version")


def merge(current: DataFrame | None, changes: DataFrame) -> DataFrame:
    """current (path, content, version) with the rows of changed paths replaced; null content removes."""
    new = latest(changes)
    if current is None:
        return new.filter("content is not null")
    return latest(current.unionByName(new)).filter("content is not null")


def follow(spark: SparkSession, source: str, table: str, checkpoint: str) -> StreamingQuery:
    """Follow JSON files of changes under source and keep table/v=<batch> current."""

    def step(batch: DataFrame, number: int) -> None:
        new = settle(latest(batch).withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")))
        touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}
        old = _stored(spark, table, touched, number)
        rows = new if old is None else old.unionByName(new)
        newest = rows.groupBy("bucket", "path").agg(F.max_by(F.struct("content", "version"), "version").alias("x"))
        newest.select("bucket", "path", "x.content", "x.version").repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{table}/v={number}")

    stream = spark.readStream.schema(FILE_SCHEMA).json(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, table: str, buckets: set[int] | None = None, before: int | None = None) -> DataFrame | None:
    """The newest complete version of each bucket, or of some, or before a batch; with removed paths."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(table).getFileSystem(conf)
    newest: dict[int, int] = {}
    for version in fs.listStatus(at(table)) if fs.exists(at(table)) else []:
        number = int(version.getPath().getName()[2:])
        if (before is None or number < before) and fs.exists(at(version.getPath(), "_SUCCESS")):
            for bucket in fs.listStatus(version.getPath()):
                name = bucket.getPath().getName()
                if name.startswith("bucket="):
                    newest[int(name[7:])] = max(number, newest.get(int(name[7:]), -1))
    out = None
    for number in sorted(set(newest.values())):
        held = [f"{table}/v={number}/bucket={b}" for b, n in newest.items() if n == number and (buckets is None or b in buckets)]
        if held:
            rows = spark.read.schema(FILE_SCHEMA + ", bucket int").option("basePath", f"{table}/v={number}").parquet(*held)
            out = rows if out is None else out.unionByName(rows)
    return out


def read(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The current files of a table, or those before a batch number; None if there is no table."""
    held = _stored(spark, table, None, before)
    return None if held is None else held.filter("content is not null").drop("bucket")


def tables(current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scan table, declarations) of the current files."""
    scan = classify(current)
    return scan, extraction.declarations(extraction.lines(current))
