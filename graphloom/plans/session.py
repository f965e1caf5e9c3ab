"""Session settings and cutting lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "graphloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and small data; on a cluster bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def settle(df: DataFrame) -> DataFrame:
    """df, computed once and kept in spark.checkpoint.dir, from where a lost executor's part is read again."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            local = re.fullmatch(r"local(\[.*\])?", sc.master)
            named = tempfile.mkdtemp(prefix="graphloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)
