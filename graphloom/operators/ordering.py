"""Numbering rows in a total order without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import settle

_ROWS = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[str], name: str = "k") -> DataFrame:
    """df with `name`, the number of each row from 0 in the order of some columns.

    Rows are dealt by range and sorted there; a table with one row for each range
    says how many rows come before it.
    """
    dealt = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranges = dealt.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select("_range", before.alias("_before"))
    out = dealt.join(F.broadcast(offsets), F.shiftright(F.col("_at"), 33) == F.col("_range"))
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_ROWS))).drop("_at", "_range", "_before")
