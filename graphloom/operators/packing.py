"""Packing ranked files into a token budget, as windows instead of greedy loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCERPT, SUMMARY = 200, 50


def pack(scored: DataFrame, budget: int | Column) -> DataFrame:
    """(pack_id, path, score, mode, reason, estimated) for (pack_id, path, score, tokens, is_seed, hash).

    From the lowest score upward files are cut to an excerpt, then to a summary,
    then dropped, until the budget is met. Each pass takes a prefix of that order,
    so running sums say where it stops: a file is cut while no total before it has
    met the budget (a running minimum, for cutting a tiny file raises the total).
    Packs are independent, and each is one window partition: callers rank a whole
    repository first and pack its best files.
    """
    by = Window.partitionBy("pack_id")
    up = by.orderBy("score", F.desc("path"))
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    x = scored.withColumns({"pos": F.row_number().over(up), "full": F.sum("tokens").over(by), "saved": F.coalesce(F.sum(F.col("tokens") - EXCERPT).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    x = x.withColumn("excerpt", F.min(F.col("full") - F.col("saved")).over(up.rowsBetween(Window.unboundedPreceding, 0)) > limit)
    x = x.withColumn("t1", F.col("full") - F.coalesce(F.sum(F.when(F.col("excerpt"), F.col("tokens") - EXCERPT)).over(by), F.lit(0)))
    x = x.withColumn("summary", F.col("excerpt") & (F.col("t1") - (EXCERPT - SUMMARY) * (F.col("pos") - 1) > limit))
    x = x.withColumn("t2", F.col("t1") - (EXCERPT - SUMMARY) * F.sum(F.col("summary").cast("long")).over(by))
    x = x.withColumn("dropped", F.col("summary") & (F.col("t2") - SUMMARY * (F.col("pos") - 1) > limit))
    x = x.withColumn("estimated", F.greatest(F.lit(0), F.col("t2") - SUMMARY * F.sum(F.col("dropped").cast("long")).over(by)).cast("long"))
    down = by.orderBy(F.desc("score"), "path")
    mode = F.when(F.col("dropped"), "excluded").when(F.col("summary"), "summary").when(F.col("excerpt"), "excerpt").otherwise("full")
    reason = F.when(F.col("dropped"), F.lit(None)).when(F.col("is_seed"), "seed").when(F.row_number().over(down) == 1, "direct_import").otherwise("transitive_dep")
    return x.select("pack_id", "path", "score", mode.alias("mode"), reason.alias("reason"), "tokens", "hash", "estimated")


#: Lines of a file that an excerpt shows.
EXCERPT_LINES = 50


def with_content(packed: DataFrame, contents: DataFrame) -> DataFrame:
    """packed without what it left out, and what each file shows: all of it, its first lines, or its name.

    contents: (path, content). A file that has none shows null.
    """
    held = packed.filter("mode <> 'excluded'").join(contents.select("path", "content"), "path", "left")
    head = F.concat(F.array_join(F.slice(F.split("content", "\n"), 1, EXCERPT_LINES), "\n"), F.lit("\n// ... (excerpt)"))
    note = F.concat(F.lit("// Summary: "), "path", F.lit(" - "), "reason")
    shown = F.when(F.col("content").isNull(), None).when(F.col("mode") == "full", F.col("content")).when(F.col("mode") == "excerpt", head).otherwise(note)
    return held.select(*packed.columns, shown.alias("shown"))


def token_ledger(files: DataFrame, packed: DataFrame) -> DataFrame:
    """One row: tokens of all files, of the pack, and what the pack saves."""
    base = files.agg(F.sum(F.greatest(F.lit(20), F.ceil(F.coalesce("size", F.lit(500)) / 4))).cast("long").alias("baseline"), F.count("*").alias("baseline_files"))
    modes = ("full", "excerpt", "summary")
    kept = packed.filter("mode <> 'excluded'").agg(F.coalesce(F.max("estimated"), F.lit(0)).cast("long").alias("packed"), F.count("*").alias("packed_files"), *(F.count(F.when(F.col("mode") == m, 1)).alias(f"n_{m}") for m in modes))
    both = base.crossJoin(kept)
    saved = F.col("baseline") - F.col("packed")
    return both.select("*", saved.alias("saved"), F.round(F.try_divide(saved * 100, F.col("baseline")), 2).alias("percent"), F.round(F.try_divide(F.col("baseline"), F.col("packed")), 2).alias("ratio"))
