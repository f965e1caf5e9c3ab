"""From raw documents to a training mix: five operators, each stage written and read again.

Every filtering stage computes its decisions over all rows it is given and drops
the rejected ids; texts are not shuffled for that while the rejected ids are few
enough to broadcast (their number is counted first).

Defined results of every stage: decisions go by doc_id, so rows that repeat a
rejected id go together; a row with a null doc_id cannot be named by a decision and
stays; null and empty texts are judged as empty ones; ties are broken by the
smallest doc_id; columns beside those of documents stay with their rows, and names
that clash with an operator's own do no harm; an empty table stays an empty table
with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, jaccard, mixing, quality, toxicity
from graphloom.llm._shared import fresh_path, settle

#: Ids up to which a set of them is broadcast; beyond, a shuffled join.
BROADCAST_IDS = 1_000_000


def _few(ids: DataFrame) -> bool:
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (one column, id)."""
    gone = settle(ids.filter("id is not null").select(F.col("id").alias("_gone")).distinct())
    return docs.join(F.broadcast(gone) if _few(gone) else gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(docs.columns)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; without confirmed toxic labels none does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without(docs, toxicity.toxicity(docs, labels).filter("predicted = 1"))


def junk_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go, null and empty texts among them."""
    return without(docs, quality.quality_rules(docs).filter("not kept"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id.

    Rows that repeat an id are one document, of which one row stays. Texts without
    words are no copies of each other and stay.
    """
    found = settle(jaccard.ngram_jaccard_join(docs))
    kept = without(docs, found.filter("id <> component_id"))
    again = found.filter("n_copies > 1 and id = component_id").groupBy("id").count().filter("count > 1").select("id")
    if again.isEmpty():
        return kept
    once = without(kept, again)
    return once.union(kept.join(again.withColumnRenamed("id", "_again"), F.col("doc_id") == F.col("_again"), "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go.

    One leaked item is a leak: the operator's own verdict, two items or more, is too
    weak for a training mix. An empty benchmark rejects nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontaminate.contamination(docs, benchmark).filter("n_hit > 0"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as a list: every document with its copies and the words taken; one with 0 is left out of it."""
    return mixing.mix(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxic_out),
    ("quality_rules", junk_out),
    ("ngram_jaccard_join", near_copies_out),
    ("benchmark_decontamination", contaminated_out),
    ("mixing", mix),
]

#: The first stage trains a classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
