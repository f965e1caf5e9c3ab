"""Graph views over the star-schema and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, extname, kind, language
from ..operators.ranking import default_weight


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, ext, size, hash, kind, lang, source, lang_code): documents as files."""
    d = table(spark, sf_dir, "documents")
    m = F.col("doc_id") % 7
    ext = F.when(m == 0, ".test.ts").when(m == 1, ".py").when(m == 2, ".md").when(m == 3, ".json").otherwise(".ts")
    path = F.concat(F.lit("packages/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    x = d.select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "source", F.col("lang").alias("lang_code"))
    return x.withColumns({"ext": extname(F.col("path")), "kind": kind(F.col("path")), "lang": language(F.col("path"))})


def file_nodes(f: DataFrame) -> DataFrame:
    return f.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("type"), basename(F.col("path")).alias("label"), "path", "kind", "lang", "hash", F.lit(None).cast("boolean").alias("exported"))


def domain_nodes(f: DataFrame) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    return f.select("source").distinct().select(F.concat(F.lit("domain:"), "source").alias("id"), F.lit("domain").alias("type"), F.col("source").alias("label"), none("string"), none("string"), none("string"), none("string"), none("boolean"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File and domain nodes."""
    f = files(spark, sf_dir)
    return file_nodes(f).union(domain_nodes(f))


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, type) between document numbers: imports from line items and neighbours, and tests."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    n = d.count()
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1 and l_returnflag = 'R'").select((F.col("l_orderkey") % n).alias("a"), (F.col("l_partkey") % n).alias("b"))
    near = d.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 20).alias("b")).filter(F.col("b") < n)
    imports = li.union(near).filter("a <> b").distinct().withColumn("type", F.lit("imports"))
    tests = d.filter((F.col("doc_id") % 7 == 0) & (F.col("doc_id") + 1 < n)).select("doc_id", F.col("doc_id") + 1, F.lit("tests"))
    return imports.union(tests)


def edges(spark: SparkSession, sf_dir: str, semantic: bool = True) -> DataFrame:
    """(src, dst, type, weight): file edges and, with semantic, the files' domains."""
    f = files(spark, sf_dir)
    ids = f.select("doc_id", F.concat(F.lit("file:"), "path").alias("id"))
    a, b = ids.select(F.col("doc_id").alias("a"), F.col("id").alias("src")), ids.select(F.col("doc_id").alias("b"), F.col("id").alias("dst"))
    out = doc_pairs(spark, sf_dir).join(a, "a").join(b, "b").select("src", "dst", "type")
    if semantic:
        out = out.union(f.select(F.concat(F.lit("file:"), "path"), F.concat(F.lit("domain:"), "source"), F.lit("belongs_to_domain")))
    return out.withColumn("weight", default_weight(F.col("type")))


def folder_edges(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders (id, path), contains (src, dst)) of a table of paths (path)."""
    up = paths.select("path", F.explode(ancestors(F.col("path"))).alias("folder")).select("folder").distinct()
    parent = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    inner = up.filter(F.col("folder").contains("/")).select(F.concat(F.lit("folder:"), parent("folder")).alias("src"), F.concat(F.lit("folder:"), "folder").alias("dst"))
    leaf = paths.filter(F.col("path").contains("/")).select(F.concat(F.lit("folder:"), parent("path")).alias("src"), F.concat(F.lit("file:"), "path").alias("dst"))
    return up.select(F.concat(F.lit("folder:"), "folder").alias("id"), F.col("folder").alias("path")), inner.union(leaf).distinct()
