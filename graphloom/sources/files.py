"""Folders of files as tables, and what is written into folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import text as X


def scan_tree(spark: SparkSession, root: str, names: str = "README*") -> DataFrame:
    """(path, directory, content): the files of a folder and all below it whose name fits a pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("directory"), F.decode("content", "UTF-8").alias("content"))


def source_index(spark: SparkSession, root: str) -> DataFrame:
    """One row per C file of a folder, from the listing alone: contents are not read. Build, version-control and
    temporary folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{c,h}").load(root).select("path", "length")
    below = F.regexp_replace("path", "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return indexed(files.select(below.alias("relative_path"), F.col("length").alias("size_bytes")), "relative_path")


def indexed(files: DataFrame, path: str) -> DataFrame:
    """``files`` of C sources with component, language and keywords of their paths."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    kept = files.where(F.col(path).rlike(r"\.[ch]$") & ~folder.rlike(r"build|\.git|tmp"))
    return kept.withColumns({"component": X.component_from_path(F.col(path)), "language": F.when(F.col(path).endswith(".c"), "c").otherwise("h"), "keywords": X.path_keywords(F.col(path))})


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """(question, query) of example files: a list, or an object with a list ``examples``; records of the forms
    question/query and instruction/output, others are left out."""
    record = T.StructType([T.StructField(c, T.StringType()) for c in ("question", "query", "instruction", "output")])
    shape = T.StructType([*record.fields, T.StructField("examples", T.ArrayType(record))])
    rows = spark.read.schema(shape).option("multiLine", True).json(path)
    plain = rows.select(*record.fieldNames())
    every = plain.unionByName(rows.select(F.explode("examples").alias("e")).select("e.*"))
    full = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("question"), F.col(b).alias("query")))
    return every.select(F.coalesce(full("question", "query"), full("instruction", "output")).alias("e")).where("e is not null").select("e.*")


def write_summaries(features: DataFrame, name: str, path: str) -> None:
    """One folder of JSON per feature, named by its slug."""
    features.withColumn("slug", X.slug(F.col(name))).write.mode("overwrite").partitionBy("slug").json(path)


def resumed(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not in the output yet: keys already written are left out."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def content_key(*columns: Column) -> Column:
    """Key of a cache entry by what it was made from, so changed texts are never taken for cached ones."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def write_vectors(vectors: DataFrame, path: str, collection: str, replace: bool = False) -> None:
    """A collection of vectors; an existing one is kept unless it is to be replaced."""
    vectors.withColumn("collection", F.lit(collection)).write.mode("overwrite" if replace else "ignore").parquet(f"{path}/collection={collection}")
