"""JSON and JSON lines as tables, read and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """A file or folder of JSON lines under a fixed schema. Malformed lines are left out, or with
    ``strict`` stop the query; keys that are not there are null."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    bad = "_malformed"
    marked = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    # parsed from text: the file reader refuses plans that need the malformed column alone
    parsed = F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
    return rows.where(F.col(bad).isNull()).drop(bad)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole-file JSON: an object or an array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines, in as many files as the table has partitions."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
