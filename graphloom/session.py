"""Session helpers: table loading, checkpoints in the shared folder, scratch tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, as a lazy scan (columns are pruned by Catalyst)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The folder shared by all executors: ``spark.checkpoint.dir``. Only on a local master, where all
    executors are this machine, a temporary one is made for a session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("graphloom.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="graphloom-checkpoint-")
        spark.conf.set("graphloom.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives the loss
    of executors, and gives later stages exact sizes for their join choices."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized ``frames``, which nothing may read any more. Spark drops the shuffle files of
    ended plans only once the driver collects its garbage, so that is asked for too."""
    spark = SparkSession.active()
    jvm = spark.sparkContext._jvm
    for f in {f.rpartition("/")[0] for df in frames for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()
