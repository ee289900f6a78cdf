"""Joins and aggregations that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows; so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def hot_keys(keys: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys with more than 1/``share`` of all non-null rows of ``keys``: at most ``share`` rows
    whatever the input, which is the size bound that lets callers broadcast them. The counts are
    combined before the shuffle, so a hot key reaches its reducer as one row a map task."""
    known = keys.where(F.col(key).isNotNull())
    total = known.agg(F.count(F.lit(1)).alias("_total"))
    n = known.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return n.where((F.col("_n") * share > total.scalar()) & (F.col("_n") > share)).select(key)


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``facts`` joined with ``lookup`` (unique on ``key``), hot fact keys apart.

    The lookup rows of hot keys are few (see :func:`hot_keys`) and are broadcast, so their fact
    rows are never shuffled to one task; all other keys take the ordinary shuffled join.
    Null keys match nothing; with ``how='left'`` their rows stay.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    hot = hot_keys(facts.select(key), key) if hot is None else hot
    flag = F.broadcast(hot.select(F.col(key).alias("_hot_key")))
    tagged = facts.join(flag, F.col(key) == F.col("_hot_key"), "left")
    cold = tagged.where(F.col("_hot_key").isNull()).drop("_hot_key").join(lookup, key, how)
    hot_rows = tagged.where(F.col("_hot_key").isNotNull()).drop("_hot_key")
    hot_lookup = lookup.join(F.broadcast(hot), key, "left_semi")
    return cold.unionByName(hot_rows.join(F.broadcast(hot_lookup), key, how))


def ranked_in_group(df: DataFrame, group: str, order: list[str], result: str, sizes: DataFrame, limit: int = 100_000) -> DataFrame:
    """``df`` with a 1-based rank within ``group`` by ``order`` (which must be unique in a group).

    ``sizes`` holds (group, _n). Groups up to ``limit`` rows take a window. Larger ones are range-
    partitioned by (group, order), ranked within each partition, and shifted by the counts of the
    partitions before, so no task ever holds a whole large group.
    """
    from pyspark.sql import Window

    from graphloom.session import materialize

    large = sizes.where(F.col("_n") > limit).select(group)
    plain = df.join(large, group, "left_anti").withColumn(result, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint"))
    if not large.take(1):
        return plain
    ranged = df.join(large, group, "left_semi").repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranked")
    counts = ranged.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    local = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)))
    shifted = local.join(shifts, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return plain.unionByName(shifted.withColumn(result, (F.col("_rank") + F.col("_shift")).cast("bigint")).select(plain.columns))
