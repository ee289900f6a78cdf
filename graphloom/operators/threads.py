"""Threads of messages: the root of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize
from graphloom.skew import lookup_join


def roots(messages: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, root) of every message that reaches one without a parent that is there. Pointers are doubled:
    each round replaces a message's ancestor by that one's ancestor; messages in circles stay out."""
    bare = lambda c: F.nullif(F.regexp_replace(c, r"[\s<>]", ""), F.lit(""))
    m = messages.select(bare("message_id").alias("id"), bare("parent_id").alias("up"), "msg_key").where("id is not null")
    m = m.groupBy("id").agg(F.min_by(F.struct("up"), "msg_key").alias("m")).select("id", "m.up")
    there = m.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    state = materialize(lookup_join(m.where("up is not null"), there, "up", "left").select("id", F.when(F.col("there"), F.col("up")).otherwise(F.col("id")).alias("root"), F.coalesce(~F.col("there"), F.lit(True)).alias("done")).unionByName(m.where("up is null").select("id", F.col("id").alias("root"), F.lit(True).alias("done"))), "roots")
    done, open_ = state.where("done"), state.where("not done")
    for _ in range(max_rounds):
        upper = done.unionByName(open_).select(F.col("id").alias("root"), F.col("root").alias("_root"), F.col("done").alias("_done"))
        moved = materialize(lookup_join(open_.select("id", "root"), upper, "root").select("id", F.col("_root").alias("root"), F.col("_done").alias("done")), "roots")
        if not moved.where("done").take(1):
            break
        done, open_ = done.unionByName(moved.where("done")), moved.where("not done")
    return done.select("id", "root")
