"""Conversations from message rows by fragment assembly.

Every message row is an export fragment of two message hashes: the message and the one it answers.
A fragment whose last hash is the first of another overlaps it. In the overlap graph a fragment has
at most one way upwards - unless copies of a message name different parents, which makes the path
ambiguous - so overlapping fragments are merged along unambiguous paths; every round merges each
open fragment with the one it meets, which doubles the length, until it reaches an opening message
or a gap. What is still open when a round closes nothing goes in a circle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize
from graphloom.skew import lookup_join, ranked_in_group

OPEN, ROOTED, BROKEN = 0, 1, 2


def bare_identifier(c: Column) -> Column:
    """An identifier without blanks and brackets, or null where nothing is left."""
    bare = F.regexp_replace(c, r"[\s<> ]", "")
    return F.when(bare != "", bare)


def sender_address(c: Column) -> Column:
    """The address in a sender field, lower case; the field itself where it shows none."""
    address = F.lower(F.regexp_extract(F.regexp_replace(c, r"(?i)\s+at\s+(?=[\w.-]+\.\w+)", "@"), r"([^\s<>()\"@,;]+@[^\s<>()\"@,;]+)", 1))
    return F.when(address != "", address).otherwise(F.lower(F.trim(c)))


def instant_of(c: Column) -> Column:
    """ISO text with offset or Z as a timestamp, null where it is none."""
    return F.regexp_replace(F.trim(c), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")


def _hash(c: Column) -> Column:
    return F.unhex(F.md5(c))


def messages_of(rows: DataFrame) -> DataFrame:
    """One row per message: id, its hash, its parent, instant, sender, whether it is whole, whether
    copies name different parents. Combined before the shuffle, so copies may be many."""
    blank = F.regexp_replace(F.coalesce("body", F.lit("")), r"[\s ​]", "") == ""
    m = rows.select(
        bare_identifier(F.col("message_id")).alias("id"),
        bare_identifier(F.col("parent_id")).alias("parent"),
        instant_of(F.col("date")).alias("instant"),
        sender_address(F.col("from")).alias("sender"),
        blank.alias("blank"),
        "msg_key",
    ).where("id is not null")
    first = m.groupBy("id").agg(
        F.min_by(F.struct("instant", "sender", "blank"), "msg_key").alias("first"),
        F.min("parent").alias("parent"),
        ((F.min("parent") != F.max("parent")) | ((F.count("parent") > 0) & (F.count("parent") < F.count(F.lit(1))))).alias("ambiguous"),
    )
    return first.select(
        "id",
        _hash(F.col("id")).alias("h"),
        _hash(F.col("parent")).alias("p"),
        "first.instant",
        "first.sender",
        (F.col("first.instant").isNotNull() & ~F.col("first.blank")).alias("whole"),
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
    )


def assemble(messages: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(h, root) of every message whose fragments merge up to an opening message."""
    state = materialize(
        messages.select("h", F.coalesce("p", "h").alias("end"), F.when(F.col("ambiguous"), BROKEN).when(F.col("p").isNull(), ROOTED).otherwise(OPEN).alias("status")),
        "fragments",
    )
    closed, opened = [state.where(F.col("status") != OPEN)], state.where(F.col("status") == OPEN)
    for _ in range(max_rounds):
        upper = opened
        for c in closed:
            upper = upper.unionByName(c)
        upper = upper.select(F.col("h").alias("end"), F.col("end").alias("_end"), F.col("status").alias("_status"))
        merged = materialize(
            lookup_join(opened.select("h", "end"), upper, "end", "left").select(
                "h", F.coalesce("_end", "end").alias("end"), F.coalesce("_status", F.lit(BROKEN)).alias("status")
            ),
            "fragments",
        )
        done = merged.where(F.col("status") != OPEN)
        if not done.take(1):
            break
        closed.append(done)
        opened = merged.where(F.col("status") == OPEN)
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out.where(F.col("status") == ROOTED).select("h", F.col("end").alias("root"))


def conversations(rows: DataFrame, large_group: int = 100_000) -> DataFrame:
    """(root_message_id, turn_no, message_id, role, instant) of every sound conversation.

    Sound: every message has a readable date and a body that is not blank, and one sender at least
    differs from the opener's. Messages in circles, below a missing or an ambiguous message belong
    to no conversation. A row without message_id is ignored; a message stored several times counts
    once, as it was stored first (smallest msg_key; null keys last). Equal instants are ordered by
    identifier. Senders that are null are nobody. Further columns are not read; an empty table gives
    an empty result.
    """
    messages = materialize(messages_of(rows), "messages")
    rooted = materialize(messages.join(assemble(messages), "h").select("id", "h", "root", "instant", "sender", "whole"), "rooted")
    stats = (
        rooted.groupBy("root")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("whole").alias("whole"),
            F.min("sender").alias("low"),
            F.max("sender").alias("high"),
            F.max(F.when(F.col("h") == F.col("root"), F.col("sender"))).alias("opener"),
            F.max(F.when(F.col("h") == F.col("root"), F.col("id"))).alias("root_id"),
        )
        .where(F.col("whole") & ((F.col("low") != F.coalesce("opener", F.lit(""))) | (F.col("high") != F.coalesce("opener", F.lit("")))))
        .select("root", "_n", "opener", "root_id")
    )
    stats = materialize(stats, "conversations")
    kept = lookup_join(rooted.drop("whole"), stats.drop("_n"), "root")
    turns = ranked_in_group(kept, "root", ["instant", "id"], "turn_no", stats.select("root", "_n"), large_group)
    bracketed = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    return turns.select(
        bracketed("root_id").alias("root_message_id"),
        "turn_no",
        bracketed("id").alias("message_id"),
        F.when(F.col("sender").eqNullSafe(F.col("opener")), "opener").otherwise("responder").alias("role"),
        "instant",
    )
