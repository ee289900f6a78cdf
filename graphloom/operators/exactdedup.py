"""Exactly-once delivery: quotient hash tables over message identifiers.

An identifier is mapped to a fixed-width 128-bit word by two seeded 64-bit hashes, the word is
permuted by a bijection (so nothing is lost), and the word is split into a *quotient* - the shard
of the table - and the complete *remainder*. A slot is found by (quotient, remainder) and holds the
identifier itself, so that two identifiers never share a slot even if their 128 bits collide: there
are no false matches. Inserting keeps the smallest delivery per identifier; the insertion is a
hash aggregation, combined on the map side, so an identifier that makes up a third of the rows
reaches its shard as one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.skew import hot_keys, lookup_join

#: local@host; neither part holds blanks, brackets or another @.
IDENTIFIER = r"([^\s<>@]+)@([^\s<>@]+)"


def _canonical(text: Column) -> Column:
    """``local@host`` with the host in lower case, or null where the text holds no identifier."""
    local, host = F.regexp_extract(text, IDENTIFIER, 1), F.regexp_extract(text, IDENTIFIER, 2)
    return F.when(local != "", F.concat(local, F.lit("@"), F.lower(host)))


def message_identifier(message_id: Column) -> Column:
    """The identifier in a message-id field in any of its spellings (brackets, blanks, none)."""
    return _canonical(message_id)


def url_identifier(url: Column) -> Column:
    """The identifier in the path of an archive address, percent-decoded (``+`` stays a plus)."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    raw = F.regexp_extract(path, r"(?i)/message-id/(?:[^/]*/)*([^/]*(?:@|%40)[^/]*)", 1)
    return _canonical(F.try_url_decode(F.regexp_replace(raw, r"\+", "%2B")))


def delivery_identifier(message_id: Column, url: Column) -> Column:
    """The identifier of a delivery: of message_id, and only where that has none, of the url."""
    return F.coalesce(message_identifier(message_id), url_identifier(url))


def _rotate(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def _permute(hi: Column, lo: Column) -> tuple[Column, Column]:
    """A bijection on 128 bits: three Feistel rounds of rotate-xor functions."""
    for n in (23, 41, 13):
        hi, lo = lo, hi.bitwiseXOR(_rotate(lo, n)).bitwiseXOR(F.shiftrightunsigned(lo, n // 2))
    return hi, lo


def slots(df: DataFrame, identifier: str, quotient_bits: int = 16) -> DataFrame:
    """Adds quotient, remainder_hi (the bits of the high word below the quotient) and remainder_lo."""
    hi, lo = _permute(F.xxhash64(F.col(identifier)), F.xxhash64(F.lit(0x5BD1E995), F.col(identifier)))
    return (
        df.withColumns({"_hi": hi, "remainder_lo": lo})
        .withColumns(
            {
                "quotient": F.shiftrightunsigned("_hi", 64 - quotient_bits).cast("int"),
                "remainder_hi": F.col("_hi").bitwiseAND(F.lit((1 << (64 - quotient_bits)) - 1)),
            }
        )
        .drop("_hi")
    )


def quotient_table(deliveries: DataFrame, identifier: str, delivery: str, quotient_bits: int = 16) -> DataFrame:
    """The table after inserting all ``deliveries``: one slot per identifier with its first delivery
    and the number of deliveries. Rows with a null identifier are not inserted."""
    keyed = slots(deliveries.where(F.col(identifier).isNotNull()).select(identifier, delivery), identifier, quotient_bits)
    return keyed.groupBy("quotient", "remainder_hi", "remainder_lo", identifier).agg(
        F.min(delivery).alias("kept"), F.count(F.lit(1)).alias("deliveries")
    )


def insert_batch(known: DataFrame, batch: DataFrame, identifier: str, delivery: str, quotient_bits: int = 16) -> DataFrame:
    """A stored table with a further batch inserted; both are combined slot by slot, so the result
    equals that of one build over all batches, in whatever order they came."""
    new = quotient_table(batch, identifier, delivery, quotient_bits)
    return (
        known.unionByName(new)
        .groupBy("quotient", "remainder_hi", "remainder_lo", identifier)
        .agg(F.min("kept").alias("kept"), F.sum("deliveries").alias("deliveries"))
    )


def surplus_deliveries(mail: DataFrame, quotient_bits: int = 16) -> DataFrame:
    """(kept_delivery_id, surplus_delivery_id) for every delivery after the first of its mail.

    Nulls: a row without identifier in message_id and url is nobody's copy and gives nothing, as
    does a null delivery_id. Repeated rows with one delivery_id are one delivery. An empty table
    gives an empty result. Further columns of ``mail`` are not read.
    """
    found = (
        mail.select(F.col("delivery_id").cast("bigint").alias("_delivery"), delivery_identifier(F.col("message_id"), F.col("url")).alias("_identifier"))
        .where(F.col("_identifier").isNotNull() & F.col("_delivery").isNotNull())
    )
    repeated = quotient_table(found, "_identifier", "_delivery", quotient_bits).where("deliveries > 1").select("_identifier", "kept")
    pairs = lookup_join(found, repeated, "_identifier", hot=hot_keys(found, "_identifier"))
    return (
        pairs.where(F.col("_delivery") > F.col("kept"))
        .select(F.col("kept").alias("kept_delivery_id"), F.col("_delivery").alias("surplus_delivery_id"))
        .distinct()
    )


def first_deliveries(mail: DataFrame) -> DataFrame:
    """``mail`` without the surplus deliveries: every column kept, exactly one row per identified
    mail; rows without an identifier all stay."""
    surplus = surplus_deliveries(mail).select(F.col("surplus_delivery_id").alias("_surplus"))
    return mail.join(surplus, mail["delivery_id"] == F.col("_surplus"), "left_anti")
