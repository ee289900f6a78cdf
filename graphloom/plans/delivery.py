"""Queries on delivered mail: exactly-once delivery and instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.exactdedup import first_deliveries, surplus_deliveries
from graphloom.operators.timestamps import delivery_instants
from graphloom.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return delivery_instants(table(spark, d, "mail_raw"), table(spark, d, "archive_site"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return surplus_deliveries(table(spark, d, "mail_raw"))


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    """The deliveries that stay, by batch."""
    return first_deliveries(table(spark, d, "mail_raw")).groupBy("batch_id").agg(F.count(F.lit(1)).alias("deliveries"), F.min("delivery_id").alias("first_delivery"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_kept": p3_kept}

_PARTS = r"regexp_extract({c}, '([^\s<>@]+)@([^\s<>@]+)', ['local', 'host'])"
_IDS = r"""
with raw as (
  select delivery_id, batch_id, coalesce(message_id, '') as m,
    url_decode(regexp_replace(regexp_extract(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '(?i)/message-id/(?:[^/]*/)*([^/]*(?:@|%40)[^/]*)', 1), '\+', '%2B', 'g')) as u from mail_raw),
parts as (select delivery_id, batch_id, {a} as a, {b} as b from raw),
ids as (select delivery_id, batch_id, case when a['local'] <> '' then a['local'] || '@' || lower(a['host']) when b['local'] <> '' then b['local'] || '@' || lower(b['host']) end as i from parts),
firsts as (select *, min(delivery_id) over (partition by i) as kept from ids)
""".format(a=_PARTS.format(c="m"), b=_PARTS.format(c="u"))
ORACLES = {
    "p3_found": _IDS + "select kept as kept_delivery_id, delivery_id as surplus_delivery_id from firsts where i is not null and delivery_id > kept",
    "p3_kept": _IDS + "select batch_id, count(*) as deliveries, min(delivery_id) as first_delivery from firsts where i is null or delivery_id = kept group by batch_id",
}
