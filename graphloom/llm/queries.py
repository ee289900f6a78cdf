"""Queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import conversations, defects, leakage, neardup, newtext, packing, pii, webspam
from graphloom.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(spark, table(spark, d, "mail_raw"), table(spark, d, "known_name"))


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.masked(spark, table(spark, d, "mail_raw"), table(spark, d, "known_name"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.alike_questions(spark, table(spark, d, "all_qa_merged"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per record: the class of records with the same words, and its links to other classes."""
    members, links = neardup.word_links(spark, table(spark, d, "all_qa_merged"))
    counted = neardup.class_links(members, links.where("jaccard >= 0.7 - 1e-12"))
    return counted.select(F.col("key").alias("qa_key"), F.col("class").alias("class_key"), "links")


def p4_shingles(spark: SparkSession, d: str) -> DataFrame:
    """The same over runs of five words, alike from a weighted similarity of 0.8."""
    return neardup.class_links(*neardup.similar_pairs(spark, table(spark, d, "all_qa_merged"), "qa_key", "question")).select(F.col("key").alias("qa_key"), F.col("class").alias("class_key"), "links")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "thread_message")).select("root_message_id", "turn_no", "message_id")


def p5_roles(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each conversation by role: how many, and the first."""
    turns = conversations.conversations(table(spark, d, "thread_message"))
    return turns.groupBy("root_message_id", "role").agg(F.count(F.lit(1)).alias("turns"), F.min("turn_no").alias("first_turn"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return newtext.new_lines(spark, table(spark, d, "thread_message"))


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    """The new text of every message, its lines in order."""
    mail = table(spark, d, "thread_message")
    lines = mail.select("msg_key", F.posexplode(F.split("body", "\n")).alias("p", "line")).withColumn("line_no", (F.col("p") + 1).cast("bigint"))
    kept = lines.join(newtext.new_lines(spark, mail), ["msg_key", "line_no"])
    ordered = kept.groupBy("msg_key").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("kept"))
    return ordered.select("msg_key", F.array_join(F.transform("kept", lambda x: x["line"]), "\n").alias("new_text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defective_pairs(table(spark, d, "ragas_dataset"))


def p8_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.windows(spark, table(spark, d, "documents"), table(spark, d, "context_window"))


def p8_unused(spark: SparkSession, d: str) -> DataFrame:
    """Windows and tokens by capacity."""
    placed = p8_windows(spark, d)
    return placed.groupBy("window_name").agg(F.countDistinct("window_no").alias("windows"), F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(spark, table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_paraphrased(spark: SparkSession, d: str) -> DataFrame:
    return leakage.paraphrased_items(spark, table(spark, d, "documents"), table(spark, d, "eval_item"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return webspam.spam_pages(spark, table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_masked, p4_found, p4_classes, p4_shingles, p5_found, p5_roles, p6_found, p6_text, p7_found, p8_windows, p8_unused, p9_found, p9_paraphrased, p10_found)
}

_FOLD = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_FOLD}, '[a-z0-9]+')"

_P4 = f"""
with w as (select qa_key, list_distinct({_WORDS.format(c='question')}) as ws from all_qa_merged where question is not null),
e as (select qa_key, len(ws) as n, unnest(ws) as t from w),
p as (select a.qa_key as qa_key_a, b.qa_key as qa_key_b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb
      from e a join e b on a.t = b.t and a.qa_key < b.qa_key group by 1, 2)
select qa_key_a, qa_key_b from p where c >= 0.7 * (na + nb - c)
"""

_P4_CLASSES = f"""
with w as (select qa_key, list_sort({_WORDS.format(c='question')}) as s from all_qa_merged where question is not null),
m as (select qa_key, s, min(qa_key) over (partition by s) as class_key from w where len(s) > 0),
c as (select distinct class_key, list_distinct(s) as ws from m where qa_key = class_key),
e as (select class_key, len(ws) as n, unnest(ws) as t from c),
p as (select a.class_key as a, b.class_key as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb
      from e a join e b on a.t = b.t and a.class_key <> b.class_key group by 1, 2),
l as (select a, count(*) as links from p where c >= 0.7 * (na + nb - c) group by 1)
select qa_key, class_key, coalesce(links, 0) as links from m left join l on l.a = m.class_key
"""

_BARE = "nullif(regexp_replace({c}, '[\\s<>]', '', 'g'), '')"
_TURNS = f"""
with recursive raw as (
  select {_BARE.format(c='message_id')} as id, {_BARE.format(c='parent_id')} as up, "date" as said, "from" as sender, body, msg_key from thread_message),
m as (select id, arg_min(coalesce(up, ''), msg_key) as up, arg_min(coalesce(said, ''), msg_key) as said,
             lower(regexp_extract(arg_min(coalesce(sender, ''), msg_key), '[^\\s<>()",;]+@[^\\s<>()",;]+')) as sender,
             arg_min(coalesce(trim(regexp_replace(body, '\\s', '', 'g')), ''), msg_key) = '' as blank
      from raw where id is not null group by id),
t as (select id, id as root from m where up = ''
      union all select m.id, t.root from m join t on m.up = t.id),
f as (select t.root, t.id, m.sender, m.blank, try_cast(nullif(regexp_replace(m.said, '([+-]\\d\\d)(\\d\\d)$', '\\1:\\2'), '') as timestamptz) as instant,
             r.sender as opener from t join m on m.id = t.id join m r on r.id = t.root),
k as (select root from f group by root having not bool_or(blank or instant is null) and bool_or(sender is distinct from opener)),
o as (select '<' || f.root || '>' as root_message_id, row_number() over (partition by f.root order by f.instant, f.id) as turn_no,
             '<' || f.id || '>' as message_id, case when f.sender = f.opener then 'opener' else 'responder' end as role
      from f join k on f.root = k.root)
"""

_P9 = f"""
with i as (select item_id, {_WORDS.format(c='text')} as ws from eval_item),
ig as (select distinct item_id, array_to_string(ws[k:k + 11], ' ') as g from (select item_id, ws, unnest(range(1, len(ws) - 10)) as k from i)),
d as (select doc_id, {_WORDS.format(c='text')} as ws from documents where text is not null),
dg as (select doc_id, array_to_string(ws[k:k + 11], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 10)) as k from d))
select distinct doc_id, item_id from dg join ig using (g)
"""

ORACLES: dict[str, str] = {
    "p4_found": _P4,
    "p4_classes": _P4_CLASSES,
    "p5_found": _TURNS + "select root_message_id, turn_no, message_id from o",
    "p5_roles": _TURNS + "select root_message_id, role, count(*) as turns, min(turn_no) as first_turn from o group by 1, 2",
    "p9_found": _P9,
}
