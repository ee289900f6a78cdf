"""Text functions, chunks, threads and question records of the corpus tables."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


def mail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "thread_message")


def qa(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_qa_merged")


_TOK = "list_filter(string_split_regex(lower({c}), '[^\\w]+'), lambda w: w <> '' and w not in (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ") and not regexp_full_match(w, '[0-9]+'))"


@query("select topic_key, tokens from (select cluster_id as topic_key, " + _TOK.format(c="replace(label, '_', ' ') || ' for the 64 new WAL'") + " as tokens from topic_cluster)")
def fn_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_cluster").select(F.col("cluster_id").alias("topic_key"), T.tokenize(F.concat(F.regexp_replace("label", "_", " "), F.lit(" for the 64 new WAL"))).alias("tokens"))


@query("select name_part, strip_accents(lower(name_part)) as folded from known_name")
def fn_normalise(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower())

    return table(spark, d, "known_name").select("name_part", fold("name_part").alias("folded"))


@query("select qa_key, (select sum(case when list_contains(w, t) then 1.0 when len(list_filter(w, lambda x: contains(x, t))) > 0 then 0.5 else 0.0 end) / 2 from (select unnest(['buffer', 'lock']) as t)) as score from (select qa_key, " + _TOK.format(c="question") + " as w from all_qa_merged)")
def fn_score_text(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).select("qa_key", T.score_text(F.col("question"), ["buffer", "lock"]).alias("score"))


@query("select qa_key, f, (case when list_contains(string_split_regex(lower(f), '[/\\\\.]'), 'storage') then 1.0 when contains(lower(f), 'storage') then 0.35 else 0.0 end + case when list_contains(string_split_regex(lower(f), '[/\\\\.]'), 'buf') then 1.0 when contains(lower(f), 'buf') then 0.35 else 0.0 end) / 2 as score from (select qa_key, unnest(source_files) as f from all_qa_merged)")
def fn_score_path(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).select("qa_key", F.explode("source_files").alias("f")).select("qa_key", "f", T.score_path(F.col("f"), ["storage", "buf"]).alias("score"))


@query("select p_partkey, coalesce(list_avg(list_filter([p_size % 3 / 2.0, p_size % 5 / 4.0, 0.0], lambda s: s <> 0)), 0) as score from part")
def fn_combine_scores(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.combine_scores(F.col("p_size") % 3 / 2.0, F.col("p_size") % 5 / 4.0, F.lit(0.0)).alias("score"))


@query("select msg_key, coalesce(nullif(trim(regexp_replace(lower(subject), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'feature') as slug from thread_message where subject is not null")
def fn_slug(spark: SparkSession, d: str) -> DataFrame:
    return mail(spark, d).where("subject is not null").select("msg_key", T.slug(F.col("subject")).alias("slug"))


@query("select msg_key, trim(regexp_replace(regexp_replace(regexp_replace(subject, '(?i)^\\s*(?:re|fwd|fw):\\s*', ''), '(?i)\\[hackers\\]', '', 'g'), '\\s+', ' ', 'g')) as subject from thread_message")
def fn_normalize_subject(spark: SparkSession, d: str) -> DataFrame:
    return mail(spark, d).select("msg_key", T.normalize_subject(F.col("subject")).alias("subject"))


@query("with l as (select msg_key, string_split(body, chr(10)) as ls from thread_message where body is not null), c as (select msg_key, ls, list_position(list_transform(ls, lambda x: trim(x, ' ')), '--') as p from l), k as (select msg_key, list_filter(case when p > 0 then ls[1:p - 1] else ls end, lambda x: not starts_with(ltrim(x, ' '), '>') and not regexp_matches(x, '^On .*wrote:\\s*$')) as ks from c) select msg_key, md5(trim(regexp_replace(array_to_string(ks, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ')) as cleaned from k")
def fn_clean_body(spark: SparkSession, d: str) -> DataFrame:
    return mail(spark, d).where("body is not null").select("msg_key", F.md5(T.clean_body(F.col("body"))).alias("cleaned"))


@query("select msg_key, coalesce(nullif(regexp_extract(\"from\", '<(.+?)>', 1), ''), trim(\"from\")) as address from thread_message")
def fn_email_address(spark: SparkSession, d: str) -> DataFrame:
    return mail(spark, d).select("msg_key", T.email_address(F.col("from")).alias("address"))


@query("select doc_id, length(text) // 4 as tokens from documents where text is not null")
def fn_estimate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("select qa_key, case when length(question) > 100 then substr(question, 1, 85) || '... [truncated]' else question end as short from all_qa_merged")
def fn_truncate(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).select("qa_key", T.truncate(F.col("question"), 100).alias("short"))


@query("select event_id, case when s < 60 then s || 's' when s < 3600 then s // 60 || 'm ' || s % 60 || 's' else s // 3600 || 'h ' || s % 3600 // 60 || 'm' end as took from (select event_id, cast(floor(value * 25) as bigint) as s from events)")
def fn_format_duration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.format_duration(F.col("value") * 25).alias("took"))


@query("select qa_key, f, case when list_contains(p, 'backend') then p[list_position(p, 'backend') + 1] when list_contains(p, 'include') then p[list_position(p, 'include') + 1] else 'unknown' end as component from (select qa_key, f, string_split(f, '/') as p from (select qa_key, unnest(source_files) as f from all_qa_merged))")
def fn_component_from_path(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).select("qa_key", F.explode("source_files").alias("f")).select("qa_key", "f", T.component_from_path(F.col("f")).alias("component"))


@query("select qa_key, f, list_filter(string_split(regexp_replace(lower(f), '\\.\\w+$', ''), '/'), lambda p: p not in ('src', 'backend', 'include', 'frontend', '')) as keywords from (select qa_key, unnest(source_files) as f from all_qa_merged)")
def fn_path_keywords(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).select("qa_key", F.explode("source_files").alias("f")).select("qa_key", "f", T.path_keywords(F.col("f")).alias("keywords"))


@query("select msg_key, trim(regexp_replace(regexp_replace(subject, '[<>:\"/\\\\|?*\\s]', '_', 'g'), '_+', '_', 'g'), '_') as filename from thread_message")
def fn_safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return mail(spark, d).select("msg_key", T.safe_filename(F.col("subject")).alias("filename"))


@query("select qa_key, len(list_filter(string_split_regex(regexp_replace(answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')) as sentences from all_qa_merged where answer is not null")
def fn_split_sentences(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).where("answer is not null").select("qa_key", F.size(T.split_sentences(F.col("answer"))).alias("sentences"))


@query("select doc_id, len(string_split_regex(text, '\\n\\s*\\n')) as paragraphs from documents where text is not null")
def fn_split_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.size(T.split_paragraphs(F.col("text"))).alias("paragraphs"))


@query("select qa_key, list_sort(list_distinct(regexp_extract_all(question, '\\b([a-z]+(?:_[a-z0-9]+)+)\\b', 1) || regexp_extract_all(question, '\\b((?:[A-Z][a-z0-9]+){2,})\\b', 1))) as functions from all_qa_merged where question is not null")
def fn_extract_functions(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).where("question is not null").select("qa_key", T.extract_functions(F.col("question")).alias("functions"))


@query("select qa_key, list_sort(list_distinct(regexp_extract_all(question, '([\\w/]+\\.[ch])\\b', 1))) as files from all_qa_merged where question is not null")
def fn_extract_files(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).where("question is not null").select("qa_key", T.extract_files(F.col("question")).alias("files"))


@query("select ragas_key, coalesce(nullif(regexp_extract(ground_truth, '^(cpg\\..*)$', 1), ''), 'cpg.method.name.l') as query from ragas_dataset")
def extract_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ragas_dataset").select("ragas_key", T.extract_query(F.col("ground_truth")).alias("query"))


@query("select ragas_key, list_filter([case when not contains(g, 'cpg.') then 'no-root' end, case when not regexp_matches(g, '\\.(l|toList|size|head)$') then 'no-terminator' end, case when regexp_matches(g, '(?i)delete|drop|remove|clear') then 'forbidden' end, case when len(regexp_replace(g, '[^(]', '', 'g')) <> len(regexp_replace(g, '[^)]', '', 'g')) then 'parentheses' end, case when len(regexp_replace(g, '[^\"]', '', 'g')) % 2 <> 0 then 'quotes' end, case when contains(g, '..') then 'double-dot' end], lambda x: x is not null) as issues from (select ragas_key, coalesce(ground_truth, answer) as g from ragas_dataset) where g is not null")
def validate_workflow(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "ragas_dataset").select("ragas_key", F.coalesce("ground_truth", "answer").alias("g")).where("g is not null")
    return g.select("ragas_key", T.query_issues(F.col("g")).alias("issues"))


# What the reference's validator rejects (rag_cpgql/src/execution/query_validator.py).
_DANGEROUS = ["system", "exec", "runtime", "import", "os.", "subprocess", "file.write", "file.delete", "process.", "__import__", "eval", "compile"]


@query("select ragas_key, coalesce(starts_with(ltrim(lower(ground_truth)), 'cpg') and not (" + " or ".join(f"contains(lower(ground_truth), '{p}')" for p in _DANGEROUS) + "), false) as safe from ragas_dataset")
def validate_safe(spark: SparkSession, d: str) -> DataFrame:
    """Begins with the graph's name and holds none of the reference's patterns, in whatever case."""
    g = F.lower("ground_truth")
    dangerous = reduce(or_, (g.contains(p) for p in _DANGEROUS))
    return table(spark, d, "ragas_dataset").select("ragas_key", F.coalesce(g.rlike(r"(?U)^[\s\x1c-\x1f]*cpg") & ~dangerous, F.lit(False)).alias("safe"))


@query("select ragas_key, p as precision, r as recall, case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end as f1 from (select ragas_key, case when len(a) = 0 and len(q) = 0 then 1.0 when len(a) = 0 then 0.0 else len(list_intersect(a, q)) / len(a) end as p, case when len(a) = 0 and len(q) = 0 then 1.0 when len(q) = 0 then 0.0 else len(list_intersect(a, q)) / len(q) end as r from (select ragas_key, list_distinct(regexp_extract_all(answer, '\\b([a-z]+(?:_[a-z0-9]+)+)\\b', 1) || regexp_extract_all(answer, '\\b((?:[A-Z][a-z0-9]+){2,})\\b', 1)) as a, list_distinct(regexp_extract_all(question, '\\b([a-z]+(?:_[a-z0-9]+)+)\\b', 1) || regexp_extract_all(question, '\\b((?:[A-Z][a-z0-9]+){2,})\\b', 1)) as q from ragas_dataset where answer is not null and question is not null))")
def entity_prf(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ragas_dataset").where("answer is not null and question is not null").select("ragas_key", T.extract_functions(F.col("answer")).alias("a"), T.extract_functions(F.col("question")).alias("q"))
    p, r, f1 = T.entity_prf(F.col("a"), F.col("q"))
    return rows.select("ragas_key", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


# ---- records and chunks


@query("select qa_key, coalesce(question, '') as question, lower(coalesce(difficulty, 'intermediate')) as difficulty, coalesce(len(topics), 0) as topics, coalesce(cluster_id, -1) as cluster_id, case when lower(replace(source_dataset, '-', '_')) = 'pg_books' then 'pg_books' when source_dataset is null then 'unknown' else lower(source_dataset) end as source_dataset from all_qa_merged")
def project_normalise(spark: SparkSession, d: str) -> DataFrame:
    source = F.coalesce(F.regexp_replace(F.lower("source_dataset"), "-", "_"), F.lit("unknown"))
    return qa(spark, d).select("qa_key", F.coalesce("question", F.lit("")).alias("question"), F.lower(F.coalesce("difficulty", F.lit("intermediate"))).alias("difficulty"), F.coalesce(F.size("topics"), F.lit(0)).alias("topics"), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), source.alias("source_dataset"))


@query("select qa_key, list_filter([case when coalesce(trim(question), '') = '' then 'question' end, case when coalesce(trim(answer), '') = '' then 'answer' end, case when source_dataset is null then 'source_dataset' end, case when not contains(coalesce(question, ''), '?') then 'warn-no-question-mark' end], lambda x: x is not null) as missing from all_qa_merged")
def filter_required_fields(spark: SparkSession, d: str) -> DataFrame:
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    issues = F.array(F.when(empty("question"), "question"), F.when(empty("answer"), "answer"), F.when(F.col("source_dataset").isNull(), "source_dataset"), F.when(~F.coalesce("question", F.lit("")).contains("?"), "warn-no-question-mark"))
    return qa(spark, d).select("qa_key", F.array_compact(issues).alias("missing"))


@query("select doc_id from documents where length(text) >= 50")
def filter_min_length(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where(F.length("text") >= 50).select("doc_id")


@query("select doc_id, k as chunk_no, md5(array_to_string(ws[k * 40 + 1:k * 40 + 50], ' ')) as chunk from (select doc_id, ws, unnest(range(0, greatest(1, (len(ws) + 39) // 40))) as k from (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as ws from documents where text is not null) where len(ws) > 0)")
def chunk_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 50 words every 40."""
    return docs(spark, d).select("doc_id", F.posexplode(T.sliding_windows(F.col("text"), 50, 40)).alias("chunk_no", "c")).select("doc_id", "chunk_no", F.md5("c").alias("chunk"))


@query()
def chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs packed greedily to 1000 estimated tokens: a fold over pieces inside one row. A longer
    paragraph closes the open chunk and is packed by sentences, the last of its chunks going on with the
    next paragraph; only a single sentence above the limit makes a longer chunk. A text without
    paragraphs is one chunk."""
    tokens, limit = T.estimate_tokens, 1000
    piece = lambda text, sep, fresh: F.struct(text.alias("text"), F.lit(sep).alias("sep"), fresh.alias("fresh"))
    paragraphs = F.filter(F.transform(T.split_paragraphs(F.col("text")), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    pieces = F.flatten(
        F.transform(paragraphs, lambda p: F.when(tokens(p) > limit, F.transform(T.split_sentences(p), lambda s, k: piece(s, " ", k == 0))).otherwise(F.array(piece(p, "\n\n", F.lit(False)))))
    )
    state = lambda done, open_, sep: F.struct(done.alias("done"), open_.alias("open"), sep.alias("sep"))
    join = lambda acc, p: F.concat(acc["open"], acc["sep"], p["text"])
    fold = F.aggregate(
        pieces, state(F.array().cast("array<string>"), F.lit(""), F.lit("")),
        lambda acc, p: F.when((acc["open"] != "") & (p["fresh"] | (tokens(join(acc, p)) > limit)), state(F.array_append(acc["done"], acc["open"]), p["text"], p["sep"])).otherwise(state(acc["done"], join(acc, p), p["sep"])),
        lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(F.array(F.col("text"))),
    )
    return docs(spark, d).select("doc_id", F.posexplode(fold).alias("chunk_no", "chunk")).select("doc_id", "chunk_no", F.length("chunk").alias("chars"))


@query("select source_type, count(*) as chunks, sum(t)::bigint as tokens, min(t) as least, max(t) as most, count(distinct coalesce(chapter, 'Unknown')) as chapters from (select source_type, chapter, length(coalesce(text, '')) // 4 as t from documents) group by 1")
def agg_chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("source_type", "chapter", T.estimate_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.groupBy("source_type").agg(F.count(F.lit(1)).alias("chunks"), F.sum("t").alias("tokens"), F.min("t").alias("least"), F.max("t").alias("most"), F.countDistinct(F.coalesce("chapter", F.lit("Unknown"))).alias("chapters"))


@query("select count(*) filter (where t >= 400) as long_chunks, count(*) filter (where t >= 150 and t < 400) as medium, count(*) filter (where t >= 50 and t < 150) as short, count(*) filter (where t < 50) as skipped, 2 * count(*) filter (where t >= 400) + count(*) filter (where t >= 50 and t < 400) as pairs from (select length(coalesce(text, '')) // 4 as t from documents)")
def agg_chunk_bands(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(T.estimate_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    n = lambda c: F.count_if(F.expr(c))
    return t.agg(n("t >= 400").alias("long_chunks"), n("t >= 150 and t < 400").alias("medium"), n("t >= 50 and t < 150").alias("short"), n("t < 50").alias("skipped"), (2 * n("t >= 400") + n("t >= 50 and t < 400")).alias("pairs"))


@query("select doc_id, case when t >= 400 then 2 when t >= 50 then 1 else 0 end as pairs from (select doc_id, length(coalesce(text, '')) // 4 as t from documents)")
def fn_determine_qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    t = T.estimate_tokens(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.when(t >= 400, 2).when(t >= 50, 1).otherwise(0).alias("pairs"))


@query("with n as (select coalesce(difficulty, 'unknown') as difficulty, length(question) as l from all_qa_merged where question is not null), r as (select difficulty, l, row_number() over (partition by difficulty order by l) as i, count(*) over (partition by difficulty) as c from n) select difficulty, count(*) as records, min(l) as least, max(l) as most, max(case when i = c // 2 + 1 then l end) as median from r group by 1")
def agg_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    """With the upper median: the value at position n div 2 of the sorted lengths, from 0. Counts by
    length are ranked, not the records, so a group of any size stays small."""
    n = qa(spark, d).where("question is not null").select(F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"), F.length("question").alias("l"))
    counts = n.groupBy("difficulty", "l").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("difficulty").orderBy("l")
    upto = counts.withColumns({"upto": F.sum("c").over(w), "all": F.sum("c").over(Window.partitionBy("difficulty"))})
    hit = (F.col("upto") > F.floor(F.col("all") / 2)) & (F.col("upto") - F.col("c") <= F.floor(F.col("all") / 2))
    return upto.groupBy("difficulty").agg(F.sum("c").alias("records"), F.min("l").alias("least"), F.max("l").alias("most"), F.max(F.when(hit, F.col("l"))).alias("median"))


@query("select topic, count(*) as n from (select unnest(topics) as topic from all_qa_merged) group by 1 order by 2 desc, 1 limit 20")
def topk_topics(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic").limit(20)


@query("select cluster_id, label, array_to_string(keywords[1:3], '_') as short_label from topic_cluster")
def fn_cluster_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_cluster").select("cluster_id", "label", F.array_join(F.slice("keywords", 1, 3), "_").alias("short_label"))


@query("select q.qa_key, coalesce(c.label, '{}') as mapped from all_qa_merged q left join topic_cluster c on c.cluster_id = q.cluster_id")
def join_cluster_mapping(spark: SparkSession, d: str) -> DataFrame:
    clusters = table(spark, d, "topic_cluster").select("cluster_id", "label")
    return qa(spark, d).select("qa_key", "cluster_id").join(clusters, "cluster_id", "left").select("qa_key", F.coalesce("label", F.lit("{}")).alias("mapped"))


_SPLIT = "select qa_key, case when row_number() over (order by md5(qa_key || ':42'), qa_key) <= floor(0.85 * count(*) over ()) then 'train' else 'test' end as part from all_qa_merged"


@query(_SPLIT)
def split_seeded(spark: SparkSession, d: str) -> DataFrame:
    """An exact 85 % split in hash order. The border is found by bisection over counts of the leading
    hash digits, so no task ever sorts all records."""
    return seeded_split(qa(spark, d).select("qa_key"), "qa_key", 0.85, 42)


def seeded_split(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    h = df.withColumn("_h", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))))
    # counts by the first four hex digits: at most 65536 rows, whatever the input
    buckets = h.groupBy(F.substring("_h", 1, 4).alias("_b")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = buckets.agg(F.sum("_c"))
    before = buckets.select("_b", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"))
    ranked = h.join(before, F.substring("_h", 1, 4) == F.col("_b"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return ranked.select(key, F.when(rank <= F.floor(F.lit(share) * total.scalar()), "train").otherwise("test").alias("part"))


@query(f"with s as ({_SPLIT}) select part, coalesce(lower(difficulty), 'unknown') as difficulty, count(*) as n from s join all_qa_merged using (qa_key) group by 1, 2")
def agg_split_report(spark: SparkSession, d: str) -> DataFrame:
    parts = split_seeded(spark, d).join(qa(spark, d).select("qa_key", "difficulty"), "qa_key")
    return parts.groupBy("part", F.coalesce(F.lower("difficulty"), F.lit("unknown")).alias("difficulty")).agg(F.count(F.lit(1)).alias("n"))


@query("select qa_key from all_qa_merged order by md5(qa_key || ':42'), qa_key limit 200")
def sample_questions(spark: SparkSession, d: str) -> DataFrame:
    """Two hundred questions by seeded hash order: a sampling operator."""
    return qa(spark, d).select("qa_key").orderBy(F.md5(F.concat(F.col("qa_key").cast("string"), F.lit(":42"))), "qa_key").limit(200)


@query("select id, kind, chars from (select 'q' || qa_key as id, 'qa' as kind, length(coalesce(question, '')) as chars from all_qa_merged union all select 'd' || doc_id, 'chunk', length(coalesce(text, '')) from documents)")
def set_union_datasets(spark: SparkSession, d: str) -> DataFrame:
    a = qa(spark, d).select(F.concat(F.lit("q"), F.col("qa_key").cast("string")).alias("id"), F.lit("qa").alias("kind"), F.length(F.coalesce("question", F.lit(""))).alias("chars"))
    b = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.lit("chunk").alias("kind"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    return a.unionByName(b)


@query("select qa_key from all_qa_merged where qa_key not in (select qa_key from ragas_dataset where qa_key is not null)")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).select("qa_key").join(table(spark, d, "ragas_dataset").select("qa_key"), "qa_key", "left_anti")


@query("select distinct cluster_id from all_qa_merged intersect select cluster_id from topic_cluster")
def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).select("cluster_id").intersect(table(spark, d, "topic_cluster").select("cluster_id"))


@query("select qa_key, array_to_string(list_transform(range(1, 4), lambda i: topics[i]), '|') as first_topics from all_qa_merged where len(topics) >= 3")
def win_topn_of_array(spark: SparkSession, d: str) -> DataFrame:
    return qa(spark, d).where(F.size("topics") >= 3).select("qa_key", F.array_join(F.slice("topics", 1, 3), "|").alias("first_topics"))


@query("select strftime(m, '%Y-%m') as month from (select unnest(generate_series(date '2021-01-01', date '2024-12-01', interval 1 month)) as m)")
def gen_range(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr("sequence(date'2021-01-01', date'2024-12-01', interval 1 month)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))
