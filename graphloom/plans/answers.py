"""Generated traversals and answers as text, feature names, threads as text, and reports over runs and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import rules as R
from graphloom.functions import text as T
from graphloom.operators.threads import roots
from graphloom.plans.code_graph import of
from graphloom.plans.retrieval import _THREADS
from graphloom.session import table
from graphloom.sources.standin import SQL, graph

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, on_graph: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (SQL if on_graph else "") + sql
        return f

    return add


def ragas(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ragas_dataset")


_STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_ENDS = "'.l', '.toList', '.head', '.size', '.count'"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# ---- generated traversals


def cleaned_query(c: Column) -> Column:
    """Blanks around dots and brackets, empty brackets, unfinished calls and unclosed tails go; a terminator is added."""
    q = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s*\.\s*", "."), r"\s*\(\s*", "("), r"\s*\)\s*", ")"))
    q = F.regexp_replace(F.regexp_replace(F.regexp_replace(q, r'\.name\("[^"]*$', ""), r"\.language\([^)]*$", ""), r"\(\)", "")
    opened, closed = F.length(F.regexp_replace(q, r"[^(]", "")), F.length(F.regexp_replace(q, r"[^)]", ""))
    q = F.when(opened > closed, F.regexp_extract(q, r"(?s)^(.*)\(", 1)).otherwise(q)
    q = F.when(q.rlike(r"\.(?:l|toList|head|size|count)$"), q).otherwise(F.concat(q, F.lit(".l")))
    return F.regexp_replace(F.regexp_replace(q, r"\.+l$", ".l"), r"\.+toList$", ".toList")


_CLEAN = f"""c1 as (select ragas_key, regexp_replace(regexp_replace(regexp_replace({_STRIP.format(c="regexp_replace(regexp_replace(regexp_replace(g, '\\s*\\.\\s*', '.', 'g'), '\\s*\\(\\s*', '(', 'g'), '\\s*\\)\\s*', ')', 'g')")}, '\\.name\\("[^"]*$', '', 'g'), '\\.language\\([^)]*$', '', 'g'), '\\(\\)', '', 'g') as q from r),
c2 as (select ragas_key, case when len(regexp_replace(q, '[^(]', '', 'g')) > len(regexp_replace(q, '[^)]', '', 'g')) then regexp_extract(q, '(?s)^(.*)\\(', 1) else q end as q from c1),
c3 as (select ragas_key, regexp_replace(regexp_replace(case when regexp_matches(q, '\\.(?:l|toList|head|size|count)$') then q else q || '.l' end, '\\.+l$', '.l'), '\\.+toList$', '.toList') as q from c2)"""
_RAW = "with r as (select ragas_key, coalesce(ground_truth, answer) as g from ragas_dataset where coalesce(ground_truth, answer) is not null), "


def raw(spark: SparkSession, d: str) -> DataFrame:
    return ragas(spark, d).select("ragas_key", F.coalesce("ground_truth", "answer").alias("g")).where("g is not null")


@query(_RAW + _CLEAN + " select ragas_key, md5(q) as query from c3")
def cleanup_query(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("ragas_key", F.md5(cleaned_query(F.col("g"))).alias("query"))


_BASIC = "case when not starts_with(q, 'cpg') then 'start' when not regexp_matches(q, '\\.(?:l|toList|head|size|count)$') then 'end' when len(regexp_replace(q, '[^(]', '', 'g')) <> len(regexp_replace(q, '[^)]', '', 'g')) then 'parentheses' when len(regexp_replace(q, '[^\"]', '', 'g')) % 2 <> 0 then 'quotes' else 'valid' end"


def basic_issue(q: Column) -> Column:
    """The first thing that keeps a traversal from being run, else valid."""
    n = lambda sign: F.length(F.regexp_replace(q, f"[^{sign}]", ""))
    return F.when(~q.startswith("cpg"), "start").when(~q.rlike(r"\.(?:l|toList|head|size|count)$"), "end").when(n("(") != n(")"), "parentheses").when(n('"') % 2 != 0, "quotes").otherwise("valid")


@query(_RAW + _CLEAN + f" select ragas_key, {_BASIC} as issue from c3")
def validate_basic(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d).select("ragas_key", basic_issue(cleaned_query(F.col("g"))).alias("issue"))


@query(_RAW + _CLEAN + f", o as (select ragas_key, {_BASIC.replace('q', 'g').replace('gotes', 'quotes')} as a from r), n as (select ragas_key, length(q) as l, len(regexp_replace(q, '[^.]', '', 'g')) as dots, {_BASIC} as b from c3) select count(*) as queries, count(*) filter (where a = 'valid') as valid_raw, count(*) filter (where b = 'valid') as valid_cleaned, count(*) filter (where dots <= 3) as simple, round(avg(l), 6) as mean_length, max(l) as most from o join n using (ragas_key)")
def query_shape_stats(spark: SparkSession, d: str) -> DataFrame:
    """Validity before and after cleaning, and shape."""
    q = raw(spark, d).select(basic_issue(F.col("g")).alias("a"), cleaned_query(F.col("g")).alias("q"))
    q = q.select("a", basic_issue(F.col("q")).alias("b"), F.length("q").alias("l"), F.length(F.regexp_replace("q", "[^.]", "")).alias("dots"))
    return q.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("a") == "valid").alias("valid_raw"), F.count_if(F.col("b") == "valid").alias("valid_cleaned"), F.count_if(F.col("dots") <= 3).alias("simple"), F.round(F.avg("l"), 6).alias("mean_length"), F.max("l").alias("most"))


# ---- results and answers

# What an empty result looks like.
EMPTY = ["", "[]", "{}", "List()", "Set()", "null", "None"]
_EMPTY_SQL = "(s is null or s in (" + ", ".join(f"'{x}'" for x in EMPTY) + ") or starts_with(s, 'List()') or starts_with(s, 'Set()'))"
#: Results as a graph server would print them, made from the functions a text names.
_RESULTS = f"with f as (select ragas_key, answer, list_sort(list_distinct(regexp_extract_all(answer, '\\b([a-z]+(?:_[a-z0-9]+)+)\\b', 1) || regexp_extract_all(answer, '\\b((?:[A-Z][a-z0-9]+){{2,}})\\b', 1))) as fs from ragas_dataset), r as (select ragas_key, case ragas_key % 4 when 0 then answer when 1 then 'List(' || array_to_string(fs, ', ') || ')' when 2 then '[' || array_to_string(list_transform(fs, lambda x: '\"' || x || '\"'), ', ') || ']' else array_to_string(fs, ',') end as s from f), s as (select ragas_key, {_STRIP.format(c='s')} as s from r)"


def results(spark: SparkSession, d: str) -> DataFrame:
    fs, k = T.extract_functions(F.col("answer")), F.col("ragas_key") % 4
    s = F.when(k == 0, F.col("answer")).when(k == 1, F.concat(F.lit("List("), F.array_join(fs, ", "), F.lit(")"))).when(k == 2, F.concat(F.lit("["), F.array_join(F.transform(fs, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))).otherwise(F.array_join(fs, ","))
    return ragas(spark, d).select("ragas_key", strip(s).alias("s"))


def is_empty(s: Column) -> Column:
    return s.isNull() | s.isin(EMPTY) | s.startswith("List()") | s.startswith("Set()")


@query(_RESULTS + f" select ragas_key, {_EMPTY_SQL} as empty from s")
def is_empty_result(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("ragas_key", is_empty(F.col("s")).alias("empty"))


def result_list(s: Column) -> Column:
    """Names of ``List(a, b)``, of a JSON array, or between commas; other text is no list."""
    inner = F.regexp_extract(s, r"(?s)List\((.*)\)", 1)
    split = lambda c: F.transform(F.split(c, ","), lambda x: strip(x))
    names = F.when(s.rlike(r"(?s)List\(.*\)"), split(inner)).when(s.startswith("["), F.coalesce(F.from_json(s, "array<string>"), F.when(s.contains(","), split(s)))).when(s.contains(","), split(s))
    return F.filter(F.coalesce(names, R.strings([])), lambda x: ~x.isin("", "null", "None"))


_LIST_SQL = f"list_filter(coalesce(case when regexp_matches(s, '(?s)List\\(.*\\)') then list_transform(string_split(regexp_extract(s, '(?s)List\\((.*)\\)', 1), ','), lambda x: {_STRIP.format(c='x')}) when starts_with(s, '[') then coalesce(try_cast(try_cast(s as json) as varchar[]), case when contains(s, ',') then list_transform(string_split(s, ','), lambda x: {_STRIP.format(c='x')}) end) when contains(s, ',') then list_transform(string_split(s, ','), lambda x: {_STRIP.format(c='x')}) end, []), lambda x: x not in ('', 'null', 'None'))"


@query(_RESULTS + f" select ragas_key, md5(array_to_string({_LIST_SQL}, '|')) as names, len({_LIST_SQL}) as n from s")
def parse_result_list(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d).select("ragas_key", result_list(F.col("s")).alias("fs")).select("ragas_key", F.coalesce("fs", R.strings([])).alias("fs"))
    return r.select("ragas_key", F.md5(F.array_join("fs", "|")).alias("names"), F.size("fs").alias("n"))


_KIND = f"case when ragas_key % 11 = 0 then 'error' when {_EMPTY_SQL} then 'empty' when len({_LIST_SQL}) = 0 then 'raw' else 'list' end"


@query(_RESULTS + f" select ragas_key, {_KIND} as kind, case when {_KIND} = 'raw' then length(case when length(s) > 1000 then s[1:1000] || '(truncated)' else s end) end as shown from s")
def interpret_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """What an answer is made of: an error, nothing, raw text (shown to 1,000 characters), or a list of names."""
    s = F.col("s")
    kind = F.when(F.col("ragas_key") % 11 == 0, "error").when(is_empty(s), "empty").when(F.size(result_list(s)) == 0, "raw").otherwise("list")
    shown = F.length(F.when(F.length(s) > 1000, F.concat(F.substring(s, 1, 1000), F.lit("(truncated)"))).otherwise(s))
    return results(spark, d).select("ragas_key", kind.alias("kind"), F.when(kind == "raw", shown).alias("shown"))


@query(_RESULTS + f", l as (select ragas_key, {_LIST_SQL} as fs from s) select ragas_key, md5(case when len(fs) = 1 then 'Found 1 function.' else 'Found ' || len(fs) || ' functions.' end || array_to_string(list_transform(fs[1:15], lambda f: chr(10) || '  - ' || f), '') || case when len(fs) > 15 then chr(10) || '  ... and ' || (len(fs) - 15) || ' more' else '' end) as answer from l")
def answer_template(spark: SparkSession, d: str) -> DataFrame:
    """An answer by template: how many, the first fifteen names, how many more."""
    r = results(spark, d).select("ragas_key", F.coalesce(result_list(F.col("s")), R.strings([])).alias("fs"))
    n = F.size("fs")
    listed = F.array_join(F.transform(F.slice("fs", 1, 15), lambda f: F.concat(F.lit("\n  - "), f)), "")
    more = F.when(n > 15, F.concat(F.lit("\n  ... and "), (n - 15).cast("string"), F.lit(" more"))).otherwise("")
    return r.select("ragas_key", F.md5(F.concat(F.when(n == 1, "Found 1 function.").otherwise(F.concat(F.lit("Found "), n.cast("string"), F.lit(" functions."))), listed, more)).alias("answer"))


@query("select ragas_key, f as faithfulness, v as relevance, p as precision, round((f + v + p) / 3, 6) as mean from (select ragas_key, case when coalesce(length(answer), 0) > 50 then 0.9::double else 0.3 end as f, case when ground_truth is not null then 0.9::double * 0.8 else 0.5 end as v, least(len(coalesce(contexts, [])) / 5.0, 1.0) as p from ragas_dataset)")
def eval_heuristic(spark: SparkSession, d: str) -> DataFrame:
    """Scores of an answer without a judge: by length, truth at hand and contexts."""
    f, v = F.when(F.coalesce(F.length("answer"), F.lit(0)) > 50, 0.9).otherwise(0.3), F.when(F.col("ground_truth").isNotNull(), 0.9 * 0.8).otherwise(0.5)
    p = F.least(F.coalesce(F.size("contexts"), F.lit(0)) / 5.0, F.lit(1.0))
    r = ragas(spark, d).select("ragas_key", f.alias("faithfulness"), v.alias("relevance"), F.when(F.col("contexts").isNull(), 0.0).otherwise(p).alias("precision"))
    return r.withColumn("mean", F.round((F.col("faithfulness") + F.col("relevance") + F.col("precision")) / 3, 6))


@query("select qa_key, 'cpg.method.name(\".*' || k || '.*\").name.l' as query from (select qa_key, list_filter(list_transform(topics, lambda t: regexp_replace(t, '[^A-Za-z0-9_]', '', 'g')), lambda t: length(t) >= 3)[1] as k from all_qa_merged) where k is not null")
def keyword_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A traversal by the first keyword of three clean characters or more."""
    k = F.try_element_at(F.filter(F.transform("topics", lambda t: F.regexp_replace(t, "[^A-Za-z0-9_]", "")), lambda t: F.length(t) >= 3), F.lit(1))
    return table(spark, d, "all_qa_merged").select("qa_key", k.alias("k")).where("k is not null").select("qa_key", F.concat(F.lit('cpg.method.name(".*'), "k", F.lit('.*").name.l')).alias("query"))


# ---- names, comments and paths


@query("select doc_id, md5(case when length(x) > 200 then x[1:200] || '...' else x end) as example from (select doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '' and not starts_with(l, '//') and not starts_with(l, '/*')), ' ') as x from documents where text is not null)")
def fn_minimal_example(spark: SparkSession, d: str) -> DataFrame:
    """Code on one line without comments and blanks, cut at 200 characters."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("/*"))
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(lines, " ").alias("x"))
    return docs.select("doc_id", F.md5(F.when(F.length("x") > 200, F.concat(F.substring("x", 1, 200), F.lit("..."))).otherwise(F.col("x"))).alias("example"))


@query("select doc_id, md5(case when length(p) > 200 then string_split(p, '. ')[1] || '.' else p end) as description from (select doc_id, regexp_replace(string_split_regex(regexp_replace(regexp_replace(text, '/\\*+|\\*+/', '', 'g'), '(?m)^[ \\t]*\\*[ \\t]?', '', 'g'), '\\n\\s*\\n')[1], '^\\s+|\\s+$', '', 'g') as p from documents where text is not null)")
def fn_comment_description(spark: SparkSession, d: str) -> DataFrame:
    """First paragraph without comment marks; a long one only to its first sentence."""
    bare = F.regexp_replace(F.regexp_replace("text", r"/\*+|\*+/", ""), r"(?m)^[ \t]*\*[ \t]?", "")
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", strip(F.element_at(F.split(bare, r"\n\s*\n"), 1)).alias("p"))
    return docs.select("doc_id", F.md5(F.when(F.length("p") > 200, F.concat(F.element_at(F.split("p", r"\. "), 1), F.lit("."))).otherwise(F.col("p"))).alias("description"))


@query("select distinct f, regexp_replace(replace(lower('C:' || replace(f, '/', '\\')), '\\', '/'), '^[a-z]:', '') as path from (select unnest(source_files) as f from all_qa_merged)")
def fn_normalize_path(spark: SparkSession, d: str) -> DataFrame:
    """Slashes one way, no drive, lower case."""
    f = table(spark, d, "all_qa_merged").select(F.explode("source_files").alias("f")).distinct()
    windows = F.concat(F.lit("C:"), F.translate("f", "/", "\\"))
    return f.select("f", F.regexp_replace(F.translate(F.lower(windows), "\\", "/"), "^[a-z]:", "").alias("path"))


@query("select msg_key, trim(replace(replace(subject, chr(10), ' '), '|', '/')) as subject from thread_message where subject is not null")
def fn_sanitise_pipe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "thread_message").where("subject is not null").select("msg_key", F.trim(F.translate("subject", "\n|", " /")).alias("subject"))


@query("select cluster_id, name, category from (select cluster_id, label as name, keywords[1] as category from topic_cluster)")
def fn_parse_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Fields of quoted records that are joined by three bars; records of fewer than two fields are none."""
    line = F.concat(F.lit('"'), "label", F.lit("|||"), F.element_at("keywords", 1), F.lit('", "alone"'))
    parts = F.filter(F.transform(F.regexp_extract_all(line, F.lit('"([^"]*)"')), lambda x: F.split(x, r"\|\|\|")), lambda p: F.size(p) >= 2)
    return table(spark, d, "topic_cluster").select("cluster_id", F.explode(parts).alias("p")).select("cluster_id", F.col("p")[0].alias("name"), F.col("p")[1].alias("category"))


@query("select cluster_id, label as feature, thread_count as tagged from topic_cluster where cluster_id % 3 <> 0")
def fn_parse_prefix_lines(spark: SparkSession, d: str) -> DataFrame:
    """Typed rows of the marked lines in a printout; other lines and numbers that are none are passed over."""
    lines = F.array(F.lit("noise"), F.concat(F.lit("__COVERAGE__|"), "label", F.lit("|"), F.when(F.col("cluster_id") % 3 == 0, "many").otherwise(F.col("thread_count").cast("string"))))
    rows = table(spark, d, "topic_cluster").select("cluster_id", F.explode(F.split(F.array_join(lines, "\n"), "\n")).alias("x")).where(F.col("x").startswith("__COVERAGE__|"))
    p = F.split("x", r"\|")
    return rows.select("cluster_id", p[1].alias("feature"), p[2].try_cast("int").alias("tagged")).where("tagged is not null")


@query("select cluster_id, trim(regexp_replace(replace(label, '_', '  '), '\\s+', ' ', 'g')) as name from topic_cluster")
def fn_clean_feature_name(spark: SparkSession, d: str) -> DataFrame:
    """Without the footnote mark at its end, blanks collapsed."""
    name = F.concat(F.replace("label", F.lit("_"), F.lit("  ")), F.lit(" [3]"))
    return table(spark, d, "topic_cluster").select("cluster_id", F.trim(F.regexp_replace(F.regexp_replace(name, r"\[\d+\]\s*$", ""), r"\s+", " ")).alias("name"))


@query("select qa_key, list_transform(regexp_extract_all(answer, '\\b([A-Za-z0-9_]+)\\s*\\(', 1)[1:2], lambda x: x) as mentions from all_qa_merged where answer is not null")
def fn_code_mentions(spark: SparkSession, d: str) -> DataFrame:
    """The first two names before brackets."""
    return table(spark, d, "all_qa_merged").where("answer is not null").select("qa_key", F.slice(F.regexp_extract_all("answer", F.lit(r"\b([A-Za-z0-9_]+)\s*\(")), 1, 2).alias("mentions"))


# Synonyms of feature tokens and tokens of categories, sorted, as their order is open.
SYNONYMS = R.lists("""
    json: jsonb
    fts: textsearch, tsearch
    fts2: tsquery, tsvector
    scram: auth, authentication
    parallel: parallelism, worker
    merge: mergejoin
    logical: logicalreplication, wal_sender
    hash: hashagg, hashjoin
    wal: writeaheadlog, xlog
    backup: basebackup, pg_basebackup
    replication: logicalreplication, physical
    uuid: guid
    encryption: ssl, tls
    vacuum: maintenance
    fdw: data, foreign, wrapper
    monitoring: metrics, stat
    visibility: mvcc
    analytics: analysis
    planner: optimizer
""")
_FEATURE = "select cluster_id, list_distinct_ordered(string_split(label, '_')) as ts from topic_cluster"
_TOKENS_SQL = "list_filter(string_split_regex(lower(label), '[^a-z0-9]+'), lambda w: w <> '' and not regexp_full_match(w, '[0-9]+') and w not in (" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "))"


def feature_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_cluster").select("cluster_id", "label", T.tokenize(F.regexp_replace("label", "_", " ")).alias("ts"))


_ORDERED = "(select coalesce(list(x order by i), []::varchar[]) from (select x, min(i) as i from (select unnest({c}) as x, generate_subscripts({c}, 1) as i) group by 1))"


@query(f"with t as (select cluster_id, {_TOKENS_SQL} as ts from topic_cluster), u as (select cluster_id, ts || flatten(list_transform(ts, lambda k: {R.looked_up_sql('k', SYNONYMS)})) as every from t) select cluster_id, {_ORDERED.format(c='u.every')} as tokens from u")
def fn_expand_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens once each in order, then their synonyms."""
    more = F.flatten(F.transform("ts", lambda t: R.looked_up(t, SYNONYMS)))
    return feature_tokens(spark, d).select("cluster_id", F.array_distinct(F.concat("ts", more)).alias("tokens"))


@query(f"with t as (select cluster_id, {_TOKENS_SQL} as ts from topic_cluster) select t.cluster_id, qa_key from t join all_qa_merged on len(ts) > 0 and len(list_filter(ts, lambda k: not contains(lower(question), k))) = 0")
def fn_conjunctive_regex(spark: SparkSession, d: str) -> DataFrame:
    """Questions that hold all tokens of a topic, in any order and as parts of words: the few topics, one row each,
    travel to the questions as one array."""
    topics = feature_tokens(spark, d).where("size(ts) > 0").agg(F.collect_list(F.struct("cluster_id", "ts")))
    q = table(spark, d, "all_qa_merged").where("question is not null").select("qa_key", F.lower("question").alias("q"), topics.scalar().alias("topics"))
    hit = F.filter("topics", lambda t: F.forall(t["ts"], lambda k: F.contains(F.col("q"), k)))
    return q.select("qa_key", F.explode(hit).alias("t")).select("t.cluster_id", "qa_key")


@query(f"with t as (select cluster_id, {_TOKENS_SQL} as ts, keywords from topic_cluster), u as (select cluster_id, ts, {_ORDERED.format(c='t.keywords')} as ks from t) select cluster_id, ts || list_filter(ks, lambda k: not list_contains(ts, k))[1:8] as tokens from u")
def fn_feature_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the name, then up to eight new ones of the description (here: the keywords)."""
    t = table(spark, d, "topic_cluster").select("cluster_id", T.tokenize(F.regexp_replace("label", "_", " ")).alias("ts"), F.array_distinct("keywords").alias("ks"))
    return t.select("cluster_id", F.concat("ts", F.slice(F.filter("ks", lambda k: ~F.array_contains("ts", k)), 1, 8)).alias("tokens"))


@query("select qa_key from all_qa_merged where contains(lower(question), 'snapshot') or contains(lower(question), 'queue')")
def filter_any_all_tokens(spark: SparkSession, d: str) -> DataFrame:
    """One token must occur; of several any is enough."""
    q = F.lower("question")
    return table(spark, d, "all_qa_merged").where(F.exists(F.array(F.lit("snapshot"), F.lit("queue")), lambda t: F.contains(q, t))).select("qa_key")


@query(f"select qa_key, {_ORDERED.format(c='q.source_files')} as files from all_qa_merged q where source_files is not null")
def set_distinct_ordered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_qa_merged").where("source_files is not null").select("qa_key", F.array_distinct("source_files").alias("files"))


# ---- threads as text

_MSG = _THREADS + ", d as (select *, nullif(regexp_replace(message_id, '[\\s<>]', '', 'g'), '') as mid from thread_message), o as (select arg_min(struct_pack(f := \"from\", sent := coalesce(date, ''), b := coalesce(cleaned_body, ''), s := coalesce(subject, '')), msg_key) as m, mid from d where mid is not null group by mid), j as (select t.root, t.id, m.f as f, m.sent as sent, m.b as b, m.s as s from t join o on o.mid = t.id)"


def threaded(spark: SparkSession, d: str) -> DataFrame:
    mail = table(spark, d, "thread_message")
    bare = F.nullif(F.regexp_replace("message_id", r"[\s<>]", ""), F.lit(""))
    one = mail.select(bare.alias("id"), "msg_key", F.col("from").alias("f"), F.coalesce("date", F.lit("")).alias("sent"), F.coalesce("cleaned_body", F.lit("")).alias("b"), F.coalesce("subject", F.lit("")).alias("s")).where("id is not null")
    one = one.groupBy("id").agg(F.min_by(F.struct("f", "sent", "b", "s"), "msg_key").alias("m"))
    return roots(mail).join(one, "id").select("root", "id", "m.*")


@query(_MSG + " select root, count(*) as messages, min(nullif(sent, '')) as started, max(nullif(sent, '')) as ended, count(distinct f) as participants from j group by 1")
def thread_build(spark: SparkSession, d: str) -> DataFrame:
    """Threads with first and last date and the number of different senders."""
    sent = F.nullif("sent", F.lit(""))
    return threaded(spark, d).groupBy("root").agg(F.count(F.lit(1)).alias("messages"), F.min(sent).alias("started"), F.max(sent).alias("ended"), F.countDistinct("f").alias("participants"))


@query(_MSG + " select id, row_number() over (partition by root order by sent, id) as message_no from j")
def win_message_index(spark: SparkSession, d: str) -> DataFrame:
    """Place of each message in its thread by date."""
    return threaded(spark, d).select("id", F.row_number().over(Window.partitionBy("root").orderBy("sent", "id")).alias("message_no"))


_TEXT = ", n as (select *, row_number() over (partition by root order by sent, id) as i from j), x as (select root, string_agg('[Message ' || i || '] ' || b, chr(10) order by i) as content, min(nullif(sent, '')) as started, arg_min(s, i) as subject, count(*) as n from n group by 1)"


def thread_texts(spark: SparkSession, d: str) -> DataFrame:
    t = threaded(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("root").orderBy("sent", "id")))
    parts = F.array_sort(F.collect_list(F.struct("i", F.concat(F.lit("[Message "), F.col("i").cast("string"), F.lit("] "), "b").alias("x"))))
    return t.groupBy("root").agg(F.array_join(F.transform(parts, lambda p: p["x"]), "\n").alias("content"), F.min(F.nullif("sent", F.lit(""))).alias("started"), F.min_by("s", "i").alias("subject"), F.count(F.lit(1)).alias("n"))


@query(_MSG + _TEXT + " select root, md5(content) as content from x")
def thread_text(spark: SparkSession, d: str) -> DataFrame:
    """The messages of a thread as one numbered text."""
    return thread_texts(spark, d).select("root", F.md5("content").alias("content"))


_KEY_SQL = "replace(replace(lower(coalesce(started[1:10], '') || '-' || subject[1:50]), ' ', '-'), '/', '-')"


@query(_MSG + _TEXT + f" select root, {_KEY_SQL} as thread_key from x")
def fn_thread_key(spark: SparkSession, d: str) -> DataFrame:
    """Date and subject as a readable name; the root stays the key, as names may be equal."""
    key = F.translate(F.lower(F.concat(F.coalesce(F.substring("started", 1, 10), F.lit("")), F.lit("-"), F.substring("subject", 1, 50))), " /", "--")
    return thread_texts(spark, d).select("root", key.alias("thread_key"))


@query(_MSG + _TEXT + f" select root, {_KEY_SQL} as thread_key, n as messages, length(content) as chars from x where n >= 1")
def thread_parse(spark: SparkSession, d: str) -> DataFrame:
    t = thread_texts(spark, d)
    return fn_thread_key(spark, d).join(t.where("n >= 1").select("root", F.col("n").alias("messages"), F.length("content").alias("chars")), "root")


# ---- chunks and documents


@query("select doc_id, 'chunk_' || doc_id as label, case when t >= 400 then 2 else 1 end as pairs from (select doc_id, length(coalesce(text, '')) // 4 as t from documents) where t >= 50 and doc_id not in (select qa_key from all_qa_merged where cluster_id = -1)")
def pseudo_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk of size as its own cluster, without those done before (here: keys of unclustered records)."""
    done = table(spark, d, "all_qa_merged").where("cluster_id = -1").select(F.col("qa_key").alias("doc_id"))
    t = table(spark, d, "documents").select("doc_id", T.estimate_tokens(F.coalesce("text", F.lit(""))).alias("t")).where("t >= 50").join(done, "doc_id", "left_anti")
    return t.select("doc_id", F.concat(F.lit("chunk_"), F.col("doc_id").cast("string")).alias("label"), F.when(F.col("t") >= 400, 2).otherwise(1).alias("pairs"))


@query("select doc_id, case when source_type in ('book', 'pdf') then 'semantic' when source_type = 'web' then 'sliding' else 'whole' end as cut, case when file_path is not null then file_path || ':' || chunk_index when source_url is not null then source_url else source end as place from documents")
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    """How a text is cut by its kind, and where it is from."""
    cut = F.when(F.col("source_type").isin("book", "pdf"), "semantic").when(F.col("source_type") == "web", "sliding").otherwise("whole")
    place = F.coalesce(F.when(F.col("file_path").isNotNull(), F.concat("file_path", F.lit(":"), F.col("chunk_index").cast("string"))), F.col("source_url"), F.col("source"))
    return table(spark, d, "documents").select("doc_id", cut.alias("cut"), place.alias("place"))


@query("select qa_key, md5(array_to_string(list_filter(['Q: ' || question, 'A: ' || answer[1:500], case when len(topics) > 0 then 'Topics: ' || array_to_string(topics, ', ') end], lambda x: x is not null), chr(10))) as document from all_qa_merged")
def doc_text(spark: SparkSession, d: str) -> DataFrame:
    """What is indexed of a record: question, the first 500 characters of the answer, topics."""
    parts = F.array_compact(F.array(F.concat(F.lit("Q: "), "question"), F.concat(F.lit("A: "), F.substring("answer", 1, 500)), F.when(F.size("topics") > 0, F.concat(F.lit("Topics: "), F.array_join("topics", ", ")))))
    return table(spark, d, "all_qa_merged").select("qa_key", F.md5(F.array_join(parts, "\n")).alias("document"))


# ---- reports

_RUN = "with r as (select model_run, coalesce(answer, '') as a, ground_truth, coalesce(len(contexts), 0) as c, coalesce(ground_truth, '') like 'cpg.%' as valid from ragas_dataset)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return ragas(spark, d).select("model_run", F.coalesce("answer", F.lit("")).alias("a"), "ground_truth", F.when(F.col("contexts").isNull(), 0).otherwise(F.size("contexts")).alias("c"), F.coalesce("ground_truth", F.lit("")).startswith("cpg.").alias("valid"))


@query(_RUN + " select model_run, count(*) as n, round(avg(length(a) > 0)::double, 6) as answered, round(avg(c) filter (where length(a) > 0), 6) as mean_contexts from (select model_run, a, c, valid from r) group by 1".replace("avg(length(a) > 0)::double", "avg((length(a) > 0)::int)"))
def agg_workflow_summary(spark: SparkSession, d: str) -> DataFrame:
    """Share of successful rows, averages over these only."""
    good = F.length("a") > 0
    return runs(spark, d).groupBy("model_run").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(good.cast("int")), 6).alias("answered"), F.round(F.avg(F.when(good, F.col("c"))), 6).alias("mean_contexts"))


@query(_RUN + " select model_run as category, count(*) filter (where ground_truth is not null) as success, count(*) as total from r group by 1")
def agg_category_success(spark: SparkSession, d: str) -> DataFrame:
    return runs(spark, d).groupBy(F.col("model_run").alias("category")).agg(F.count("ground_truth").alias("success"), F.count(F.lit(1)).alias("total"))


@query(_RUN + " select round(avg(valid::int), 6) as valid_rate, round(avg((ground_truth is not null)::int), 6) as executed_rate, round(avg(c) filter (where ground_truth is not null), 6) as mean_similarity from r")
def agg_batch_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates over all rows; the mean over those that have it."""
    has = F.col("ground_truth").isNotNull()
    return runs(spark, d).agg(F.round(F.avg(F.col("valid").cast("int")), 6).alias("valid_rate"), F.round(F.avg(has.cast("int")), 6).alias("executed_rate"), F.round(F.avg(F.when(has, F.col("c"))), 6).alias("mean_similarity"))


@query(_RUN + " select model_run, min(c) as least, round(avg(c), 6) as mean, max(c) as most, count(*) filter (where c / 4.0 >= 0.75) as high, count(*) filter (where c / 4.0 < 0.25) as low, round(avg(contains(a, '_')::int), 6) as name_rate, round(avg(length(a)), 6) as mean_length from r group by 1")
def agg_rag_report(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval, coverage bands, use of names and length, by run."""
    c = F.col("c")
    return runs(spark, d).groupBy("model_run").agg(F.min("c").alias("least"), F.round(F.avg("c"), 6).alias("mean"), F.max("c").alias("most"), F.count_if(c / 4.0 >= 0.75).alias("high"), F.count_if(c / 4.0 < 0.25).alias("low"), F.round(F.avg(F.col("a").contains("_").cast("int")), 6).alias("name_rate"), F.round(F.avg(F.length("a")), 6).alias("mean_length"))


@query(_RUN + ", s as (select model_run, avg(length(a)) as score, avg((ground_truth is not null)::int) as success from r group by 1) select model_run, round(score, 6) as score, round(success, 6) as success, row_number() over (order by score desc, model_run) as place from s")
def model_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Runs by mean score (length stands in), best first; as many rows as there are runs."""
    s = runs(spark, d).groupBy("model_run").agg(F.avg(F.length("a")).alias("score"), F.avg(F.col("ground_truth").isNotNull().cast("int")).alias("success"))
    return s.select("model_run", F.round("score", 6).alias("score"), F.round("success", 6).alias("success"), F.row_number().over(Window.orderBy(F.desc("score"), "model_run")).alias("place"))


# ---- tags in use: events are uses of (type, user group) with a value as coverage

_USE = "with u as (select event_type as tag_name, 'g' || (user_id % 40) as tag_value, count(*) as uses, avg((value > 50)::int) as success, avg((value > 100)::int) as executed, avg(least(value / 500, 1)) as coverage from events group by 1, 2), e as (select *, case when uses < 3 then 0.5 else 0.5 * success + 0.3 * executed + 0.2 * coverage end as score from u)"


def tag_use(spark: SparkSession, d: str) -> DataFrame:
    """Uses, success, execution, coverage and score of each tag; fewer than three uses give the neutral 0.5."""
    v = F.col("value")
    u = table(spark, d, "events").groupBy(F.col("event_type").alias("tag_name"), F.concat(F.lit("g"), (F.col("user_id") % 40).cast("string")).alias("tag_value")).agg(F.count(F.lit(1)).alias("uses"), F.avg((v > 50).cast("int")).alias("success"), F.avg((v > 100).cast("int")).alias("executed"), F.avg(F.least(v / 500, F.lit(1.0))).alias("coverage"))
    return u.withColumn("score", F.when(F.col("uses") < 3, 0.5).otherwise(0.5 * F.col("success") + 0.3 * F.col("executed") + 0.2 * F.col("coverage")))


@query(_USE + " select tag_name, tag_value, uses, round(success, 6) as success, round(coverage, 6) as coverage, round(score, 6) as score from e")
def agg_tag_usage(spark: SparkSession, d: str) -> DataFrame:
    return tag_use(spark, d).select("tag_name", "tag_value", "uses", *[F.round(c, 6).alias(c) for c in ("success", "coverage", "score")])


@query(_USE + " select count(*) as tags, sum(uses)::bigint as uses, count(*) filter (where uses >= 3) as judged, round(avg(score) filter (where uses >= 3), 6) as mean_score from e")
def agg_tag_effect_summary(spark: SparkSession, d: str) -> DataFrame:
    enough = F.col("uses") >= 3
    return tag_use(spark, d).agg(F.count(F.lit(1)).alias("tags"), F.sum("uses").alias("uses"), F.count_if(enough).alias("judged"), F.round(F.avg(F.when(enough, F.col("score"))), 6).alias("mean_score"))


@query(_USE + " select tag_name, tag_value, round(score, 6) as score from e where uses >= 3 order by e.score desc, tag_name, tag_value limit 10")
def topk_tags(spark: SparkSession, d: str) -> DataFrame:
    """The ten most effective tags of three uses or more: a report."""
    return tag_use(spark, d).where("uses >= 3").orderBy(F.desc("score"), "tag_name", "tag_value").limit(10).select("tag_name", "tag_value", F.round("score", 6).alias("score"))


@query(_USE + " select tag_name, uses, round(score, 6) as score from e where tag_value = 'g7'")
def tag_stats(spark: SparkSession, d: str) -> DataFrame:
    return tag_use(spark, d).where("tag_value = 'g7'").select("tag_name", "uses", F.round("score", 6).alias("score"))


@query("select user_id, count(*) as left_over from events where event_type <> 'error' and user_id % 10 <> 3 group by 1")
def cache_invalidate(spark: SparkSession, d: str) -> DataFrame:
    """Entries left after invalidation by a part of the key and by single keys."""
    e = table(spark, d, "events")
    gone = e.where("user_id % 10 = 3").select("user_id").distinct()
    return e.where(~F.col("event_type").contains("error")).join(gone, "user_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("left_over"))


# ---- the graph

# Dangerous calls with their risk and severity, and words of boundaries and of cleaning.
RISKS = {k: tuple(v) for k, v in R.lists("""
    strcpy: buffer-overflow, critical
    strcat: buffer-overflow, critical
    sprintf: buffer-overflow, critical
    vsprintf: buffer-overflow, critical
    gets: buffer-overflow, critical
    scanf: buffer-overflow, high
    memcpy: buffer-overflow, high
    printf: format-string, medium
    fprintf: format-string, medium
    snprintf: format-string, low
    SPI_exec: sql-injection, critical
    SPI_execute: sql-injection, critical
    SPI_execute_plan: sql-injection, high
    open: path-traversal, high
    fopen: path-traversal, high
    stat: path-traversal, medium
    access: path-traversal, medium
    system: command-injection, critical
    popen: command-injection, critical
    exec: command-injection, critical
""").items()}
BOUNDARIES = R.lists("""
    user-input: PQgetvalue, recv, recvfrom, read, fgets, getenv, PG_GETARG, fcinfo
    network-input: recv, socket
    file-input: fopen, read, File
""")
VALIDATORS = ["quote_identifier", "quote_literal", "escape_string", "pg_strncpy", "strlcpy", "pqCheckOutBufferSpace", "check_stack_depth", "CheckTableNotInUse"]
#: Names the calls of the stand-in graph are given in turn, so that every rule meets some.
_SAMPLE = [*RISKS, "PQgetvalue", "socket_accept", "OpenFile", "quote_literal", "escape_json", "check_lock", "heap_insert", "_superuser_arg", "pg_class_ownercheck"]
_NAME_SQL = f"{R.quoted(_SAMPLE)}[(id % {len(_SAMPLE)}) + 1]"
_FIRST_SQL = "case " + " ".join(f"when {R.hits_sql('n', ts)} > 0 then '{k}'" for k, ts in BOUNDARIES.items()) + " end"
_CLEANED_SQL = f"case when n in ({', '.join(repr(v) for v in VALIDATORS)}) then 'validated' when contains(n, 'escape') or contains(n, 'quote') then 'escaped' when contains(n, 'check') or contains(n, 'validate') then 'sanitized' else 'none' end"


@query(f", c as (select id, {_NAME_SQL} as n from nodes where label = 'CALL'), x as (select id, case n " + " ".join(f"when '{k}' then '{v[0]}'" for k, v in RISKS.items()) + " end as risk, case n " + " ".join(f"when '{k}' then '{v[1]}'" for k, v in RISKS.items()) + f" end as severity, {_FIRST_SQL} as boundary, {_CLEANED_SQL} as cleaned from c) select id, risk, severity, boundary, case when risk is not null then cleaned end as sanitization from x where risk is not null or boundary is not null", True)
def enrich_security(spark: SparkSession, d: str) -> DataFrame:
    """Risk and severity of dangerous calls with how they are cleaned, and the boundary a call crosses: first match each."""
    n = F.col("n")
    names = F.element_at(R.strings(_SAMPLE), (F.col("id") % len(_SAMPLE) + 1).cast("int"))
    boundary = F.coalesce(*[F.when(R.holds_any(n, ts), k) for k, ts in BOUNDARIES.items()])
    risk, severity = (F.coalesce(*[F.when(n == k, v[i]) for k, v in RISKS.items()]) for i in (0, 1))
    cleaned = F.when(n.isin(VALIDATORS), "validated").when(R.holds_any(n, ["escape", "quote"]), "escaped").when(R.holds_any(n, ["check", "validate"]), "sanitized").otherwise("none")
    calls = of(graph(spark, d), "CALL").select("id", names.alias("n"))
    x = calls.select("id", risk.alias("risk"), severity.alias("severity"), boundary.alias("boundary"), cleaned.alias("cleaned")).where("risk is not null or boundary is not null")
    return x.select("id", "risk", "severity", "boundary", F.when(F.col("risk").isNotNull(), F.col("cleaned")).alias("sanitization"))


@query(" select c.id from nodes c join nodes f on f.label = 'FILE' and f.filename = c.filename where c.label = 'CALL' and contains(f.filename, '/storage/')", True)
def join_tag_via_file(spark: SparkSession, d: str) -> DataFrame:
    """Elements by a property of their file."""
    g = graph(spark, d)
    files = of(g, "FILE").where(F.col("filename").contains("/storage/")).select("filename")
    return of(g, "CALL").select("id", "filename").join(files, "filename").select("id")


@query(" select distinct name from nodes where label = 'METHOD' and contains(filename, 'executor')", True)
def impact_file_methods(spark: SparkSession, d: str) -> DataFrame:
    return of(graph(spark, d), "METHOD").where(F.col("filename").contains("executor")).select("name").distinct()


@query(" select string_split(filename, '/')[3] as subsystem, count(*) as files, min(filename) as first_file from nodes where label = 'FILE' group by 1", True)
def subsystem_lookup(spark: SparkSession, d: str) -> DataFrame:
    return of(graph(spark, d), "FILE").groupBy(F.element_at(F.split("filename", "/"), 3).alias("subsystem")).agg(F.count(F.lit(1)).alias("files"), F.min("filename").alias("first_file"))


@query(" select id, not contains(code, 'static ') and not starts_with(name, '_') as public from nodes where label = 'METHOD'", True)
def api_public(spark: SparkSession, d: str) -> DataFrame:
    return of(graph(spark, d), "METHOD").select("id", (~F.col("code").contains("static ") & ~F.col("name").startswith("_")).alias("public"))


@query(" select method_id as id, count(*) filter (where starts_with(name, 'heap_')) > 5 as allocation_heavy, bool_or(starts_with(name, 'buf_')) as io_bound from nodes where label = 'CALL' group by 1", True)
def agg_alloc_io_flags(spark: SparkSession, d: str) -> DataFrame:
    """Methods of more than five allocating calls, and of any call that reads or writes."""
    n = F.col("name")
    return of(graph(spark, d), "CALL").groupBy(F.col("method_id").alias("id")).agg((F.count_if(n.startswith("heap_")) > 5).alias("allocation_heavy"), F.max(n.startswith("buf_")).alias("io_bound"))


@query(" select cast(floor(100.0 * count(*) filter (where regexp_matches(name, '^(?:lock|buf|plan)_')) / count(*)) as bigint) as percent from nodes where label = 'METHOD'", True)
def agg_semantic_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of methods with a class, cut to whole percents."""
    return of(graph(spark, d), "METHOD").agg(F.floor(100.0 * F.count_if(F.col("name").rlike("^(?:lock|buf|plan)_")) / F.count(F.lit(1))).alias("percent"))


@query(" select label as kind, count(*) as n, min(id) as first_id from (select label, id from nodes where label in ('CONTROL_STRUCTURE', 'CALL') union all select 'FLOW', src from edges where label = 'REACHING_DEF') group by 1", True)
def set_pattern_union(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of several kinds as one list."""
    g = graph(spark, d)
    every = g.nodes.where("label in ('CONTROL_STRUCTURE', 'CALL')").select(F.col("label").alias("kind"), "id").unionByName(g.edges.where("label = 'REACHING_DEF'").select(F.lit("FLOW").alias("kind"), F.col("src").alias("id")))
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query(" select id, row_number() over (order by n desc, k desc, id) as place from (select m.id, coalesce(t.n, 0) as n, m.line_number as k from nodes m left join (select node_id, count(*) as n from tags group by 1) t on t.node_id = m.id where m.label = 'METHOD') qualify place <= 20", True)
def sort_multi_key(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty by two keys, both falling: a report."""
    g = graph(spark, d)
    n = g.tags.groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    top = of(g, "METHOD").select("id", "line_number").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).orderBy(F.desc("n"), F.desc("line_number"), "id").limit(20)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("line_number"), "id")).alias("place"))
