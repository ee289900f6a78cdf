"""The deterministic shells around question answering, and further patterns of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import table
from graphloom.sources.standin import SQL, graph

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def confidence_of(found: Column, succeeded: Column, fallback: Column, hinted: Column) -> Column:
    """Trust in an answer by the number of results: few are best; a fallback costs a tenth, hints add one."""
    base = F.when(found == 0, 0.3).when(found <= 10, 0.9).when(found <= 50, 0.8).otherwise(0.6)
    base = base * F.when(fallback, 0.9).otherwise(1.0)
    return F.when(succeeded, F.round(F.when(hinted, F.least(base + 0.1, F.lit(1.0))).otherwise(base), 2)).otherwise(0.0)


@query("select p_partkey, case when p_size % 7 = 0 then 0.0 else round(case when p_brand = 'Brand#1' then least(c + 0.1, 1.0) else c end, 2) end as confidence from (select *, (case when p_partkey % 60 = 0 then 0.3 when p_partkey % 60 <= 10 then 0.9 when p_partkey % 60 <= 50 then 0.8 else 0.6 end)::double * (case when p_size > 25 then 0.9 else 1.0 end)::double as c from part)")
def answer_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", confidence_of(F.col("p_partkey") % 60, F.col("p_size") % 7 != 0, F.col("p_size") > 25, F.col("p_brand") == "Brand#1").alias("confidence"))


@query("select qa_key, case when k >= 4 or t >= 4 then 'complex' else 'moderate' end as complexity from (select qa_key, len(string_split(question, '_')) - 1 as k, coalesce(len(topics), 0) as t from all_qa_merged where question is not null)")
def query_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Many keywords or topics make a question complex."""
    k, t = F.size(F.split("question", "_")) - 1, F.coalesce(F.size("topics"), F.lit(0))
    return table(spark, d, "all_qa_merged").where("question is not null").select("qa_key", F.when((k >= 4) | (t >= 4), "complex").otherwise("moderate").alias("complexity"))


@query("select ragas_key, list_filter([case when g = '' then 'empty' end, case when not starts_with(g, 'cpg') then 'root' end, case when contains(g, '..') then 'dots' end, case when len(replace(g, '(', '')) <> len(replace(g, ')', '')) then 'parentheses' end, case when len(replace(g, '[', '')) <> len(replace(g, ']', '')) then 'brackets' end], lambda x: x is not null) as issues from (select ragas_key, trim(coalesce(ground_truth, answer, '')) as g from ragas_dataset)")
def validate_grammar(spark: SparkSession, d: str) -> DataFrame:
    g = F.trim(F.coalesce("ground_truth", "answer", F.lit("")))
    without = lambda c: F.length(F.replace(g, F.lit(c), F.lit("")))
    issues = F.array(F.when(g == "", "empty"), F.when(~g.startswith("cpg"), "root"), F.when(g.contains(".."), "dots"), F.when(without("(") != without(")"), "parentheses"), F.when(without("[") != without("]"), "brackets"))
    return table(spark, d, "ragas_dataset").select("ragas_key", F.array_compact(issues).alias("issues"))


@query("select ragas_key, list_filter([case when contains(ground_truth, '.name(') then 'by name' end, case when contains(ground_truth, '.caller') then 'its callers' end, case when contains(ground_truth, '.where(') then 'under a condition' end], lambda x: x is not null) as says from ragas_dataset where ground_truth is not null")
def explain_query(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("ground_truth")
    says = F.array(F.when(g.contains(".name("), "by name"), F.when(g.contains(".caller"), "its callers"), F.when(g.contains(".where("), "under a condition"))
    return table(spark, d, "ragas_dataset").where("ground_truth is not null").select("ragas_key", F.array_compact(says).alias("says"))


@query("select msg_key, md5(concat_ws(' ', subject, subject, subject, substr(body, 1, 2000))) as weighted from thread_message")
def weighted_text(spark: SparkSession, d: str) -> DataFrame:
    """The subject three times, then the first 2000 characters: the text that is clustered."""
    return table(spark, d, "thread_message").select("msg_key", F.md5(F.concat_ws(" ", "subject", "subject", "subject", F.substring("body", 1, 2000))).alias("weighted"))


@query("select id, max(msg_key) as msg_key from (select nullif(regexp_replace(message_id, '[\\s<>]', '', 'g'), '') as id, msg_key from thread_message) where id is not null group by 1")
def map_messages(spark: SparkSession, d: str) -> DataFrame:
    """Index of messages by identifier; the last row of an identifier wins, empty ones are skipped."""
    bare = F.nullif(F.regexp_replace("message_id", r"[\s<>]", ""), F.lit(""))
    return table(spark, d, "thread_message").select(bare.alias("id"), "msg_key").where("id is not null").groupBy("id").agg(F.max("msg_key").alias("msg_key"))


@query("select cluster_id, component, n from (select *, row_number() over (partition by cluster_id order by n desc, component) as r from (select cluster_id, string_split(f, '/')[3] as component, count(*) as n from (select cluster_id, unnest(source_files) as f from all_qa_merged) group by 1, 2)) where r <= 5")
def agg_top_components(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent components of the files of each cluster."""
    files = table(spark, d, "all_qa_merged").select("cluster_id", F.explode("source_files").alias("f"))
    counts = files.groupBy("cluster_id", F.try_element_at(F.split("f", "/"), F.lit(3)).alias("component")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "component")
    return counts.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


@query("select 'qa_' || (row_number() over (partition by cluster_id order by qa_key) - 1) as id, cluster_id, qa_key from all_qa_merged")
def win_global_index(spark: SparkSession, d: str) -> DataFrame:
    """Positional identifiers within each cluster."""
    w = Window.partitionBy("cluster_id").orderBy("qa_key")
    return table(spark, d, "all_qa_merged").select(F.concat(F.lit("qa_"), (F.row_number().over(w) - 1).cast("string")).alias("id"), "cluster_id", "qa_key")


@query(SQL + " select source, target from (select src as source, dst as target, row_number() over (partition by src order by dst) as r from edges where label = 'REACHING_DEF') where r <= 10")
def pat_param_flow(spark: SparkSession, d: str) -> DataFrame:
    """At most ten data-flow targets of a source: the limit is the pattern's own."""
    w = Window.partitionBy("src").orderBy("dst")
    return graph(spark, d).edges.where("label = 'REACHING_DEF'").withColumn("r", F.row_number().over(w)).where("r <= 10").select(F.col("src").alias("source"), F.col("dst").alias("target"))


@query(SQL + " select id, case when is_static or starts_with(name, '_') then 'internal-hook' when contains(filename, '.h') then 'public-api' else 'sealed' end as extensibility from nodes where label = 'METHOD'")
def enrich_extension(spark: SparkSession, d: str) -> DataFrame:
    """How far a method may be extended, by its storage class, name and file."""
    kind = F.when(F.col("is_static") | F.col("name").startswith("_"), "internal-hook").when(F.col("filename").contains(".h"), "public-api").otherwise("sealed")
    return graph(spark, d).nodes.where("label = 'METHOD'").select("id", kind.alias("extensibility"))
