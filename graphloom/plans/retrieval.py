"""Vectors, threads, caches, evaluation and event streams."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators import vectors as V
from graphloom.session import materialize, table
from graphloom.streaming import events as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


_UNIT = "with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings), n as (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as u, e from v)"


@query(_UNIT + ", s as (select q.vec_id as query_id, n.vec_id, list_dot_product(q.u, n.u) as sim from n q join n on n.vec_id <> q.vec_id where q.vec_id % 20 = 0), r as (select *, row_number() over (partition by query_id order by round(sim, 9) desc, vec_id) as rank from s) select query_id, vec_id, rank, round(sim, 6) as similarity from r where rank <= 5")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Every twentieth vector against all: the five most similar."""
    v = vectors(spark, d)
    return V.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 5, "cosine").select("query_id", "vec_id", "rank", F.round("score", 6).alias("similarity"))


@query("with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), s as (select q.vec_id as query_id, n.vec_id, list_distance(q.e, n.e) * list_distance(q.e, n.e) as dist from v q join v n on n.vec_id <> q.vec_id where q.vec_id % 20 = 0), r as (select *, row_number() over (partition by query_id order by round(dist, 9), vec_id) as rank from s) select query_id, vec_id, rank, round(1 - dist, 6) as similarity from r where rank <= 3")
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return V.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 3, "l2").select("query_id", "vec_id", "rank", F.round(1 + F.col("score"), 6).alias("similarity"))


@query("with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), s as (select q.vec_id as query_id, n.vec_id, list_distance(q.e, n.e) * list_distance(q.e, n.e) as dist from v q join v n on n.vec_id <> q.vec_id where q.vec_id % 20 = 0), r as (select *, row_number() over (partition by query_id order by round(dist, 9), vec_id) as rank from s) select query_id, round(avg(exp(-dist)), 6) as mean_relevance, round(max(exp(-dist)), 6) as best from r where rank <= 3 group by 1")
def knn_exp_relevance(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    near = V.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 3, "l2").withColumn("relevance", F.exp("score"))
    return near.groupBy("query_id").agg(F.round(F.avg("relevance"), 6).alias("mean_relevance"), F.round(F.max("relevance"), 6).alias("best"))


@query(_UNIT + ", s as (select q.vec_id as query_id, n.vec_id, list_dot_product(q.u, n.u) as sim from n q join n on n.vec_id <> q.vec_id where q.vec_id % 20 = 0 and n.label = 3), r as (select *, row_number() over (partition by query_id order by round(sim, 9) desc, vec_id) as rank from s) select query_id, vec_id, rank from r where rank <= 5")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return V.nearest(v.where("vec_id % 20 = 0"), v.where("label = 3"), "vec_id", "embedding", 5, "cosine").select("query_id", "vec_id", "rank")


@query(_UNIT + ", s as (select q.vec_id as query_id, n.vec_id, n.label, q.label as ql, list_dot_product(q.u, n.u) as sim from n q join n on n.vec_id <> q.vec_id where q.vec_id % 20 = 0), r as (select *, row_number() over (partition by query_id order by round(sim, 9) desc, vec_id) as rank from s), w as (select query_id, vec_id, sim * case when label = ql then 1.3 else 1.0 end as score from r where rank <= 10), o as (select *, row_number() over (partition by query_id order by round(score, 9) desc, vec_id) as rank from w) select query_id, vec_id, rank from o where rank <= 5")
def retrieve_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Ten candidates, those of the query's own label weighted by 1.3, the best five."""
    v = vectors(spark, d)
    near = V.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 10, "cosine")
    labels = v.select("vec_id", "label")
    near = near.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    near = near.withColumn("weighted", F.col("score") * F.when(F.col("label") == F.col("own"), 1.3).otherwise(1.0)).drop("rank")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("weighted", 9)), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "vec_id", "rank")


@query(_UNIT + " select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id < b.vec_id where list_dot_product(a.u, b.u) >= 0.45")
def join_pairwise_similarity(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a cosine of 0.45 or more: a threshold at which no filter works, so blocks are compared as matrices."""
    return V.similar_pairs(vectors(spark, d), "vec_id", "embedding", 0.45).select("a", "b")


@query(_UNIT + ", p as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id < b.vec_id where list_dot_product(a.u, b.u) >= 0.45) select vec_id, (select count(*) from p where a = vec_id or b = vec_id) as links from v")
def dedup_links(spark: SparkSession, d: str) -> DataFrame:
    pairs = join_pairwise_similarity(spark, d)
    ends = pairs.select(F.col("a").alias("vec_id")).unionByName(pairs.select(F.col("b").alias("vec_id")))
    n = ends.groupBy("vec_id").agg(F.count(F.lit(1)).alias("links"))
    return vectors(spark, d).select("vec_id").join(n, "vec_id", "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("links"))


@query()
def cluster_kmeans(spark: SparkSession, d: str) -> DataFrame:
    """k-means with k = n div 10, at least 2 and at most 50; the best of ten starts, each of at most 300 rounds."""
    v = vectors(spark, d).select("vec_id", array_to_vector("embedding").alias("features"))
    k = max(2, min(50, v.count() // 10))
    models = [KMeans(k=k, seed=42 + start, maxIter=300).fit(v) for start in range(10)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(v).select("vec_id", F.col("prediction").alias("cluster"))


@query("with recursive v" + _UNIT.removeprefix("with v") + ", p as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id where list_dot_product(a.u, b.u) >= 0.45), t as (select vec_id as x, vec_id as component from v union select p.b, t.component from t join p on p.a = t.x), c as (select x, min(component) as component from t group by 1), s as (select component, count(*) as n from c group by 1) select x as vec_id, case when n >= 5 then component else -1 end as cluster from c join s using (component)")
def cluster_density(spark: SparkSession, d: str) -> DataFrame:
    """Connected groups of near vectors; -1 for groups under five."""
    pairs = materialize(V.similar_pairs(vectors(spark, d), "vec_id", "embedding", 0.45), "near")
    groups = V.components(vectors(spark, d).select("vec_id"), pairs, "vec_id")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return groups.join(sizes, "component").select("vec_id", F.when(F.col("n") >= 5, F.col("component")).otherwise(-1).alias("cluster"))


@query()
def fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """Labels of topics most like the label of each record: the ratio of matching blocks, at least 0.7 where one
    holds the other, and 0.6 or more to count; ties go to the smaller label. Distinct labels are compared, the
    topics' in blocks of bounded size; no label is left out."""
    records = table(spark, d, "all_qa_merged").select("qa_key", "cluster_label").where("cluster_label is not null")
    return records.join(fuzzy_labels(records.select("cluster_label").distinct(), table(spark, d, "topic_cluster").select("label").where("label is not null").distinct()), "cluster_label", "left").select("qa_key", "match")


def fuzzy_labels(texts: DataFrame, labels: DataFrame, threshold: float = 0.6, block: int = 1000) -> DataFrame:
    """(cluster_label, match): the label of the highest ratio of each text, if it reaches the threshold."""
    spark = texts.sparkSession
    blocks = max(1, -(-labels.count() // block))
    every = spark.createDataFrame([], "cluster_label string, match string, ratio double")
    for b in range(blocks):
        shared = spark.sparkContext.broadcast(sorted(r[0] for r in labels.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == b).collect()))

        def best(it: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in it:
                out = []
                for text in pdf["cluster_label"]:
                    matcher, low = difflib.SequenceMatcher(autojunk=False), text.lower()
                    matcher.set_seq2(low)
                    top = (threshold, None)
                    for label in shared.value:
                        held = low in label.lower() or label.lower() in low
                        matcher.set_seq1(label.lower())
                        # the quick bounds are never below the ratio
                        if held or (matcher.real_quick_ratio() >= top[0] and matcher.quick_ratio() >= top[0]):
                            ratio = max(matcher.ratio(), 0.7 if held else 0.0)
                            if ratio > top[0] or (ratio == top[0] and top[1] is None):
                                top = (ratio, label)
                    if top[1] is not None:
                        out.append((text, top[1], top[0]))
                yield pd.DataFrame(out, columns=["cluster_label", "match", "ratio"])

        every = every.unionByName(texts.select("cluster_label").mapInPandas(best, "cluster_label string, match string, ratio double"))
    return every.groupBy("cluster_label").agg(F.min_by("match", F.struct(-F.col("ratio"), F.col("match"))).alias("match"))


@query()
def dedup_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Vectors left after the greedy pass that keeps the longer text of each alike pair (text length stood in by a
    number drawn from the key). Tested against the sequential pass."""
    v = vectors(spark, d).select("vec_id", (F.col("vec_id") * 7919 % 101).alias("size"))
    return V.keep_longer(v, join_pairwise_similarity(spark, d), "vec_id", "size").select("vec_id")


# ---- threads


_THREADS = "with recursive m as (select nullif(regexp_replace(message_id, '[\\s<>]', '', 'g'), '') as id, nullif(regexp_replace(parent_id, '[\\s<>]', '', 'g'), '') as up, min(msg_key) as k from thread_message group by 1, 2), f as (select id, arg_min(up, k) as up from m where id is not null group by 1), t as (select f.id, f.id as root from f where up is null or up not in (select id from f) union all select f.id, t.root from f join t on f.up = t.id)"


@query(_THREADS + " select id, root from t")
def thread_root(spark: SparkSession, d: str) -> DataFrame:
    """Root of every message whose chain of parents ends: at a message without parent or with one that
    is not there."""
    from graphloom.operators.threads import roots

    return roots(table(spark, d, "thread_message"))


@query(_THREADS + " select root, count(*) as messages from t group by 1")
def agg_thread_stats(spark: SparkSession, d: str) -> DataFrame:
    return thread_root(spark, d).groupBy("root").agg(F.count(F.lit(1)).alias("messages"))


# ---- tag use, cache traces, evaluation on events


@query("select event_type as tag, count(*) as uses, round(avg(value), 6) as mean_value, round(0.5 * avg((value > 50)::int) + 0.3 * avg((value > 100)::int) + 0.2 * least(avg(value) / 500, 1), 6) as score from events group by 1")
def agg_tag_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    score = 0.5 * F.avg((v > 50).cast("int")) + 0.3 * F.avg((v > 100).cast("int")) + 0.2 * F.least(F.avg(v) / 500, F.lit(1.0))
    return events(spark, d).groupBy(F.col("event_type").alias("tag")).agg(F.count(F.lit(1)).alias("uses"), F.round(F.avg(v), 6).alias("mean_value"), F.round(score, 6).alias("score"))


# The trace folded row by row: an entry lives a day from the look-up that set it, whatever hits come between.
_CACHE = "with recursive o as (select event_id, user_id, event_type, epoch_us(ts) as t_us, row_number() over (partition by user_id, event_type order by ts, event_id) as i from events), f as (select event_id, user_id, event_type, i, t_us as since, false as hit from o where i = 1 union all select o.event_id, o.user_id, o.event_type, o.i, case when o.t_us - f.since <= 86400000000 then f.since else o.t_us end, o.t_us - f.since <= 86400000000 from f join o on o.user_id = f.user_id and o.event_type = f.event_type and o.i = f.i + 1)"


@query(_CACHE + " select event_id, hit from f")
def cache_lru(spark: SparkSession, d: str) -> DataFrame:
    """A trace of look-ups by (user, type) against a cache that keeps an entry for a day from the look-up
    that set it: a miss sets it anew, a hit does not prolong it. One pass over sorted partitions; between
    batches only the last key and the time of its set are carried."""
    ttl = 3600 * 24 * 1_000_000

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, since = None, None
        for pdf in batches:
            hits = []
            for user, kind, at in zip(pdf["user_id"].tolist(), pdf["event_type"].tolist(), pdf["at"].tolist()):
                key = (None if user != user else user, kind)
                if key != last:
                    last, since = key, None
                if at != at:
                    hits.append(False)
                    continue
                hit = since is not None and at - since <= ttl
                if not hit:
                    since = at
                hits.append(hit)
            yield pd.DataFrame({"event_id": pdf["event_id"], "hit": pd.Series(hits, dtype=bool)})

    trace = events(spark, d).select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    ordered = trace.repartition("user_id", "event_type").sortWithinPartitions("user_id", "event_type", "at", "event_id")
    return ordered.mapInPandas(replay, "event_id bigint, hit boolean")


@query(_CACHE + " select event_type, round(avg(hit::int), 6) as hit_rate, count(*) as lookups from f group by 1")
def cache_metrics(spark: SparkSession, d: str) -> DataFrame:
    kinds = events(spark, d).select("event_id", "event_type")
    return cache_lru(spark, d).join(kinds, "event_id").groupBy("event_type").agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"), F.count(F.lit(1)).alias("lookups"))


_EVAL = "select model_run, count(*) as n, avg((coalesce(ground_truth, '') like 'cpg.%')::int) as p from ragas_dataset group by 1"


@query(f"select model_run, n, round(p, 6) as validity, round(greatest(p - 1.96 * sqrt(p * (1 - p) / n), 0), 6) as low, round(least(p + 1.96 * sqrt(p * (1 - p) / n), 1), 6) as high from ({_EVAL})")
def agg_confidence_interval(spark: SparkSession, d: str) -> DataFrame:
    valid = F.coalesce("ground_truth", F.lit("")).startswith("cpg.").cast("int")
    g = table(spark, d, "ragas_dataset").groupBy("model_run").agg(F.count(F.lit(1)).alias("n"), F.avg(valid).alias("p"))
    half = 1.96 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return g.select("model_run", "n", F.round("p", 6).alias("validity"), F.round(F.greatest(F.col("p") - half, F.lit(0.0)), 6).alias("low"), F.round(F.least(F.col("p") + half, F.lit(1.0)), 6).alias("high"))


@query("select event_type, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as deviation, round(median(value), 6) as median from events group by 1")
def agg_eval_batch(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"), F.round(F.median("value"), 6).alias("median"))


@query("select case when value >= 300 then 'high' when value >= 100 then 'medium' else 'low' end as band, count(*) as n, round(avg((event_type = 'purchase')::int), 6) as validity from events group by 1")
def agg_coverage_buckets(spark: SparkSession, d: str) -> DataFrame:
    band = F.when(F.col("value") >= 300, "high").when(F.col("value") >= 100, "medium").otherwise("low")
    return events(spark, d).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("event_type") == "purchase").cast("int")), 6).alias("validity"))


@query("select model_run, count(*) filter (where contains(ground_truth, '.name(') or contains(ground_truth, '.where(')) as tagged, count(*) filter (where starts_with(ground_truth, 'cpg.method')) as methods, round(avg(length(ground_truth)), 6) as mean_length from ragas_dataset group by 1")
def agg_query_patterns(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("ground_truth")
    return table(spark, d, "ragas_dataset").groupBy("model_run").agg(F.count_if(g.contains(".name(") | g.contains(".where(")).alias("tagged"), F.count_if(g.startswith("cpg.method")).alias("methods"), F.round(F.avg(F.length(g)), 6).alias("mean_length"))


@query("select coalesce(lower(q.difficulty), 'unknown') as difficulty, count(*) as answers, count(r.ground_truth) as with_truth from ragas_dataset r join all_qa_merged q on q.qa_key = r.qa_key group by 1")
def difficulty_validity(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "ragas_dataset").select("qa_key", "ground_truth")
    level = table(spark, d, "all_qa_merged").select("qa_key", F.coalesce(F.lower("difficulty"), F.lit("unknown")).alias("difficulty"))
    return runs.join(level, "qa_key").groupBy("difficulty").agg(F.count(F.lit(1)).alias("answers"), F.count("ground_truth").alias("with_truth"))


@query("select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Hourly totals; the same plan runs on a stream with a watermark."""
    return S.hourly_totals(events(spark, d))


@query("with g as (select *, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval 30 minute then 1 else 0 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as no from g) select user_id, min(ts) as started, count(*) as n from s group by user_id, no")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return S.sessions(events(spark, d))
