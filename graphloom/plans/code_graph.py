"""Joins, aggregations, rankings, enrichment passes and flow patterns of the code graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import materialize, table
from graphloom.sources.standin import CALL, METHOD, SQL, graph

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, on_graph: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (SQL if on_graph else "") + sql
        return f

    return add


def of(g, label: str) -> DataFrame:
    return g.nodes.where(F.col("label") == label)


def tagged(g, name: str, value: str | None = None) -> DataFrame:
    """Ids of the nodes with a tag."""
    t = g.tags.where(F.col("tag_name") == name)
    return (t if value is None else t.where(F.col("tag_value") == value)).select(F.col("node_id").alias("id")).distinct()


def call_pairs(g) -> DataFrame:
    """(caller, callee) method ids of every call site."""
    inside = g.edges.where("label = 'CONTAINS'").select(F.col("src").alias("caller"), F.col("dst").alias("site"))
    return g.edges.where("label = 'CALL'").select(F.col("src").alias("site"), F.col("dst").alias("callee")).join(inside, "site").select("caller", "callee", "site")


_PAIRS = ", cp as (select e.src as caller, c.dst as callee, c.src as site from edges c join edges e on e.dst = c.src and e.label = 'CONTAINS' where c.label = 'CALL')"
_METHODS = "(select * from nodes where label = 'METHOD')"

# ---- filters


@query("select id from nodes where label = 'METHOD' and regexp_full_match(name, '(buf|heap)_.*_[0-9]*7')")
def filter_name_regex(spark: SparkSession, d: str) -> DataFrame:
    return of(graph(spark, d), "METHOD").where(F.col("name").rlike("^(?:(buf|heap)_.*_[0-9]*7)$")).select("id")


@query("select node_id from tags where tag_name = 'cyclomatic-complexity' and try_cast(tag_value as int) > 30")
def filter_numeric_tag(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).tags.where("tag_name = 'cyclomatic-complexity' and try_cast(tag_value as int) > 30").select("node_id")


@query("select filename, count(*) as methods from nodes where label = 'METHOD' and not contains(filename, 'port') group by 1")
def filter_exclude_path(spark: SparkSession, d: str) -> DataFrame:
    return of(graph(spark, d), "METHOD").where(~F.col("filename").contains("port")).groupBy("filename").agg(F.count(F.lit(1)).alias("methods"))


def threshold_or_top(df: DataFrame, group: str, score: str, order: str, threshold: float, n: int) -> DataFrame:
    """Rows with a score of the threshold or more, the top ``n`` of them per group; where a group has
    none, its top ``n`` whatever the score."""
    any_good = F.max((F.col(score) >= threshold).cast("int")).over(Window.partitionBy(group))
    kept = df.withColumn("_any", any_good).where((F.col("_any") == 0) | (F.col(score) >= threshold))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), order))).where(F.col("rank") <= n).drop("_any")


@query("select user_id, event_id, rank from (select *, row_number() over (partition by user_id order by value desc, event_id) as rank from (select *, max((value >= 250)::int) over (partition by user_id) as a from events) where a = 0 or value >= 250) where rank <= 3", False)
def filter_threshold_fallback(spark: SparkSession, d: str) -> DataFrame:
    return threshold_or_top(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "value", "event_id", 250.0, 3).select("user_id", "event_id", "rank")


@query("select * from (select p_partkey, p_name from part where lower(p_name) in ('red bolt', 'blue ring'))", False)
def filter_by_name_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(F.lower("p_name").isin("red bolt", "blue ring")).select("p_partkey", "p_name")


@query("select p_partkey from part where p_partkey >= coalesce((select min(p_partkey) from part where lower(p_name) = 'large gear'), 0)", False)
def resume_from(spark: SparkSession, d: str) -> DataFrame:
    """Drops what lies before the first match; keeps everything where there is none."""
    parts = table(spark, d, "part")
    first = parts.where(F.lower("p_name") == "large gear").agg(F.coalesce(F.min("p_partkey"), F.lit(0)).alias("first"))
    return parts.where(F.col("p_partkey") >= first.scalar()).select("p_partkey")


# ---- joins


@query("select n.id, n.name from nodes n where exists (select 1 from tags t where t.node_id = n.id and t.tag_name = 'arch-layer' and t.tag_value = 'storage')")
def join_tag_semi(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return g.nodes.join(tagged(g, "arch-layer", "storage"), "id", "left_semi").select("id", "name")


@query("select n.id from nodes n where exists (select 1 from tags t where t.node_id = n.id and t.tag_value = 'storage') and exists (select 1 from tags t where t.node_id = n.id and t.tag_name = 'risk-severity' and t.tag_value = 'high')")
def join_tag_multi_semi(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return g.nodes.join(tagged(g, "arch-layer", "storage"), "id", "left_semi").join(tagged(g, "risk-severity", "high"), "id", "left_semi").select("id")


@query("select n.id from nodes n where label = 'METHOD' and not exists (select 1 from tags t where t.node_id = n.id and t.tag_name = 'risk-severity' and t.tag_value = 'high')")
def join_tag_anti(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    return of(g, "METHOD").join(tagged(g, "risk-severity", "high"), "id", "left_anti").select("id")


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that are not in ``tags`` yet, once each: the delta to append."""
    key = ["node_id", "tag_name", "tag_value"]
    return new.select("node_id", "node_label", "tag_name", "tag_value").dropDuplicates(key).join(tags, key, "left_anti")


@query("select k + 1000000000 as node_id, 'risk-severity' as tag_name, 'high' as tag_value from m0 where not (p_retailprice > 950 and p_retailprice <= 1000)")
def join_addtag_idempotent(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    new = of(g, "METHOD").select(F.col("id").alias("node_id"), F.col("label").alias("node_label"), F.lit("risk-severity").alias("tag_name"), F.lit("high").alias("tag_value"))
    return add_tags(g.tags, new.unionByName(new)).select("node_id", "tag_name", "tag_value")


@query(_PAIRS + " select m.name, count(*) as calls from cp join nodes m on m.id = cp.callee group by 1")
def join_call_fanin(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    methods = of(g, "METHOD").select(F.col("id").alias("callee"), "name")
    return call_pairs(g).join(methods, "callee").groupBy("name").agg(F.count(F.lit(1)).alias("calls"))


@query(_PAIRS + " select cp.site, a.filename as caller_file, t.tag_value as caller_layer from cp join nodes a on a.id = cp.caller left join (select node_id, min(tag_value) as tag_value from tags where tag_name = 'arch-layer' group by 1) t on t.node_id = cp.caller")
def join_caller_context(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    caller = of(g, "METHOD").select(F.col("id").alias("caller"), F.col("filename").alias("caller_file"))
    layer = g.tags.where("tag_name = 'arch-layer'").groupBy(F.col("node_id").alias("caller")).agg(F.min("tag_value").alias("caller_layer"))
    return call_pairs(g).join(caller, "caller").join(layer, "caller", "left").select("site", "caller_file", "caller_layer")


def file_dependencies(g) -> DataFrame:
    """(file, needs): files whose methods call methods of another file, once each."""
    files = of(g, "METHOD").select("id", "filename")
    pairs = call_pairs(g).select("caller", "callee").distinct()
    pairs = pairs.join(files.toDF("caller", "file"), "caller").join(files.toDF("callee", "needs"), "callee")
    return pairs.where("file <> needs").select("file", "needs").distinct()


_DEPS = _PAIRS + ", deps as (select distinct a.filename as file, b.filename as needs from cp join nodes a on a.id = cp.caller join nodes b on b.id = cp.callee where a.filename <> b.filename)"


@query(_DEPS + " select file, needs from deps")
def join_file_deps(spark: SparkSession, d: str) -> DataFrame:
    return file_dependencies(graph(spark, d))


@query(_DEPS + " select a.file, a.needs from deps a join deps b on a.file = b.needs and a.needs = b.file where a.file < a.needs")
def join_cycle2(spark: SparkSession, d: str) -> DataFrame:
    deps = file_dependencies(graph(spark, d))
    return deps.join(deps.toDF("needs", "file"), ["file", "needs"], "left_semi").where("file < needs")


@query(_PAIRS + " select a.tag_value as from_layer, b.tag_value as to_layer, count(*) as calls from cp join tags a on a.node_id = cp.caller and a.tag_name = 'arch-layer' join tags b on b.node_id = cp.callee and b.tag_name = 'arch-layer' where a.tag_value <> b.tag_value group by 1, 2 order by 3 desc, 1, 2 limit 15")
def join_cross_layer(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen most frequent pairs of different layers: a report."""
    g = graph(spark, d)
    layer = g.tags.where("tag_name = 'arch-layer'").select("node_id", "tag_value")
    pairs = call_pairs(g).join(layer.toDF("caller", "from_layer"), "caller").join(layer.toDF("callee", "to_layer"), "callee").where("from_layer <> to_layer")
    return pairs.groupBy("from_layer", "to_layer").agg(F.count(F.lit(1)).alias("calls")).orderBy(F.desc("calls"), "from_layer", "to_layer").limit(15)


def range_overlap(ranges: DataFrame, queries: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Pairs whose [start, end] and [lo, hi] meet, within equal ``keys``. Both sides are cut into
    blocks of lines and joined by block, so the join is an equi-join; a pair is kept in the first
    block that both touch."""
    block = lambda c: F.floor(F.col(c) / width)
    left = ranges.where("start is not null and end is not null").withColumn("block", F.explode(F.sequence(block("start"), block("end"))))
    right = queries.where("lo <= hi").withColumn("block", F.explode(F.sequence(block("lo"), block("hi"))))
    met = left.join(right, [*keys, "block"]).where((F.col("start") <= F.col("hi")) & (F.col("end") >= F.col("lo")))
    return met.where(F.col("block") == F.greatest(block("start"), block("lo"))).drop("block")


@query("select m.id, q.k as range_no from nodes m join (select distinct p_size % 10 as f, p_size as k, p_size * 20 as lo, p_size * 20 + 60 as hi from part) q on m.filename = 'src/backend/' || ['optimizer', 'storage', 'executor', 'access', 'parser', 'utils', 'commands', 'tcop', 'catalog', 'port'][q.f + 1] || '/f' || q.f || '.c' and m.line_number <= q.hi and m.line_number_end >= q.lo where m.label = 'METHOD'")
def join_range_overlap(spark: SparkSession, d: str) -> DataFrame:
    from graphloom.sources.standin import DIRECTORIES, _pick

    methods = of(graph(spark, d), "METHOD").select("id", "filename", F.col("line_number").alias("start"), F.col("line_number_end").alias("end"))
    f = (F.col("p_size") % 10).cast("bigint")
    path = F.concat(F.lit("src/backend/"), _pick(DIRECTORIES, f), F.lit("/f"), f.cast("string"), F.lit(".c"))
    asked = table(spark, d, "part").select(path.alias("filename"), F.col("p_size").alias("range_no"), (F.col("p_size") * 20).alias("lo"), (F.col("p_size") * 20 + 60).alias("hi")).distinct()
    return range_overlap(methods, asked, ["filename"]).select("id", "range_no")


@query("select a.event_id from events a where event_type = 'error' and exists (select 1 from events b where b.user_id = a.user_id and b.event_type = 'view' and b.ts > a.ts and b.ts < a.ts + interval 3 hour)", False)
def join_between_lines(spark: SparkSession, d: str) -> DataFrame:
    """Errors with a view by the same user strictly between them and three hours later: a range window over the
    user's events tells whether one is there, so no range join is needed."""
    events = table(spark, d, "events").where("event_type in ('error', 'view')").select("user_id", "event_id", "ts", "event_type")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    later = Window.partitionBy("user_id").orderBy("us").rangeBetween(1, 3 * 3600 * 1_000_000 - 1)
    seen = events.withColumn("us", micros).withColumn("seen", F.max(F.when(F.col("event_type") == "view", 1)).over(later))
    return seen.where("event_type = 'error' and seen = 1").select("event_id")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tolerance: int) -> DataFrame:
    """Left rows with the nearest earlier-or-equal right ``value`` within ``tolerance`` of ``at``: both
    sides in one sorted pass (union, last value over a window), one shuffle by the keys, no range join."""
    l = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType), "_t": F.lit(None).cast("bigint")})  # noqa: E741
    r = right.select(*keys, at, F.col(value).alias("_v")).withColumns({"_side": F.lit(0), "_t": F.col(at).cast("bigint")})
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col(at), F.col("_side"), F.col("_v")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({value: F.last("_v", ignorenulls=True).over(w), "_at": F.last("_t", ignorenulls=True).over(w)})
    near = F.when(F.col(at).cast("bigint") - F.col("_at") <= tolerance, F.col(value))
    return seen.where("_side = 1").withColumn(value, near).drop("_side", "_v", "_t", "_at")


@query("select a.event_id, (select max(b.event_id) from events b where b.user_id = a.user_id and b.event_type = 'click' and b.event_id <= a.event_id and a.event_id - b.event_id <= 400) as near_id from events a where a.event_type = 'purchase'", False)
def join_asof_comment(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "event_id")
    clicks = events.where("event_type = 'click'").select("user_id", "event_id", F.col("event_id").alias("near_id"))
    return as_of(bought, clicks, ["user_id"], "event_id", "near_id", 400).select("event_id", "near_id")


@query("select c.id as site, s.id as scope from (select * from nodes where label = 'CALL') c join lateral (select n.id from nodes n where n.label = 'CONTROL_STRUCTURE' and n.method_id = c.method_id and n.line_number <= c.line_number and n.line_number_end >= c.line_number order by n.line_number desc, n.id desc limit 1) s on true")
def join_containing_scope(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    calls = of(g, "CALL").select(F.col("id").alias("site"), "method_id", F.col("line_number").alias("lo"), F.col("line_number").alias("hi"))
    scopes = of(g, "CONTROL_STRUCTURE").select(F.col("id").alias("scope"), "method_id", F.col("line_number").alias("start"), F.col("line_number_end").alias("end"))
    met = range_overlap(scopes, calls, ["method_id"])
    return met.groupBy("site").agg(F.max_by("scope", F.struct("start", "scope")).alias("scope"))


def longest_prefix(paths: DataFrame, prefixes: DataFrame, path: str, prefix: str) -> DataFrame:
    """Each path with its longest listed directory: the path's own directories are exploded and
    equi-joined with the list, so the list may be of any size."""
    parts = F.split(F.col(path), "/")
    own = paths.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias(prefix))
    return own.join(prefixes.select(prefix).distinct(), prefix).groupBy(path).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))


@query("select n.name as filename, max_by(p.dir, length(p.dir)) as directory from nodes n join (select 'src' as dir union all select 'src/backend' union all select 'src/backend/storage' union all select 'src/backend/port') p on starts_with(n.name, p.dir || '/') where n.label = 'FILE' group by 1")
def join_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    files = of(graph(spark, d), "FILE").select("filename")
    listed = spark.createDataFrame([("src",), ("src/backend",), ("src/backend/storage",), ("src/backend/port",)], "directory string")
    return longest_prefix(files, listed, "filename", "directory")


@query("select f.name as feature, coalesce(t.n, 0) as tagged from (values ('storage'), ('parser'), ('absent')) f(name) left join (select tag_value, count(distinct node_id) as n from tags where tag_name = 'arch-layer' group by 1) t on t.tag_value = f.name")
def join_features_counts(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    counts = g.tags.where("tag_name = 'arch-layer'").groupBy(F.col("tag_value").alias("feature")).agg(F.countDistinct("node_id").alias("n"))
    features = spark.createDataFrame([("storage",), ("parser",), ("absent",)], "feature string")
    return features.join(counts, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("tagged"))


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule whose token occurs in the text."""
    out = None
    for token, label in rules:
        hit = F.lower(text).contains(token)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default) if default is not None else out


_RULES = [("lock", "synchronisation"), ("buf", "buffer"), ("heap", "storage"), ("xlog", "recovery"), ("plan", "planning")]


@query("select id, case when contains(name, 'lock') then 'synchronisation' when contains(name, 'buf') then 'buffer' when contains(name, 'heap') then 'storage' when contains(name, 'xlog') then 'recovery' when contains(name, 'plan') then 'planning' else 'general' end as purpose from nodes where label = 'METHOD'")
def join_rule_table(spark: SparkSession, d: str) -> DataFrame:
    return of(graph(spark, d), "METHOD").select("id", first_rule(F.col("name"), _RULES, "general").alias("purpose"))


# ---- aggregations


@query("select tag_name, tag_value, count(*) as n from tags group by 1, 2")
def agg_tag_kv_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).tags.groupBy("tag_name", "tag_value").agg(F.count(F.lit(1)).alias("n"))


@query("select tag_name, count(*) as n, count(distinct tag_value) as tag_values from tags group by 1")
def agg_tag_name_rollup(spark: SparkSession, d: str) -> DataFrame:
    kv = agg_tag_kv_counts(spark, d)
    return kv.groupBy("tag_name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("tag_values"))


@query("select control_structure_type as kind, count(*) as n from nodes where label = 'CONTROL_STRUCTURE' group by 1")
def agg_group_size(spark: SparkSession, d: str) -> DataFrame:
    return of(graph(spark, d), "CONTROL_STRUCTURE").groupBy(F.col("control_structure_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("select cast(floor(100.0 * count(*) filter (where exists (select 1 from tags t where t.node_id = n.id and t.tag_value = 'low')) / greatest(count(*), 1)) as bigint) as percent from nodes n where label = 'METHOD'")
def agg_coverage_ratio(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    marked = of(g, "METHOD").join(tagged(g, "risk-severity", "low").withColumn("hit", F.lit(1)), "id", "left")
    return marked.agg(F.floor(100 * F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("percent"))


@query("select tag_value as feature, count(distinct node_id) as nodes from tags where tag_name = 'arch-layer' group by 1")
def agg_feature_coverage(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).tags.where("tag_name = 'arch-layer'").groupBy(F.col("tag_value").alias("feature")).agg(F.countDistinct("node_id").alias("nodes"))


@query(_PAIRS + ", x as (select a.filename as f, b.filename as t from cp join nodes a on a.id = cp.caller join nodes b on b.id = cp.callee) select f as filename, count(distinct t) as efferent, (select count(distinct y.f) from x y where y.t = x.f) as afferent from x group by f")
def agg_file_coupling(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    files = of(g, "METHOD").select("id", "filename")
    pairs = call_pairs(g).groupBy("caller", "callee").agg(F.count(F.lit(1)).alias("n")).join(files.toDF("caller", "f"), "caller").join(files.toDF("callee", "t"), "callee").select("f", "t").distinct()
    out = pairs.groupBy(F.col("f").alias("filename")).agg(F.countDistinct("t").alias("efferent"))
    into = pairs.groupBy(F.col("t").alias("filename")).agg(F.countDistinct("f").alias("afferent"))
    return out.join(into, "filename", "left").select("filename", "efferent", F.coalesce("afferent", F.lit(0)).alias("afferent"))


@query("select m.id, 1 + count(c.id) + count(c.id) filter (where contains(c.code, '&&') or contains(c.code, '||')) as complexity from nodes m left join nodes c on c.method_id = m.id and c.label = 'CONTROL_STRUCTURE' where m.label = 'METHOD' group by 1")
def agg_complexity(spark: SparkSession, d: str) -> DataFrame:
    return method_complexity(graph(spark, d))


def method_complexity(g) -> DataFrame:
    """One plus the control structures plus their logical operators, of every method."""
    per = of(g, "CONTROL_STRUCTURE").groupBy(F.col("method_id").alias("id")).agg((F.count(F.lit(1)) + F.count_if(F.col("code").contains("&&") | F.col("code").contains("||"))).alias("n"))
    return of(g, "METHOD").select("id").join(per, "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1).alias("complexity"))


@query("select m.id, count(*) filter (where c.label = 'CALL') as calls, count(*) filter (where c.label = 'CONTROL_STRUCTURE') as controls, count(*) filter (where c.label = 'IDENTIFIER') as identifiers from nodes m left join nodes c on c.method_id = m.id where m.label = 'METHOD' group by 1")
def agg_method_shape(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    own = g.nodes.where("method_id is not null").groupBy(F.col("method_id").alias("id")).agg(*[F.count_if(F.col("label") == k).alias(v) for k, v in (("CALL", "calls"), ("CONTROL_STRUCTURE", "controls"), ("IDENTIFIER", "identifiers"))])
    joined = of(g, "METHOD").select("id").join(own, "id", "left")
    return joined.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "controls", "identifiers")])


_DEPTH = ", up as (select id, id as at, 1 as depth from nodes where control_structure_type in ('FOR', 'WHILE', 'DO') union all select up.id, e.src, depth + (select count(*) from nodes p where p.id = e.src and p.control_structure_type in ('FOR', 'WHILE', 'DO'))::int from up join edges e on e.dst = up.at and e.label = 'AST' where e.src >= 3000000000)"


@query(_DEPTH + " select m.id, coalesce(max(u.depth), 0) as loop_depth from nodes m left join nodes c on c.method_id = m.id left join up u on u.id = c.id where m.label = 'METHOD' group by 1")
def agg_loop_depth(spark: SparkSession, d: str) -> DataFrame:
    return loop_depths(graph(spark, d))


def loop_depths(g) -> DataFrame:
    """Deepest nesting of loops in every method, climbing the syntax tree level by level."""
    loop = F.col("control_structure_type").isin("FOR", "WHILE", "DO")
    kinds = of(g, "CONTROL_STRUCTURE").select(F.col("id").alias("at"), loop.cast("int").alias("is_loop"))
    up = g.edges.where("label = 'AST'").select(F.col("dst").alias("at"), F.col("src").alias("parent"))
    walk = of(g, "CONTROL_STRUCTURE").where(loop).select("method_id", "id", F.col("id").alias("at"), F.lit(1).alias("depth"))
    every = walk
    while True:
        walk = walk.join(up, "at").select("method_id", "id", F.col("parent").alias("at"), "depth").join(kinds, "at").select("method_id", "id", "at", (F.col("depth") + F.col("is_loop")).alias("depth"))
        walk = materialize(walk, "climb")
        if not walk.take(1):
            break
        every = every.unionByName(walk)
    per = every.groupBy(F.col("method_id").alias("id")).agg(F.max("depth").alias("d"))
    return of(g, "METHOD").select("id").join(per, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("loop_depth"))


@query(_PAIRS + " select m.id, count(*) filter (where a.name like 'test\\_%' escape '\\') as tests from nodes m left join cp on cp.callee = m.id left join nodes a on a.id = cp.caller where m.label = 'METHOD' group by 1")
def agg_test_count(spark: SparkSession, d: str) -> DataFrame:
    return test_counts(graph(spark, d))


def test_counts(g) -> DataFrame:
    """Call sites in test methods, of every method."""
    tests = of(g, "METHOD").where(F.col("name").startswith("test_") | F.col("filename").contains("/test/")).select(F.col("id").alias("caller"))
    per = call_pairs(g).join(tests, "caller", "left_semi").groupBy(F.col("callee").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return of(g, "METHOD").select("id").join(per, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("tests"))


@query(_PAIRS + ", c as (select cp.callee, a.name, count(*) as n from cp join nodes a on a.id = cp.caller group by 1, 2) select callee as id, name as caller from (select *, row_number() over (partition by callee order by n desc, name) as r from c) where r = 1")
def agg_mode_caller(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    names = of(g, "METHOD").select(F.col("id").alias("caller"), "name")
    counts = call_pairs(g).groupBy("callee", "caller").agg(F.count(F.lit(1)).alias("n")).join(names, "caller").groupBy("callee", "name").agg(F.sum("n").alias("n"))
    return counts.groupBy(F.col("callee").alias("id")).agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("caller"))


@query("select filename, count(*) as methods, min(name) as first_name from nodes where label = 'METHOD' group by 1")
def agg_subsystem_files(spark: SparkSession, d: str) -> DataFrame:
    return of(graph(spark, d), "METHOD").groupBy("filename").agg(F.count(F.lit(1)).alias("methods"), F.min("name").alias("first_name"))


@query("select label, count(*) as n from nodes group by 1")
def agg_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def risk_of_callers(n: Column, public: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM or LOW by the number of callers."""
    return F.when(public & (n > 100), "CRITICAL").when(n > 50, "HIGH").when(n > 10, "MEDIUM").otherwise("LOW")


_IMPACT = _PAIRS + ", im as (select m.id, count(cp.site) as callers, count(distinct t.tag_value) as layers, case when not m.is_static and count(cp.site) > 100 then 'CRITICAL' when count(cp.site) > 50 then 'HIGH' when count(cp.site) > 10 then 'MEDIUM' else 'LOW' end as risk from nodes m left join cp on cp.callee = m.id left join tags t on t.node_id = cp.caller and t.tag_name = 'arch-layer' where m.label = 'METHOD' group by m.id, m.is_static)"


def impact_of(g) -> DataFrame:
    """(id, callers, layers, risk): what a change of each method touches."""
    layer = g.tags.where("tag_name = 'arch-layer'").select(F.col("node_id").alias("caller"), "tag_value")
    per = call_pairs(g).join(layer, "caller", "left").groupBy(F.col("callee").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tag_value").alias("l"))
    m = of(g, "METHOD").select("id", "is_static").join(per, "id", "left")
    n = F.coalesce("n", F.lit(0))
    return m.select("id", n.alias("callers"), F.coalesce("l", F.lit(0)).alias("layers"), risk_of_callers(n, ~F.col("is_static")).alias("risk"))


@query(_IMPACT + " select id, callers, layers, risk from im")
def impact(spark: SparkSession, d: str) -> DataFrame:
    return impact_of(graph(spark, d))


@query(_IMPACT + " select risk, count(*) as methods, sum(callers)::bigint as callers, max(layers) as layers from im group by 1")
def agg_impact(spark: SparkSession, d: str) -> DataFrame:
    return impact_of(graph(spark, d)).groupBy("risk").agg(F.count(F.lit(1)).alias("methods"), F.sum("callers").alias("callers"), F.max("layers").alias("layers"))


# ---- ranking


@query("select id, rank from (select id, row_number() over (partition by label order by id) as rank from nodes) where rank <= 5")
def topk_per_kind(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("id")
    return graph(spark, d).nodes.select("id", "label").withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("id", "rank")


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 25", False)
def topk_score_stable(spark: SparkSession, d: str) -> DataFrame:
    """The 25 best: a report."""
    return table(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(25)


@query(_IMPACT + " select id, callers from im order by callers desc, id limit 10")
def topk_api_callers(spark: SparkSession, d: str) -> DataFrame:
    return impact_of(graph(spark, d)).select("id", "callers").orderBy(F.desc("callers"), "id").limit(10)


@query("select m.id, try_cast(t.tag_value as int) as complexity, m.line_number_end - m.line_number + 1 as loc from nodes m join tags t on t.node_id = m.id and t.tag_name = 'cyclomatic-complexity' order by 2 desc, 1 limit 10")
def topk_complex_methods(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    c = g.tags.where("tag_name = 'cyclomatic-complexity'").select(F.col("node_id").alias("id"), F.col("tag_value").try_cast("int").alias("complexity"))
    return of(g, "METHOD").join(c, "id").select("id", "complexity", (F.col("line_number_end") - F.col("line_number") + 1).alias("loc")).orderBy(F.desc("complexity"), "id").limit(10)


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by value desc, event_id) as r from events) where r <= 10", False)
def topk_per_group_limit(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 10").select("user_id", "event_id")


@query("select o_orderkey from orders order by o_orderkey offset 40 limit 20", False)
def page_drop_take(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(40).limit(20)


@query("select user_id, event_id as first_event from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) where r = 1", False)
def win_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"))


@query("select user_id, event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id) as section from events", False)
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    heading = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", F.last(heading, ignorenulls=True).over(w).alias("section"))


# ---- enrichment passes


@query(_IMPACT + " select im.id, callers, not m.is_static and not starts_with(m.name, '_') as public from im join nodes m on m.id = im.id where callers >= 5")
def enrich_api(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    public = of(g, "METHOD").select("id", (~F.col("is_static") & ~F.col("name").startswith("_")).alias("public"))
    return impact_of(g).where("callers >= 5").select("id", "callers").join(public, "id")


@query("select id, line_number_end - line_number + 1 as loc, list_filter([case when line_number_end - line_number + 1 > 100 then 'long-method' end, case when signature_size > 7 then 'many-parameters' end, case when complexity > 20 then 'complex' end], lambda x: x is not null) as smells, case when complexity > 30 then 'critical' when complexity > 20 then 'high' when complexity > 15 then 'medium' else 'low' end as priority from (select n.*, try_cast(t.tag_value as int) as complexity from nodes n join tags t on t.node_id = n.id and t.tag_name = 'cyclomatic-complexity')")
def enrich_metrics(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    c = g.tags.where("tag_name = 'cyclomatic-complexity'").select(F.col("node_id").alias("id"), F.col("tag_value").try_cast("int").alias("complexity"))
    loc = F.col("line_number_end") - F.col("line_number") + 1
    smells = F.array_compact(F.array(F.when(loc > 100, "long-method"), F.when(F.col("signature_size") > 7, "many-parameters"), F.when(F.col("complexity") > 20, "complex")))
    priority = F.when(F.col("complexity") > 30, "critical").when(F.col("complexity") > 20, "high").when(F.col("complexity") > 15, "medium").otherwise("low")
    return of(g, "METHOD").join(c, "id").select("id", loc.alias("loc"), smells.alias("smells"), priority.alias("priority"))


@query(_DEPS + ", x as (select file, needs, row_number() over (partition by file order by needs) as r from deps) select file, string_agg(needs, ', ' order by needs) filter (where r <= 10) as depends_on, count(*) as n from x group by 1")
def enrich_dependency(spark: SparkSession, d: str) -> DataFrame:
    needs = F.array_sort(F.collect_set("needs"))
    return file_dependencies(graph(spark, d)).groupBy("file").agg(F.array_join(F.slice(needs, 1, 10), ", ").alias("depends_on"), F.count(F.lit(1)).alias("n"))


@query(_PAIRS + ", t as (select m.id, count(*) filter (where a.name like 'test\\_%' escape '\\') as tests from nodes m left join cp on cp.callee = m.id left join nodes a on a.id = cp.caller where m.label = 'METHOD' group by 1) select id, case when tests = 0 then 'untested' when tests < 5 then 'partial' else 'tested' end as coverage from t")
def enrich_test_coverage(spark: SparkSession, d: str) -> DataFrame:
    return test_counts(graph(spark, d)).select("id", F.when(F.col("tests") == 0, "untested").when(F.col("tests") < 5, "partial").otherwise("tested").alias("coverage"))


@query(_DEPTH + ", dd as (select m.id, m.name, coalesce(max(u.depth), 0) as depth from nodes m left join nodes c on c.method_id = m.id left join up u on u.id = c.id where m.label = 'METHOD' group by 1, 2) select id, case when depth >= 3 or (depth >= 2 and name like 'buf\\_%' escape '\\') then 'hot' when depth >= 2 or name like 'buf\\_%' escape '\\' then 'warm' else 'cold' end as hotspot from dd")
def enrich_perf(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    io = F.col("name").startswith("buf_")
    df = loop_depths(g).join(of(g, "METHOD").select("id", "name"), "id")
    return df.select("id", F.when((F.col("loop_depth") >= 3) | ((F.col("loop_depth") >= 2) & io), "hot").when((F.col("loop_depth") >= 2) | io, "warm").otherwise("cold").alias("hotspot"))


_LAYERS = [("optimizer", "query-optimizer"), ("executor", "query-executor"), ("storage", "storage"), ("access", "access"), ("parser", "frontend"), ("tcop", "frontend"), ("catalog", "catalog"), ("port", "infrastructure"), ("utils", "infrastructure")]
_LAYER_SQL = "case " + " ".join(f"when contains(filename, '/{a}/') then '{b}'" for a, b in _LAYERS) + " else 'unknown' end"


@query(f"select id, {_LAYER_SQL} as layer from nodes where label = 'FILE'")
def enrich_layers(spark: SparkSession, d: str) -> DataFrame:
    return of(graph(spark, d), "FILE").select("id", first_rule(F.col("filename"), [(f"/{a}/", b) for a, b in _LAYERS], "unknown").alias("layer"))


@query(f"select {_LAYER_SQL} as layer, count(*) as files from nodes where label = 'FILE' group by 1")
def agg_layer_summary(spark: SparkSession, d: str) -> DataFrame:
    return enrich_layers(spark, d).groupBy("layer").agg(F.count(F.lit(1)).alias("files"))


@query("select id, list_slice(list_filter([case when contains(name, 'lock') then 'concurrency' end, case when contains(name, 'buf') then 'memory' end, case when contains(name, 'ring') then 'iteration' end, case when contains(name, 'test') then 'testing' end, case when contains(name, 'plan') then 'planning' end], lambda x: x is not null), 1, 2) as purposes from nodes where label = 'METHOD'")
def enrich_semantic(spark: SparkSession, d: str) -> DataFrame:
    rules = [("lock", "concurrency"), ("buf", "memory"), ("ring", "iteration"), ("test", "testing"), ("plan", "planning")]
    hits = F.array_compact(F.array(*[F.when(F.col("name").contains(t), v) for t, v in rules]))
    return of(graph(spark, d), "METHOD").select("id", F.slice(hits, 1, 2).alias("purposes"))


@query("select tag_name, tag_value, count(*) as n, count(distinct node_label) as kinds from tags group by 1, 2")
def export_tags(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).tags.groupBy("tag_name", "tag_value").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node_label").alias("kinds"))


@query("select id, label, coalesce(name, code, '') as name, coalesce(filename, '') as filename, coalesce(line_number, -1) as line from nodes")
def node_brief(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).nodes.select("id", "label", F.coalesce("name", "code", F.lit("")).alias("name"), F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("line_number", F.lit(-1)).alias("line"))


# ---- flow patterns


@query("select m.name as method, c.id, c.control_structure_type as kind, c.code as condition from nodes c join nodes m on m.id = c.method_id where c.label = 'CONTROL_STRUCTURE'")
def pat_control(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    methods = of(g, "METHOD").select(F.col("id").alias("method_id"), F.col("name").alias("method"))
    return of(g, "CONTROL_STRUCTURE").join(methods, "method_id").select("method", "id", F.col("control_structure_type").alias("kind"), F.col("code").alias("condition"))


@query("select id, case when contains(code, 'NULL') then 'NULL_CHECK' when regexp_matches(code, 'elog|ereport') then 'ERROR_LOG' else 'VALIDATION' end as kind from nodes where label = 'CONTROL_STRUCTURE' and control_structure_type = 'IF' and regexp_matches(code, '[=!]= NULL|elog|ereport')")
def pat_error(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("code")
    kind = F.when(c.contains("NULL"), "NULL_CHECK").when(c.rlike("elog|ereport"), "ERROR_LOG").otherwise("VALIDATION")
    return of(graph(spark, d), "CONTROL_STRUCTURE").where((F.col("control_structure_type") == "IF") & c.rlike("[=!]= NULL|elog|ereport")).select("id", kind.alias("kind"))


@query("select id, method_id, count(*) over (partition by method_id) as locks_in_method from nodes where label = 'CALL' and name like 'lock\\_%' escape '\\'")
def pat_lock(spark: SparkSession, d: str) -> DataFrame:
    locks = of(graph(spark, d), "CALL").where(F.col("name").startswith("lock_")).select("id", "method_id")
    return locks.join(locks.groupBy("method_id").agg(F.count(F.lit(1)).alias("locks_in_method")), "method_id")


@query("select id, name from nodes where label = 'CALL' and regexp_matches(name, '^(plan|xlog)_')")
def pat_txn(spark: SparkSession, d: str) -> DataFrame:
    return of(graph(spark, d), "CALL").where(F.col("name").rlike("^(plan|xlog)_")).select("id", "name")


@query("select m.id, case when count(c.id) < 5 then 'simple' when count(c.id) < 20 then 'moderate' else 'complex' end as level from nodes m left join nodes c on c.method_id = m.id and c.label = 'CONTROL_STRUCTURE' where m.label = 'METHOD' group by 1")
def pat_complexity(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    per = of(g, "CONTROL_STRUCTURE").groupBy(F.col("method_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return of(g, "METHOD").select("id").join(per, "id", "left").select("id", F.when(n < 5, "simple").when(n < 20, "moderate").otherwise("complex").alias("level"))


@query("select e.src as source, e.dst as target, e.variable, 'REASSIGNMENT' as kind from edges e where e.label = 'REACHING_DEF'")
def pat_var_chain(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).edges.where("label = 'REACHING_DEF'").select(F.col("src").alias("source"), F.col("dst").alias("target"), "variable", F.lit("REASSIGNMENT").alias("kind"))


@query("select c.id as site, i.name as argument from nodes c join edges e on e.src = c.id and e.label = 'ARGUMENT' join nodes i on i.id = e.dst where exists (select 1 from edges r where r.dst = i.id and r.label = 'REACHING_DEF')")
def pat_call_arg(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    names = of(g, "IDENTIFIER").select(F.col("id").alias("dst"), F.col("name").alias("argument"))
    sourced = g.edges.where("label = 'REACHING_DEF'").select("dst").distinct()
    return g.edges.where("label = 'ARGUMENT'").select("src", "dst").join(sourced, "dst", "left_semi").join(names, "dst").select(F.col("src").alias("site"), "argument")


@query("select e.src as id, count(*) as controlled, min_by(n.label, n.id) as first_label from edges e join nodes n on n.id = e.dst where e.label = 'CDG' group by 1")
def pat_ctrl_dep(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d)
    labels = g.nodes.select(F.col("id").alias("dst"), F.col("label").alias("to_label"))
    cdg = g.edges.where("label = 'CDG'").select("src", "dst").join(labels, "dst")
    return cdg.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("controlled"), F.min_by("to_label", "dst").alias("first_label"))


# ---- quality


@query("select sum(w)::bigint as score from (select 10 as w where (select count(*) from nodes where label = 'FILE') > 5 union all select 12 where (select count(distinct tag_name) from tags) >= 4 union all select 13 where exists (select 1 from tags where tag_name = 'arch-layer') union all select 8 where exists (select 1 from tags where tag_name = 'extension-point'))")
def agg_quality_score(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the checks that hold, from one row of counts."""
    g = graph(spark, d)
    files = of(g, "FILE").agg(F.count(F.lit(1)).alias("files"))
    names = g.tags.agg(F.countDistinct("tag_name").alias("names"), F.count_if(F.col("tag_name") == "arch-layer").alias("layers"), F.count_if(F.col("tag_name") == "extension-point").alias("points"))
    n = names.withColumn("files", files.scalar())
    score = F.when(F.col("files") > 5, 10).otherwise(0) + F.when(F.col("names") >= 4, 12).otherwise(0) + F.when(F.col("layers") > 0, 13).otherwise(0) + F.when(F.col("points") > 0, 8).otherwise(0)
    return n.select(score.cast("bigint").alias("score"))
