"""A code property graph drawn from the star-schema tables: suppliers are files, parts methods, orders
call sites, events control structures, customers identifiers. Node ids of the kinds lie a billion apart."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import checkpoint_root, table

METHOD, CALL, CONTROL, IDENTIFIER = 1_000_000_000, 2_000_000_000, 3_000_000_000, 4_000_000_000
DIRECTORIES = ["optimizer", "storage", "executor", "access", "parser", "utils", "commands", "tcop", "catalog", "port"]
PREFIXES = {"STANDARD": "heap_", "ECONOMY": "buf_", "MEDIUM": "lock_", "PROMO": "plan_", "LARGE": "xlog_", "SMALL": "test_"}
CONTROLS = {"click": "IF", "error": "FOR", "view": "WHILE", "signup": "SWITCH", "purchase": "DO"}
CONDITIONS = ["ptr == NULL", "i < n && ok", "elog(ERROR)", "flag", "x != NULL || y"]


@dataclass
class Graph:
    """``nodes`` (id, label, name, code, filename, line_number, line_number_end, control_structure_type,
    order, is_static, signature_size, method_id), ``edges`` (src, dst, label, variable) and ``tags``
    (node_id, node_label, tag_name, tag_value)."""

    nodes: DataFrame
    edges: DataFrame
    tags: DataFrame


def _pick(values: list[str], index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


_STORED: dict[tuple[str, str], str] = {}


def graph(spark: SparkSession, d: str) -> Graph:
    """The graph of a data folder. It is drawn once a session and written to the shared folder with nodes and edges
    apart by label, so a step reads only the kinds it asks for."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        g, root = drawn(spark, d), f"{checkpoint_root(spark)}/graph-{uuid.uuid4().hex}"
        g.nodes.write.partitionBy("label").parquet(f"{root}/nodes")
        g.edges.write.partitionBy("label").parquet(f"{root}/edges")
        g.tags.write.parquet(f"{root}/tags")
        _STORED[key] = root
    read = lambda name, columns: spark.read.parquet(f"{_STORED[key]}/{name}").select(*columns)
    return Graph(read("nodes", COLUMNS), read("edges", ["src", "dst", "label", "variable"]), read("tags", ["node_id", "node_label", "tag_name", "tag_value"]))


COLUMNS = ["id", "label", "name", "code", "filename", "line_number", "line_number_end", "control_structure_type", "order", "is_static", "signature_size", "method_id"]


def drawn(spark: SparkSession, d: str) -> Graph:
    """The graph as plans over the tables."""
    supplier, part, orders, events, customer = (table(spark, d, t) for t in ("supplier", "part", "orders", "events", "customer"))
    null = lambda kind: F.lit(None).cast(kind)
    path = lambda k: F.concat(F.lit("src/backend/"), _pick(DIRECTORIES, k % 10), F.lit("/f"), k.cast("string"), F.lit(".c"))
    key = F.col("s_suppkey")
    files = supplier.select(
        key.alias("id"), F.lit("FILE").alias("label"), path(key).alias("name"), null("string").alias("code"), path(key).alias("filename"), null("int").alias("line_number"), null("int").alias("line_number_end"),
        null("string").alias("control_structure_type"), null("int").alias("order"), F.lit(False).alias("is_static"), null("int").alias("signature_size"), null("bigint").alias("method_id"),
    )
    prefix = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    method_name = F.concat(prefix[F.col("p_type")], F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"))
    file_key = (F.col("p_size") % 10).cast("bigint")
    start = ((F.col("p_partkey") % 50) * 40 + 1).cast("int")
    methods = part.select(
        (F.col("p_partkey") + METHOD).alias("id"), F.lit("METHOD").alias("label"), method_name.alias("name"), F.concat(F.when(F.col("p_partkey") % 4 == 0, "static int ").otherwise("int "), method_name, F.lit("(void)")).alias("code"),
        path(file_key).alias("filename"), start.alias("line_number"), (start + F.col("p_size") * 3).alias("line_number_end"), null("string").alias("control_structure_type"), null("int").alias("order"),
        (F.col("p_partkey") % 4 == 0).alias("is_static"), (F.col("p_size") % 9).alias("signature_size"), null("bigint").alias("method_id"),
    )
    callee = ((F.col("o_custkey") * 31 + F.col("o_orderkey")) % 150).alias("callee")
    names = part.select((F.col("p_partkey")).alias("callee"), method_name.alias("callee_name"), file_key.alias("f"))
    called = orders.select("o_orderkey", "o_custkey", callee).join(names, "callee")
    owner = part.select(F.col("p_partkey").alias("o_custkey"), path(file_key).alias("owner_file"))
    calls = called.join(owner, "o_custkey").select(
        (F.col("o_orderkey") + CALL).alias("id"), F.lit("CALL").alias("label"), F.col("callee_name").alias("name"), F.concat("callee_name", F.lit("(v)")).alias("code"), F.col("owner_file").alias("filename"),
        (F.col("o_orderkey") % 200 + 10).cast("int").alias("line_number"), null("int").alias("line_number_end"), null("string").alias("control_structure_type"), (F.col("o_orderkey") % 7).cast("int").alias("order"),
        F.lit(False).alias("is_static"), null("int").alias("signature_size"), (F.col("o_custkey") + METHOD).alias("method_id"),
    )
    kinds = F.create_map(*[F.lit(x) for kv in CONTROLS.items() for x in kv])
    controls = events.select(
        (F.col("event_id") + CONTROL).alias("id"), F.lit("CONTROL_STRUCTURE").alias("label"), null("string").alias("name"), _pick(CONDITIONS, F.col("event_id") % 5).alias("code"), null("string").alias("filename"),
        (F.col("event_id") % 200 + 10).cast("int").alias("line_number"), (F.col("event_id") % 200 + 10 + F.col("event_id") % 13).cast("int").alias("line_number_end"), kinds[F.col("event_type")].alias("control_structure_type"),
        (F.col("event_id") % 5).cast("int").alias("order"), F.lit(False).alias("is_static"), null("int").alias("signature_size"), (F.col("user_id") + METHOD).alias("method_id"),
    )
    identifiers = customer.select(
        (F.col("c_custkey") + IDENTIFIER).alias("id"), F.lit("IDENTIFIER").alias("label"), F.concat(F.lit("v_"), F.lower("c_mktsegment")).alias("name"), F.concat(F.lit("v_"), F.lower("c_mktsegment")).alias("code"), null("string").alias("filename"),
        (F.col("c_custkey") % 90 + 10).cast("int").alias("line_number"), null("int").alias("line_number_end"), null("string").alias("control_structure_type"), (F.col("c_custkey") % 3).cast("int").alias("order"),
        F.lit(False).alias("is_static"), null("int").alias("signature_size"), (F.col("c_custkey") + METHOD).alias("method_id"),
    )
    nodes = files
    for other in (methods, calls, controls, identifiers):
        nodes = nodes.unionByName(other.select(COLUMNS))
    edge = lambda df, src, dst, label, variable=None: df.select(src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"), F.lit(label).alias("label"), (variable if variable is not None else null("string")).alias("variable"))
    cs, ev = F.col("event_id") + CONTROL, F.col("event_id")
    edges = edge(part, file_key, F.col("p_partkey") + METHOD, "CONTAINS")
    for e in (
        edge(orders, F.col("o_custkey") + METHOD, F.col("o_orderkey") + CALL, "CONTAINS"),
        edge(orders.withColumn("callee", callee), F.col("o_orderkey") + CALL, F.col("callee") + METHOD, "CALL"),
        edge(orders, F.col("o_orderkey") + CALL, F.col("o_custkey") + IDENTIFIER, "ARGUMENT"),
        edge(events, F.col("user_id") + METHOD, cs, "CONTAINS"),
        edge(events, F.when(ev % 7 == 0, F.col("user_id") + METHOD).otherwise(ev - ev % 7 + CONTROL), cs, "AST"),
        edge(events.where(ev % 3 == 0), cs, ev + CALL, "CDG"),
        edge(customer.where(F.col("c_custkey") % 4 != 0), F.col("c_custkey") + IDENTIFIER, F.col("c_custkey") + IDENTIFIER + 1, "REACHING_DEF", F.concat(F.lit("v_"), F.lower("c_mktsegment"))),
    ):
        edges = edges.unionByName(e)
    pair = lambda name, value: F.struct(F.lit(name).alias("tag_name"), value.cast("string").alias("tag_value"))
    risk = F.when(F.col("p_retailprice") > 1000, "critical").when(F.col("p_retailprice") > 950, "high").otherwise("low")
    tags = part.select((F.col("p_partkey") + METHOD).alias("node_id"), F.lit("METHOD").alias("node_label"), F.explode(F.array(
        pair("arch-layer", _pick(DIRECTORIES, file_key)), pair("brand", F.col("p_brand")), pair("risk-severity", risk), pair("cyclomatic-complexity", F.col("p_size")),
    )).alias("t")).select("node_id", "node_label", "t.tag_name", "t.tag_value")
    return Graph(nodes, edges, tags)


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_CASE = lambda column, mapping: f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items()) + " end"
_MNAME = f"({_CASE('p_type', PREFIXES)}) || replace(p_name, ' ', '_') || '_' || p_partkey"
_PATH = "'src/backend/' || {dirs}[({k}) % 10 + 1] || '/f' || ({k}) || '.c'"
_DIRS = _LIST(DIRECTORIES)
#: The same graph for DuckDB: common table expressions to put before a query.
SQL = f"""
with recursive m0 as (select p_partkey as k, {_MNAME} as name, {_PATH.format(dirs=_DIRS, k='p_size % 10')} as filename, p_size % 10 as f, (p_partkey % 50) * 40 + 1 as ls, p_size, p_brand, p_retailprice from part),
nodes as (
  select s_suppkey as id, 'FILE' as label, {_PATH.format(dirs=_DIRS, k='s_suppkey')} as name, null::varchar as code, {_PATH.format(dirs=_DIRS, k='s_suppkey')} as filename, null::int as line_number, null::int as line_number_end, null::varchar as control_structure_type, null::int as ord, false as is_static, null::int as signature_size, null::bigint as method_id from supplier
  union all select k + {METHOD}, 'METHOD', name, case when k % 4 = 0 then 'static int ' else 'int ' end || name || '(void)', filename, ls, ls + p_size * 3, null, null, k % 4 = 0, p_size % 9, null from m0
  union all select o_orderkey + {CALL}, 'CALL', c.name, c.name || '(v)', o.filename, o_orderkey % 200 + 10, null, null, o_orderkey % 7, false, null, o_custkey + {METHOD} from orders join m0 c on c.k = (o_custkey * 31 + o_orderkey) % 150 join m0 o on o.k = o_custkey
  union all select event_id + {CONTROL}, 'CONTROL_STRUCTURE', null, {_LIST(CONDITIONS)}[event_id % 5 + 1], null, event_id % 200 + 10, event_id % 200 + 10 + event_id % 13, {_CASE('event_type', CONTROLS)}, event_id % 5, false, null, user_id + {METHOD} from events
  union all select c_custkey + {IDENTIFIER}, 'IDENTIFIER', 'v_' || lower(c_mktsegment), 'v_' || lower(c_mktsegment), null, c_custkey % 90 + 10, null, null, c_custkey % 3, false, null, c_custkey + {METHOD} from customer),
edges as (
  select p_size % 10 as src, p_partkey + {METHOD} as dst, 'CONTAINS' as label, null::varchar as variable from part
  union all select o_custkey + {METHOD}, o_orderkey + {CALL}, 'CONTAINS', null from orders
  union all select o_orderkey + {CALL}, (o_custkey * 31 + o_orderkey) % 150 + {METHOD}, 'CALL', null from orders
  union all select o_orderkey + {CALL}, o_custkey + {IDENTIFIER}, 'ARGUMENT', null from orders
  union all select user_id + {METHOD}, event_id + {CONTROL}, 'CONTAINS', null from events
  union all select case when event_id % 7 = 0 then user_id + {METHOD} else event_id - event_id % 7 + {CONTROL} end, event_id + {CONTROL}, 'AST', null from events
  union all select event_id + {CONTROL}, event_id + {CALL}, 'CDG', null from events where event_id % 3 = 0
  union all select c_custkey + {IDENTIFIER}, c_custkey + {IDENTIFIER} + 1, 'REACHING_DEF', 'v_' || lower(c_mktsegment) from customer where c_custkey % 4 <> 0),
tags as (
  select k + {METHOD} as node_id, 'METHOD' as node_label, 'arch-layer' as tag_name, {_DIRS}[f + 1] as tag_value from m0
  union all select k + {METHOD}, 'METHOD', 'brand', p_brand from m0
  union all select k + {METHOD}, 'METHOD', 'risk-severity', case when p_retailprice > 1000 then 'critical' when p_retailprice > 950 then 'high' else 'low' end from m0
  union all select k + {METHOD}, 'METHOD', 'cyclomatic-complexity', p_size::varchar from m0)
"""
