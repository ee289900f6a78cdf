"""Queries in the traversal language, one for every group of its productions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.traversal import Traverser
from graphloom.sources.standin import SQL, graph

_IDS = "select n.id from "
#: key: (traversal, columns kept or renamed, SQL after the graph's table expressions)
TRAVERSALS: dict[str, tuple[str, dict[str, str], str]] = {
    "trav_scan": ("cpg.method.l", {"id": "id", "name": "name"}, "select id, name from nodes where label = 'METHOD'"),
    "trav_cs": ("cpg.switch.l", {"id": "id"}, "select id from nodes where control_structure_type = 'SWITCH'"),
    "trav_prop": ('cpg.method.name("lock_.*").name.l', {"value": "value"}, "select name as value from nodes where label = 'METHOD' and regexp_full_match(name, 'lock_.*')"),
    "trav_prop_exact": ('cpg.controlStructure.codeExactNot("flag", "ptr == NULL").id.l', {"value": "value"}, "select id as value from nodes where label = 'CONTROL_STRUCTURE' and code not in ('flag', 'ptr == NULL')"),
    "trav_filter": ('cpg.method.filter(m => m.lineNumber > 1000 && m.name.startsWith("buf_")).filterNot(_.name.endsWith("1")).l', {"id": "id"}, "select id from nodes where label = 'METHOD' and line_number > 1000 and starts_with(name, 'buf_') and not suffix(name, '1')"),
    "trav_where": ('cpg.method.where(_.tag.nameExact("risk-severity").valueExact("high")).whereNot(_.callOut).l', {"id": "id"}, "select id from nodes n where label = 'METHOD' and exists (select 1 from tags where node_id = n.id and tag_name = 'risk-severity' and tag_value = 'high') and not exists (select 1 from edges e join nodes c on c.id = e.dst where e.src = n.id and e.label = 'CONTAINS' and c.label = 'CALL')"),
    "trav_where_bool": ('cpg.tag.nameExact("cyclomatic-complexity").filter(_.value.toInt > 15).l', {"node_id": "node_id", "tag_value": "tag_value"}, "select node_id, tag_value from tags where tag_name = 'cyclomatic-complexity' and try_cast(tag_value as int) > 15"),
    "trav_andor": ('cpg.method.and(_.tag.valueExact("storage"), _.callOut).or(_.name("heap_.*"), _.name("xlog_.*")).l', {"id": "id"}, "select id from nodes n where label = 'METHOD' and exists (select 1 from tags where node_id = n.id and tag_value = 'storage') and exists (select 1 from edges e where e.src = n.id and e.label = 'CONTAINS' and e.dst between 2000000000 and 2999999999) and (name like 'heap\\_%' escape '\\' or name like 'xlog\\_%' escape '\\')"),
    "trav_map": ("cpg.method.map(m => m.name.toUpperCase).l", {"value": "value"}, "select upper(name) as value from nodes where label = 'METHOD'"),
    "trav_repeat": ('cpg.method.nameExact("buf_small_ring_0", "heap_small_ring_0", "lock_small_ring_0").repeat(_.callee)(_.emit.times(2)).id.l', {"value": "value"}, ""),
    "trav_dedup": ("cpg.call.callee.dedup.l", {"id": "id"}, ""),
    "trav_callee": ('cpg.method.name("test_.*").callee.id.l', {"value": "value"}, "select c.dst as value from nodes n join edges e on e.src = n.id and e.label = 'CONTAINS' join edges c on c.src = e.dst and c.label = 'CALL' where n.label = 'METHOD' and n.name like 'test\\_%' escape '\\'"),
    "trav_caller": ('cpg.method.name("test_.*").caller.dedup.id.l', {"value": "value"}, "select distinct e.src as value from nodes n join edges c on c.dst = n.id and c.label = 'CALL' join edges e on e.dst = c.src and e.label = 'CONTAINS' where n.label = 'METHOD' and n.name like 'test\\_%' escape '\\'"),
    "trav_callio": ('cpg.method.name("plan_.*").callIn.id.l', {"value": "value"}, "select c.src as value from nodes n join edges c on c.dst = n.id and c.label = 'CALL' where n.label = 'METHOD' and n.name like 'plan\\_%' escape '\\'"),
    "trav_arg": ("cpg.call.argument.name.l", {"value": "value"}, "select i.name as value from edges e join nodes i on i.id = e.dst where e.label = 'ARGUMENT'"),
    "trav_ast": ('cpg.controlStructure.code("flag").ast.isControlStructure.id.l', {"value": "value"}, "select distinct id as value from (select id from nodes where code = 'flag' union all select e.dst from nodes n join edges e on e.src = n.id and e.label = 'AST' where n.code = 'flag' union all select f.dst from nodes n join edges e on e.src = n.id and e.label = 'AST' join edges f on f.src = e.dst and f.label = 'AST' where n.code = 'flag') where id >= 3000000000 and id < 4000000000"),
    "trav_is": ("cpg.all.isIdentifier.id.l", {"value": "value"}, "select id as value from nodes where label = 'IDENTIFIER'"),
    "trav_cdg": ('cpg.controlStructure.code("ptr == NULL").controls.id.l', {"value": "value"}, "select n2.id as value from nodes n join edges e on e.src = n.id and e.label = 'CDG' join nodes n2 on n2.id = e.dst where n.code = 'ptr == NULL'"),
    "trav_cdg_not": ('cpg.call.notControlledBy("flag|i < n.*").size', {"size": "size"}, "select count(*) as size from nodes n where label = 'CALL' and not exists (select 1 from edges e join nodes c on c.id = e.src where e.dst = n.id and e.label = 'CDG' and regexp_full_match(c.code, 'flag|i < n.*'))"),
    "trav_reach": ('cpg.identifier.name("v_machinery").reachableBy(cpg.identifier.name("v_building")).id.l', {"value": "value"}, ""),
    "trav_flows": ('cpg.identifier.name("v_machinery").reachableByFlows(cpg.identifier.name("v_building")).l', {"src": "src", "dst": "dst", "path": "path"}, ""),
    "trav_vis": ("cpg.method.isStatic.name.l", {"value": "value"}, "select name as value from nodes where label = 'METHOD' and is_static"),
    "trav_tag_write": ('cpg.method.name("lock_.*").newTagNodePair("concurrency", "lock").store', {"node_id": "node_id", "tag_name": "tag_name", "tag_value": "tag_value"}, "select id as node_id, 'concurrency' as tag_name, 'lock' as tag_value from nodes where label = 'METHOD' and name like 'lock\\_%' escape '\\'"),
    "trav_exec": ("cpg.controlStructure.size", {"size": "size"}, "select count(*) as size from nodes where label = 'CONTROL_STRUCTURE'"),
    "trav_expr": ('cpg.method.filter(m => (m.order == 1 || m.lineNumber <= 41) && !m.name.contains("bolt")).name.l', {"value": "value"}, "select name as value from nodes where label = 'METHOD' and line_number <= 41 and not contains(name, 'bolt')"),
    "trav_taglist": ('cpg.method.name("plan_.*").tagList.valueExact("high").l', {"node_id": "node_id", "tag_name": "tag_name"}, "select t.node_id, t.tag_name from tags t join nodes n on n.id = t.node_id where n.label = 'METHOD' and n.name like 'plan\\_%' escape '\\' and t.tag_value = 'high'"),
}
_HOPS = "pairs as (select e.src as m, c.dst as k from edges e join edges c on c.src = e.dst and c.label = 'CALL' where e.label = 'CONTAINS' and e.src >= 1000000000)"
_REACH = "walk as (select id as src, id as dst, [id] as path from nodes where name = 'v_building' union all select w.src, e.dst, list_append(w.path, e.dst) from walk w join edges e on e.src = w.dst and e.label = 'REACHING_DEF' where not list_contains(w.path, e.dst))"
_SPECIAL = {
    "trav_repeat": f"{SQL}, {_HOPS}, s as (select id from nodes where name in ('buf_small_ring_0', 'heap_small_ring_0', 'lock_small_ring_0')), a as (select distinct k from pairs where m in (select id from s)), b as (select distinct k from pairs where m in (select k from a)) select k as value from a union select k from b",
    "trav_reach": f"{SQL}, {_REACH} select distinct w.dst as value from walk w join nodes n on n.id = w.dst where len(path) > 1 and n.name = 'v_machinery'",
    "trav_flows": f"{SQL}, {_REACH} select w.src, w.dst, w.path from walk w join nodes n on n.id = w.dst where len(path) > 1 and n.name = 'v_machinery'",
}


def _query(text: str, columns: dict[str, str]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Traverser(graph(spark, d)).run(text).select(*[F.col(k).alias(v) for k, v in columns.items()])

    return run


def trav_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Callees of all methods, once each."""
    return Traverser(graph(spark, d)).run("cpg.method.callee.dedup.l").select("id")


QUERIES = {k: _query(text, columns) for k, (text, columns, _) in TRAVERSALS.items()} | {"trav_dedup": trav_dedup}
ORACLES = {k: SQL + sql for k, (_, _, sql) in TRAVERSALS.items() if sql} | _SPECIAL
ORACLES["trav_dedup"] = SQL + "select distinct dst as id from edges where label = 'CALL'"
