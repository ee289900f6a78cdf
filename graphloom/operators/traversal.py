"""The chained traversal language, compiled to DataFrame plans.

``Traverser(graph).run("cpg.method.where(_.tag.nameExact(\\"brand\\")).caller.name.dedup.l")`` parses the
chain by recursive descent and turns each step into a filter, a semi- or anti-join, or an edge join;
Catalyst then sees one plan. Where the published grammar is too narrow (a dot before the last
directive, ``take``, modifiers after ``repeat`` as one chain) the parser takes both forms.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize
from graphloom.sources.standin import Graph

LABELS = {
    "block": "BLOCK", "call": "CALL", "comment": "COMMENT", "controlStructure": "CONTROL_STRUCTURE", "file": "FILE", "identifier": "IDENTIFIER", "literal": "LITERAL", "local": "LOCAL",
    "member": "MEMBER", "metaData": "META_DATA", "method": "METHOD", "methodRef": "METHOD_REF", "methodReturn": "METHOD_RETURN", "modifier": "MODIFIER", "namespace": "NAMESPACE",
    "namespaceBlock": "NAMESPACE_BLOCK", "parameter": "METHOD_PARAMETER_IN", "returns": "RETURN", "typeDecl": "TYPE_DECL", "typ": "TYPE",
}
CONTROL_STEPS = {"break": "BREAK", "continue": "CONTINUE", "ifBlock": "IF", "elseBlock": "ELSE", "switch": "SWITCH", "case": "CASE", "forBlock": "FOR", "whileBlock": "WHILE", "doBlock": "DO"}
PROPERTIES = {
    "code": "code", "name": "name", "fullName": "name", "signature": "code", "label": "label", "id": "id", "lineNumber": "line_number", "lineNumberEnd": "line_number_end", "order": "order",
    "argumentIndex": "order", "controlStructureType": "control_structure_type", "filename": "filename", "value": "tag_value",
}
NARROW = {"isCall": "CALL", "isLiteral": "LITERAL", "isIdentifier": "IDENTIFIER", "isControlStructure": "CONTROL_STRUCTURE", "isReturn": "RETURN", "isMethod": "METHOD", "isFile": "FILE"}
EXECUTION = {"toList", "l", "toJson", "toJsonPretty", "p", "browse", "head", "size", "count", "help"}
IDENTITY = {"sideEffect", "clone", "start", "push", "pop"}


class TraversalError(ValueError):
    """The text is not a traversal."""


@dataclass
class Step:
    name: str
    args: list = field(default_factory=list)
    called: bool = False


@dataclass
class Chain:
    root: str
    steps: list[Step]


_TOKENS = re.compile(r"\s*(?:(\"[^\"\n]*\")|(\d+)|([A-Za-z_]\w*)|(=>|==|!=|<=|>=|&&|\|\||[().,<>!]))")


def tokenize(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise TraversalError(f"unexpected {text[at:at + 12]!r} at {at}")
        out.append(m[0].strip())
        at = m.end()
    return out


class Parser:
    """Recursive descent over chains, lambdas and boolean expressions."""

    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ""

    def take(self, expected: str | None = None) -> str:
        token = self.peek()
        if not token or (expected and token != expected):
            raise TraversalError(f"expected {expected or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def query(self) -> Chain:
        chain = self.chain()
        if self.peek():
            raise TraversalError(f"unexpected {self.peek()!r}")
        if chain.root != "cpg":
            raise TraversalError("a traversal starts with cpg")
        return chain

    def chain(self) -> Chain:
        root = self.take()
        steps = []
        while self.peek() == "." or (self.peek() in EXECUTION and steps):
            if self.peek() == ".":
                self.take()
            name = self.take()
            if not re.match(r"[A-Za-z_]\w*$", name):
                raise TraversalError(f"{name!r} is no step")
            step = Step(name)
            while self.peek() == "(":
                self.take()
                step.called = True
                group = []
                while self.peek() != ")":
                    group.append(self.expression())
                    if self.peek() == ",":
                        self.take()
                self.take(")")
                step.args.append(group)
            steps.append(step)
        return Chain(root, steps)

    def expression(self):
        left = self.conjunction()
        while self.peek() == "||":
            self.take()
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self):
        left = self.comparison()
        while self.peek() == "&&":
            self.take()
            left = ("and", left, self.comparison())
        return left

    def comparison(self):
        left = self.operand()
        if self.peek() in ("==", "!=", "<", ">", "<=", ">="):
            return ("cmp", self.take(), left, self.operand())
        return left

    def operand(self):
        token = self.peek()
        if token.startswith('"'):
            return self.take()[1:-1]
        if token.isdigit():
            return int(self.take())
        if token == "!":
            self.take()
            return ("not", self.operand())
        if token == "(":
            self.take()
            inner = self.expression()
            self.take(")")
            return inner
        if self.peek(1) == "=>":
            name = self.take()
            self.take("=>")
            return ("lambda", name, self.expression())
        if not re.match(r"[A-Za-z_]", token):
            raise TraversalError(f"unexpected {token or 'end'!r}")
        return self.chain()


def parse(text: str) -> Chain:
    return Parser(text).query()


class Traverser:
    """Runs chains on a graph. Duplicates are kept until ``dedup``, as the language wants."""

    def __init__(self, graph: Graph, max_depth: int = 10):
        self.nodes, self.edges, self.tags, self.max_depth = graph.nodes, graph.edges, graph.tags, max_depth

    def run(self, text: str) -> DataFrame:
        chain = parse(text)
        return self.apply(None, chain.steps)

    # ---- steps

    def apply(self, df: DataFrame | None, steps: list[Step]) -> DataFrame:
        i = 0
        while i < len(steps):
            step = steps[i]
            if step.name == "repeat":
                modifiers, j = [], i + 1
                while j < len(steps) and steps[j].name in ("emit", "until", "maxDepth", "times"):
                    modifiers.append(steps[j])
                    j += 1
                df = self.repeat(df, step, modifiers)
                i = j
                continue
            df = self.step(df, step)
            i += 1
        return self.nodes if df is None else df

    def step(self, df: DataFrame | None, step: Step) -> DataFrame:
        name, args = step.name, step.args[0] if step.args else []
        if df is None:
            if name == "all":
                return self.nodes
            if name == "tag":
                return self.tags
            if name in LABELS:
                out = self.nodes.where(F.col("label") == LABELS[name])
                return self.named(out, "name", args) if args else out
            if name in CONTROL_STEPS:
                return self.nodes.where(F.col("control_structure_type") == CONTROL_STEPS[name])
            raise TraversalError(f"{name} does not start a traversal")
        base = re.sub(r"(?:ExactNot|Exact|Not)$", "", name)
        if base in PROPERTIES and self.has(df, PROPERTIES[base]) or base == "name" and "tag_name" in df.columns:
            column = "tag_name" if base == "name" and "tag_name" in df.columns else PROPERTIES[base]
            return self.property(df, column, name[len(base) :], args, step.called and bool(args))
        if name in ("filter", "filterNot"):
            condition = self.predicate(df, args[0])
            return df.where(condition if name == "filter" else ~F.coalesce(condition, F.lit(False)))
        if name in ("where", "whereNot"):
            return self.where(df, args[0], name == "whereNot")
        if name in ("and", "or"):
            return self.combine(df, name, args)
        if name == "map":
            return df.select(self.value(df, args[0]).alias("value"))
        if name in IDENTITY:
            return df
        if name == "dedup":
            return df.dropDuplicates(["id"] if "id" in df.columns else df.columns)
        if name in ("internal", "external"):
            return df.where(F.lit(name == "internal"))
        if name == "take":
            return df.limit(int(args[0]))
        if name in ("head",):
            return df.limit(1)
        if name in ("size", "count"):
            return df.agg(F.count(F.lit(1)).alias("size"))
        if name in ("toJson", "toJsonPretty"):
            return df.select(F.to_json(F.struct("*")).alias("json"))
        if name in ("toList", "l", "p", "browse"):
            return df
        if name in ("tag", "tagList"):
            return self.tags.join(df.select(F.col("id").alias("node_id")), "node_id")
        if name == "location":
            return df.select("id", F.struct("filename", "line_number").alias("location"))
        if name == "callee":
            return self.out(self.out(self.narrowed(self.out(df, "CONTAINS"), "CALL"), "CALL"), None)
        if name == "caller":
            return self.back(self.narrowed(self.back(df, "CALL"), "CALL"), "CONTAINS")
        if name == "callOut":
            return self.narrowed(self.out(df, "CONTAINS"), "CALL")
        if name == "callIn":
            return self.narrowed(self.back(df, "CALL"), "CALL")
        if name == "argument":
            return self.out(df, "ARGUMENT")
        if name == "astChildren":
            return self.out(df, "AST")
        if name == "astParent":
            return self.back(df, "AST")
        if name == "ast":
            return self.closure(df, "AST", forward=True, include=True)
        if name in NARROW:
            return self.narrowed(df, NARROW[name])
        if name == "controls":
            return self.out(df, "CDG")
        if name == "controlledBy":
            return self.back(df, "CDG")
        if name == "notControlledBy":
            controlled = self.edges.where(F.col("label") == "CDG")
            if args:
                why = self.nodes.where(F.col("code").rlike(f"^(?:{args[0]})$")).select(F.col("id").alias("src"))
                controlled = controlled.join(why, "src", "left_semi")
            return df.join(controlled.select(F.col("dst").alias("id")), "id", "left_anti")
        if name in ("dominates", "dominatedBy", "postDominates", "postDominatedBy"):
            edge = "POST_DOMINATE" if name.startswith("post") else "DOMINATE"
            return self.closure(df, edge, forward=name.endswith("ates"), include=False)
        if name in ("reachableBy", "reachableByFlows"):
            sources = self.sub(args[0])
            flows = self.flows(sources, df)
            if name == "reachableByFlows":
                return flows
            return df.join(flows.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        if name in ("isStatic",):
            return df.where("is_static")
        if name in ("isPublic", "isPrivate", "isProtected", "isVirtual"):
            modifier = name[2:].upper()
            have = self.narrowed(self.out(df, "AST"), "MODIFIER").where(F.col("name") == modifier)
            return df.join(self.edges.where(F.col("label") == "AST").join(have.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")), "id", "left_semi")
        if name == "newTagNode":
            return df.select(F.col("id").alias("node_id"), F.col("label").alias("node_label"), F.lit(args[0]).alias("tag_name"), F.lit("").alias("tag_value"))
        if name == "newTagNodePair":
            return df.select(F.col("id").alias("node_id"), F.col("label").alias("node_label"), F.lit(args[0]).alias("tag_name"), F.lit(args[1]).alias("tag_value"))
        if name == "store":
            return df.distinct().join(self.tags, ["node_id", "tag_name", "tag_value"], "left_anti").select("node_id", "node_label", "tag_name", "tag_value")
        if name in LABELS:
            # mid-chain: elements contained in the current ones, or their owner
            label = LABELS[name]
            if label in ("METHOD", "FILE"):
                up = self.back(df, "CONTAINS")
                return up if label == "METHOD" else self.back(up.where(F.col("label") == "METHOD"), "CONTAINS").unionByName(up.where(F.col("label") == "FILE"))
            return self.narrowed(self.out(df, "CONTAINS"), label)
        if name in CONTROL_STEPS:
            return self.narrowed(self.out(df, "CONTAINS"), "CONTROL_STRUCTURE").where(F.col("control_structure_type") == CONTROL_STEPS[name])
        raise TraversalError(f"unknown step {name}")

    @staticmethod
    def has(df: DataFrame, column: str) -> bool:
        return column in df.columns

    @staticmethod
    def named(df: DataFrame, column: str, args: list) -> DataFrame:
        return df.where(F.col(column).rlike(f"^(?:{args[0]})$"))

    def property(self, df: DataFrame, column: str, modifier: str, args: list, filtering: bool) -> DataFrame:
        c = F.col(column)
        if not filtering:
            return df.select(c.alias("value"))
        if isinstance(args[0], int):
            hit = c.isin([int(a) for a in args])
        elif modifier.startswith("Exact"):
            hit = c.isin([str(a) for a in args])
        else:
            hit = c.cast("string").rlike("|".join(f"^(?:{a})$" for a in args))
        return df.where(~hit if modifier.endswith("Not") else hit)

    def narrowed(self, df: DataFrame, label: str) -> DataFrame:
        return df.where(F.col("label") == label)

    def out(self, df: DataFrame, edge: str | None) -> DataFrame:
        if edge is None:
            return df
        e = self.edges.where(F.col("label") == edge).select("src", "dst")
        ids = df.select(F.col("id").alias("src")).join(e, "src").select(F.col("dst").alias("id"))
        return ids.join(self.nodes, "id")

    def back(self, df: DataFrame, edge: str) -> DataFrame:
        e = self.edges.where(F.col("label") == edge).select("src", "dst")
        ids = df.select(F.col("id").alias("dst")).join(e, "dst").select(F.col("src").alias("id"))
        return ids.join(self.nodes, "id")

    def sub(self, arg) -> DataFrame:
        if isinstance(arg, Chain):
            return self.apply(None, arg.steps)
        raise TraversalError("a traversal is expected")

    def where(self, df: DataFrame, arg, negated: bool) -> DataFrame:
        if isinstance(arg, tuple) and arg[0] == "lambda":
            arg = arg[2]
        key = "id" if "id" in df.columns else "node_id"
        hit = self.reached(df, arg, key)
        return df.join(hit, key, "left_anti" if negated else "left_semi")

    def reached(self, df: DataFrame, arg, key: str) -> DataFrame:
        """Keys of the elements for which a sub-traversal gives something or a predicate holds."""
        if not isinstance(arg, Chain):
            return df.where(self.predicate(df, arg)).select(key).distinct()
        # the start of every element is carried along the chain as its own column
        return self.carried(df.select(F.col(key).alias("_start"), "*"), arg.steps).select(F.col("_start").alias(key)).distinct()

    def carried(self, df: DataFrame, steps: list[Step]) -> DataFrame:
        for step in steps:
            start = df.select("_start", *[c for c in df.columns if c != "_start"])
            key = "id" if "id" in df.columns else "node_id"
            if step.name in {"name", "nameExact", "code", "valueExact", "value", "filter", "isStatic", "lineNumber", "nameNot", "signature"} or step.name in NARROW:
                df = self.step(start, step)
                continue
            seeds = start.select(key).distinct()
            inner = self.apply_pairs(seeds, step, key)
            df = start.select("_start", F.col(key).alias("_from")).join(inner, "_from").drop("_from")
        return df

    def apply_pairs(self, seeds: DataFrame, step: Step, key: str) -> DataFrame:
        """(_from, reached element) of one step from each seed."""
        seeds = seeds.select(F.col(key).alias("_from"))
        e = lambda label: self.edges.where(F.col("label") == label).select("src", "dst")
        forward = lambda df, label: df.join(e(label), df["_at"] == F.col("src")).select("_from", F.col("dst").alias("_at"))
        backward = lambda df, label: df.join(e(label), df["_at"] == F.col("dst")).select("_from", F.col("src").alias("_at"))
        start = seeds.withColumn("_at", F.col("_from"))
        name = step.name
        if name in ("tag", "tagList"):
            return self.tags.join(seeds, F.col("node_id") == F.col("_from"))
        hops = {
            "callOut": [(forward, "CONTAINS")], "call": [(forward, "CONTAINS")], "callee": [(forward, "CONTAINS"), (forward, "CALL")], "caller": [(backward, "CALL"), (backward, "CONTAINS")],
            "callIn": [(backward, "CALL")], "argument": [(forward, "ARGUMENT")], "astChildren": [(forward, "AST")], "astParent": [(backward, "AST")], "controls": [(forward, "CDG")],
            "controlledBy": [(backward, "CDG")], "controlStructure": [(forward, "CONTAINS")], "identifier": [(forward, "CONTAINS")], "method": [(backward, "CONTAINS")], "file": [(backward, "CONTAINS")],
        }.get(name)
        if hops is None:
            raise TraversalError(f"{name} cannot stand in a condition")
        for hop, label in hops:
            start = hop(start, label)
        out = start.join(self.nodes, start["_at"] == self.nodes["id"]).drop("_at")
        if name in ("callOut", "call"):
            out = out.where(F.col("label") == "CALL")
        elif name in LABELS:
            out = out.where(F.col("label") == LABELS[name])
        if step.args and step.args[0] and isinstance(step.args[0][0], str):
            out = self.named(out, "name", step.args[0])
        return out

    def combine(self, df: DataFrame, how: str, args: list) -> DataFrame:
        key = "id" if "id" in df.columns else "node_id"
        hits = [self.reached(df, a[2] if isinstance(a, tuple) and a[0] == "lambda" else a, key) for a in args]
        if how == "and":
            for h in hits:
                df = df.join(h, key, "left_semi")
            return df
        any_of = hits[0]
        for h in hits[1:]:
            any_of = any_of.unionByName(h)
        return df.join(any_of, key, "left_semi")

    def repeat(self, df: DataFrame, step: Step, modifiers: list[Step]) -> DataFrame:
        """Bounded recursion: the body is applied to a frontier of unseen elements."""
        body = step.args[0][0]
        groups = [a for g in step.args[1:] for a in g]
        for a in groups:
            modifiers = modifiers + (a.steps if isinstance(a, Chain) else [])
        depth, emit, until = None, None, None
        for m in modifiers:
            if m.name in ("times", "maxDepth"):
                depth = int(m.args[0][0])
            elif m.name == "emit":
                emit = m.args[0][0] if m.args and m.args[0] else True
            elif m.name == "until":
                until = m.args[0][0]
        times = any(m.name == "times" for m in modifiers)
        frontier, seen, found = df, df.select("id").distinct(), None
        if depth is None and emit is None and until is None:
            depth = self.max_depth
        # with emit or until and no bound given, it ends when nothing new is met
        for level in count() if depth is None else range(depth):
            frontier = self.apply(frontier, body.steps).dropDuplicates(["id"])
            if not times:
                # written each level: the frontier is read several times below
                frontier = materialize(frontier.join(seen, "id", "left_anti"), "frontier")
                if level and not frontier.take(1):
                    break
                seen = seen.unionByName(frontier.select("id"))
            if emit is not None:
                kept = frontier if emit is True else self.where(frontier, emit, False)
                found = kept if found is None else found.unionByName(kept)
            if until is not None:
                stopped = self.where(frontier, until, False)
                found = stopped if found is None and emit is None else found if emit is not None else found.unionByName(stopped)
                frontier = self.where(frontier, until, True)
        if found is None:
            return frontier if times or until is None else frontier.limit(0)
        return found.dropDuplicates(["id"])

    def closure(self, df: DataFrame, edge: str, forward: bool, include: bool) -> DataFrame:
        hop = self.out if forward else self.back
        frontier = materialize(df.dropDuplicates(["id"]), "frontier")
        out = frontier if include else frontier.limit(0)
        seen = out.select("id")
        # ends on circles too: what was reached before is left out
        while True:
            reached = hop(frontier, edge).dropDuplicates(["id"])
            frontier = materialize(reached.join(seen, "id", "left_anti"), "frontier")
            if not frontier.take(1):
                break
            out, seen = out.unionByName(frontier), seen.unionByName(frontier.select("id"))
        return out.dropDuplicates(["id"])

    def flows(self, sources: DataFrame, sinks: DataFrame) -> DataFrame:
        """(src, dst, path) along REACHING_DEF from sources to sinks; paths visit nothing twice."""
        e = self.edges.where(F.col("label") == "REACHING_DEF").select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
        walk = sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.array("id").alias("path"))
        every = walk
        while True:
            walk = walk.join(e, (walk["dst"] == F.col("_s")) & ~F.array_contains("path", F.col("_d"))).select("src", F.col("_d").alias("dst"), F.array_append("path", F.col("_d")).alias("path"))
            walk = materialize(walk, "paths")
            if not walk.take(1):
                break
            every = every.unionByName(walk)
        return every.where(F.size("path") > 1).join(sinks.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")

    # ---- expressions

    def predicate(self, df: DataFrame, e) -> Column:
        return self.value(df, e)

    def value(self, df: DataFrame, e) -> Column:
        if isinstance(e, (str, int)):
            return F.lit(e)
        if isinstance(e, Chain):
            return self.path(df, e)
        kind = e[0]
        if kind == "lambda":
            return self.value(df, e[2])
        if kind == "not":
            return ~self.value(df, e[1])
        if kind in ("and", "or"):
            a, b = self.value(df, e[1]), self.value(df, e[2])
            return a & b if kind == "and" else a | b
        a, b = self.value(df, e[2]), self.value(df, e[3])
        return {"==": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[e[1]]

    def path(self, df: DataFrame, chain: Chain) -> Column:
        out = None
        for s in chain.steps:
            args = [self.value(df, a) for g in s.args for a in g]
            if out is None:
                column = "tag_name" if s.name == "name" and "tag_name" in df.columns else PROPERTIES.get(s.name, s.name)
                out = F.col(column)
                if args:
                    out = out.rlike(F.concat(F.lit("^(?:"), args[0], F.lit(")$")))
                continue
            out = {
                "contains": lambda c: c.contains(args[0]), "startsWith": lambda c: c.startswith(args[0]), "endsWith": lambda c: c.endswith(args[0]), "toInt": lambda c: c.try_cast("int"),
                "toLowerCase": F.lower, "toUpperCase": F.upper, "length": F.length, "size": F.length, "isEmpty": lambda c: c == "", "nonEmpty": lambda c: c != "", "get": lambda c: c, "matches": lambda c: c.rlike(args[0]),
            }[s.name](out)
        return F.lit(True) if out is None else out
