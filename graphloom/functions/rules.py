"""Ordered rule tables and their compilation to Columns and to SQL of the same meaning."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def lists(text: str) -> dict[str, list[str]]:
    """``key: value, value`` lines as a table, in order."""
    out: dict[str, list[str]] = {}
    for line in text.strip().splitlines():
        key, values = line.strip().split(": ", 1)
        out[key] = [v.strip() for v in values.split(", ")]
    return out


def quoted(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def hits(c: Column, tokens: list[str], regex: bool = False) -> Column:
    """How many of the tokens a text holds."""
    return reduce(add, [(c.rlike(t) if regex else c.contains(t)).cast("int") for t in tokens])


def hits_sql(c: str, tokens: list[str], regex: bool = False) -> str:
    one = "regexp_matches({c}, '{t}')::int" if regex else "contains({c}, '{t}')::int"
    return "(" + " + ".join(one.format(c=c, t=t) for t in tokens) + ")"


def holds_any(c: Column, tokens: list[str]) -> Column:
    return reduce(or_, [c.contains(t) for t in tokens])


def best(c: Column, table: dict[str, list[str]], default: str, regex: bool = False) -> tuple[Column, Column]:
    """(key of most hits, its hits): ties go to the first key, no hit to the default."""
    # one pass: the largest of (hits, earlier place, key)
    scores = [F.struct(hits(c, v, regex).alias("n"), F.lit(-i).alias("place"), F.lit(k).alias("key")) for i, (k, v) in enumerate(table.items())]
    top = F.array_max(F.array(*scores))
    return F.when(top["n"] == 0, default).otherwise(top["key"]), top["n"]


def best_sql(c: str, table: dict[str, list[str]], default: str, regex: bool = False) -> tuple[str, str]:
    top = "greatest(" + ", ".join(hits_sql(c, v, regex) for v in table.values()) + ")"
    cases = " ".join(f"when {hits_sql(c, v, regex)} = {top} then '{k}'" for k, v in table.items())
    return f"case when {top} = 0 then '{default}' {cases} end", top


def looked_up(c: Column, table: dict[str, list[str]]) -> Column:
    """The list of a key, empty where the table has none."""
    out = None
    for k, v in table.items():
        out = F.when(c == k, strings(v)) if out is None else out.when(c == k, strings(v))
    return out.otherwise(strings([]))


def looked_up_sql(c: str, table: dict[str, list[str]]) -> str:
    return f"(case {c} " + " ".join(f"when '{k}' then {quoted(v)}" for k, v in table.items()) + " else []::varchar[] end)"


def _holds(token: str):
    return lambda w: w.contains(token)


def matching(words: Column, tokens: dict[str, str]) -> Column:
    """Values of the tokens that some word holds, in the order of the tokens, once each."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(F.exists(words, _holds(t)), v) for t, v in tokens.items()])))


def matching_sql(words: str, tokens: dict[str, str]) -> str:
    """The same; values of different tokens must differ."""
    return "list_filter([" + ", ".join(f"case when len(list_filter({words}, lambda w: contains(w, '{t}'))) > 0 then '{v}' end" for t, v in tokens.items()) + "], lambda x: x is not null)"
