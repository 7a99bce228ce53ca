"""Scalar expressions as JSON-like trees, turned into columns.

A node is {"op": name, ...}: ``column`` has name; ``literal`` has value and, for date and interval, type ("date",
"interval_day", "interval_month"); all others have args, which are nodes. ``in`` has values (literals) besides, ``cast`` and
``extract`` have to and unit. Integer division keeps integers, as int / int is declared to in these trees: ``typed`` marks the
columns that hold them. SQL text follows Spark.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.types import spark_type

Node = dict[str, Any]

COMPARISONS = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
_FLIPPED = {"eq": "eq", "ne": "ne", "lt": "gt", "le": "ge", "gt": "lt", "ge": "le"}


def col(name: str) -> Node:
    return {"op": "column", "name": name.lower()}


def lit(value: Any, kind: str | None = None) -> Node:
    return {"op": "literal", "value": value, "type": kind} if kind else {"op": "literal", "value": value}


def call(op: str, *args: Node, **more: Any) -> Node:
    return {"op": op, "args": list(args), **more}


def _literal(node: Node) -> Column:
    value, kind = node["value"], node.get("type")
    if kind == "date":
        return F.lit(value if isinstance(value, datetime.date) else datetime.date.fromisoformat(value))
    if kind == "timestamp_ntz":
        return F.lit(str(value)).cast("timestamp_ntz")
    if kind == "timestamp":
        return F.lit(value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(value))
    if kind == "interval_day":
        return F.make_dt_interval(F.lit(int(value)))
    if kind == "interval_month":
        return F.make_ym_interval(F.lit(0), F.lit(int(value)))
    return F.lit(value)


def typed(node: Node, df: DataFrame) -> Node:
    """The tree with a mark on columns that hold integers in ``df``."""
    integers = {f.name.lower() for f in df.schema if isinstance(f.dataType, T.IntegralType)}

    def marked(n: Node) -> Node:
        if n["op"] == "column":
            return n | {"integer": True} if n["name"].lower() in integers else n
        return n | {"args": [*map(marked, n["args"])]} if "args" in n else n

    return marked(node)


def _integer(node: Node) -> bool:
    if node["op"] == "literal":
        return isinstance(node["value"], int) and not isinstance(node["value"], bool) and "type" not in node
    if node["op"] == "cast":
        return isinstance(spark_type(node["to"]), T.IntegralType)
    if node["op"] == "if":
        return all(map(_integer, [*node["args"][1::2], node["args"][-1]]))
    return node.get("integer", False) or node["op"] == "extract" or (node["op"] in ("add", "subtract", "multiply", "divide") and all(map(_integer, node["args"])))


def _divide(node: Node) -> Column:
    a, b = map(to_column, node["args"])
    if all(map(_integer, node["args"])):
        return F.when(b != 0, F.call_function("div", a, b))
    return F.try_divide(a, b)


def _extract(node: Node) -> Column:
    return F.extract(F.lit(node["unit"].upper()), to_column(node["args"][0])).cast("long")


def _case(node: Node) -> Column:
    *pairs, last = node["args"]
    out = to_column(last)
    for condition, value in reversed([*zip(pairs[::2], pairs[1::2], strict=True)]):
        out = F.when(to_column(condition), to_column(value)).otherwise(out)
    return out


def _pair(f: Callable[[Column, Column], Column]) -> Callable[[Node], Column]:
    return lambda node: reduce(f, map(to_column, node["args"]))


_BUILD: dict[str, Callable[[Node], Column]] = {
    "column": lambda n: F.col(n["name"]),
    "literal": _literal,
    "add": _pair(lambda a, b: a + b),
    "subtract": _pair(lambda a, b: a - b),
    "multiply": _pair(lambda a, b: a * b),
    "divide": _divide,
    "date_add": _pair(lambda a, b: a + b),
    "extract": _extract,
    "and": _pair(lambda a, b: a & b),
    "or": _pair(lambda a, b: a | b),
    "not": lambda n: ~to_column(n["args"][0]),
    "eq": _pair(lambda a, b: a == b),
    "ne": _pair(lambda a, b: a != b),
    "lt": _pair(lambda a, b: a < b),
    "le": _pair(lambda a, b: a <= b),
    "gt": _pair(lambda a, b: a > b),
    "ge": _pair(lambda a, b: a >= b),
    "between": lambda n: to_column(n["args"][0]).between(*map(to_column, n["args"][1:])),
    "like": lambda n: to_column(n["args"][0]).like(n["args"][1]["value"]),
    "in": lambda n: to_column(n["args"][0]).isin([v for v in n["values"]]),
    "if": _case,
    "is_null": lambda n: to_column(n["args"][0]).isNull(),
    "is_true": lambda n: to_column(n["args"][0]).eqNullSafe(F.lit(True)),
    "is_false": lambda n: to_column(n["args"][0]).eqNullSafe(F.lit(False)),
    "is_not_true": lambda n: ~to_column(n["args"][0]).eqNullSafe(F.lit(True)),
    "is_not_false": lambda n: ~to_column(n["args"][0]).eqNullSafe(F.lit(False)),
    "substr": lambda n: F.substring(to_column(n["args"][0]), to_column(n["args"][1]).cast("int"), to_column(n["args"][2]).cast("int")),
    "cast": lambda n: to_column(n["args"][0]).cast(spark_type(n["to"])),
}


def to_column(node: Node) -> Column:
    try:
        build = _BUILD[node["op"]]
    except KeyError:
        raise ValueError(f"unknown expression {node.get('op')!r}") from None
    return build(node)


def columns_of(node: Node | None) -> set[str]:
    """Names of the columns that a tree reads."""
    if node is None:
        return set()
    if node["op"] == "column":
        return {node["name"]}
    return set().union(*map(columns_of, node.get("args", ())))


def leaves(node: Node | None) -> int:
    """How many predicates a tree combines by and, or and not."""
    if node is None:
        return 0
    return sum(map(leaves, node["args"])) if node["op"] in ("and", "or", "not") else 1


def canonical(node: Node) -> Node:
    """Comparisons of a literal with a column turned to column before literal; between spelled as two comparisons."""
    op, args = node["op"], node.get("args", [])
    if op == "between":
        return call("and", canonical(call("ge", args[0], args[1])), canonical(call("le", args[0], args[2])))
    if op in COMPARISONS and args[0]["op"] == "literal" and args[1]["op"] != "literal":
        return call(_FLIPPED[op], args[1], args[0])
    if op in ("and", "or"):
        return call(op, *map(canonical, args))
    return node
