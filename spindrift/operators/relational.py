"""The logical operators as DataFrame functions: scan, filter, project, joins, aggregate, group, sort, limit-sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.expressions import Node, columns_of, to_column, typed

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "left_semi": "left_semi", "right_semi": "left_semi", "left_anti": "left_anti"}


def _known(df: DataFrame, names: set[str]) -> None:
    if missing := {n for n in names if n.lower() not in {c.lower() for c in df.columns}}:
        raise ValueError(f"no column {', '.join(sorted(missing))} among {df.columns}")


def scan(df: DataFrame, predicate: Node | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A filtered, projected scan; both reach the file reader."""
    return project(filter_(df, predicate), list(columns)) if columns else filter_(df, predicate)


def filter_(df: DataFrame, predicate: Node | None) -> DataFrame:
    if predicate is None:
        return df
    _known(df, columns_of(predicate))
    return df.where(to_column(typed(predicate, df)))


def project(df: DataFrame, columns: Sequence[str | tuple[str, str]] = (), expressions: dict[str, Node] | None = None) -> DataFrame:
    """``columns``: names, or (old, new) pairs; ``expressions`` by the name of the result."""
    pairs = [(c, c) if isinstance(c, str) else c for c in columns]
    _known(df, {a for a, _ in pairs}.union(*map(columns_of, (expressions or {}).values())))
    return df.select(*(F.col(a).alias(b) for a, b in pairs), *(to_column(typed(e, df)).alias(n) for n, e in (expressions or {}).items()))


def _apart(left: DataFrame, right: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns of the right that the left has too get the suffix _right."""
    taken = {c.lower() for c in left.columns}
    names = {c: f"{c}_right" for c in right.columns if c.lower() in taken}
    return right.withColumnsRenamed(names), names


def hash_join(left: DataFrame, right: DataFrame, how: str, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """Equi-join. Nulls never match. Clashing names of the right side get the suffix ``_right``."""
    if how not in JOINS:
        raise ValueError(f"unknown join {how!r}; known are {sorted(JOINS)}")
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("as many left as right keys are needed, one at least")
    _known(left, set(left_keys))
    _known(right, set(right_keys))
    if how == "right_semi":
        return hash_join(right, left, "left_semi", right_keys, left_keys)
    right, names = _apart(left, right)
    renamed = {a.lower(): b for a, b in names.items()}
    on = [left[a] == right[renamed.get(b.lower(), b)] for a, b in zip(left_keys, right_keys, strict=True)]
    return left.join(right, on, JOINS[how])


def nested_loop_join(left: DataFrame, right: DataFrame, how: str = "inner", predicate: Node | None = None) -> DataFrame:
    """A join by any predicate; without one, all pairs. Column names as in ``hash_join``."""
    right, _ = _apart(left, right)
    if predicate is None:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), JOINS[how])
    pairs = left.crossJoin(right)  # for its columns only
    _known(pairs, columns_of(predicate))
    return left.join(right, to_column(typed(predicate, pairs)), JOINS[how])


def _aggregate(kind: str, argument: Node | None, df: DataFrame) -> Column:
    c = to_column(typed(argument, df)) if argument is not None else None
    made = {
        "sum": lambda: F.sum(c),
        "sum0": lambda: F.coalesce(F.sum(c), F.lit(0)),
        "count": lambda: F.count(c if c is not None else F.lit(1)),
        "count_distinct": lambda: F.countDistinct(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "avg": lambda: F.avg(c.cast("double")),
    }
    if kind not in made or (c is None and kind != "count"):
        raise ValueError(f"unknown aggregate {kind!r} or no argument")
    return made[kind]()


def aggregate(df: DataFrame, functions: dict[str, tuple[str, Node | None]]) -> DataFrame:
    """One row, also over no rows. ``functions``: name of the result → (kind, argument)."""
    return df.agg(*(_aggregate(k, a, df).alias(n) for n, (k, a) in functions.items()))


def group(df: DataFrame, keys: Sequence[str], functions: dict[str, tuple[str, Node | None]] | None = None) -> DataFrame:
    """Partial aggregation before the shuffle, by Spark; without functions, the distinct keys. Null is a key."""
    _known(df, set(keys))
    if not functions:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*(_aggregate(k, a, df).alias(n) for n, (k, a) in functions.items()))


def _orders(keys: Sequence[tuple[str, str]]) -> list[Column]:
    """Nulls come last in both directions."""
    return [F.col(c).asc_nulls_last() if d.upper() == "ASC" else F.col(c).desc_nulls_last() for c, d in keys]


def sort(df: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    _known(df, {c for c, _ in keys})
    return df.orderBy(*_orders(keys))


def limit_sort(df: DataFrame, k: int, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """The first k rows in order: each task keeps k, one merges them."""
    _known(df, {c for c, _ in keys})
    return df.orderBy(*_orders(keys)).limit(k)
