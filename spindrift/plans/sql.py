"""The SQL front end: a small dialect normaliser, tables of a folder as views, and running a text or a file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from spindrift.config import EngineConfig
from spindrift.plans.engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_PARTS = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|[^'\"\-/]+|.", re.S)
_INTERVAL_PRECISION = re.compile(r"\b(day|month|year|hour|minute|second)\s*\(\s*\d+\s*\)", re.I)


def normalise(sql: str) -> str:
    """Accepts what Spark's parser doesn't: double-quoted identifiers (to backticks), an interval's leading precision
    (``interval '90' day (3)``), and a final semicolon. String literals and comments stay as they are."""
    out = []
    for part in _PARTS.findall(sql.strip().rstrip(";").rstrip()):
        if part.startswith("'") or part.startswith("--") or part.startswith("/*"):
            out.append(part)
        elif part.startswith('"') and len(part) > 1:
            out.append("`" + part[1:-1].replace('""', '"').replace("`", "``") + "`")
        else:
            out.append(part)
    text, n = [], 0
    for part in out:  # the precision follows the unit outside of literals
        text.append(part if part[:1] in "'`" or part[:2] in ("--", "/*") else _INTERVAL_PRECISION.sub(r"\1", part))
        n += 1
    return "".join(text)


def register(spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES, layout: str = "{folder}/{table}.parquet") -> None:
    for t in tables:
        spark.read.parquet(layout.format(folder=folder, table=t)).createOrReplaceTempView(t)


def tables_in(sql: str) -> tuple[str, ...]:
    words = set(re.findall(r"[a-z_]+", sql.lower()))
    return tuple(t for t in TABLES if t in words)


def run_sql(spark: SparkSession, folder: str, sql: str, config: EngineConfig | None = None) -> DataFrame:
    """One SELECT over the tables of a folder, with options under these (see ``engine``), without them as Spark runs it. The
    plan is resolved now, against views that later calls may replace."""
    if config is not None:
        return Engine(spark, folder, config).sql(sql)
    register(spark, folder, tables_in(sql))
    return spark.sql(normalise(sql))


def run_file(spark: SparkSession, folder: str, path: str, config: EngineConfig | None = None) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        return run_sql(spark, folder, f.read(), config)
