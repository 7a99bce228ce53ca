"""Registered queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.plans.features import FEATURES
from spindrift.plans.queries_sql import SQL
from spindrift.plans.sql import run_sql


def _from_text(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: run_sql(spark, folder, text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _from_text(text) for name, text in SQL.items()} | {name: query for name, (query, _) in FEATURES.items()}
ORACLES: dict[str, str] = dict(SQL) | {name: text for name, (_, text) in FEATURES.items()}
