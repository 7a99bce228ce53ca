"""What features saved: rows before and after prefilters, files and filters of scans, hit ratios."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from spindrift.plans.joingraph import JoinGraph
from spindrift.sources.cache import SegmentCache


@dataclass
class Metrics:
    rows_before: dict[str, int] = field(default_factory=dict)
    rows_after: dict[str, int] = field(default_factory=dict)
    hit_ratio: float | None = None
    exchanges: int = 0
    pushed_filters: list[str] = field(default_factory=list)

    @property
    def removed(self) -> int:
        return sum(self.rows_before.values()) - sum(self.rows_after.values())


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def of_plan(df: DataFrame) -> Metrics:
    text = plan_text(df)
    tree = text.split("\n\n")[0]
    return Metrics(exchanges=len(re.findall(r"\bExchange\b", tree)), pushed_filters=re.findall(r"PushedFilters: \[([^\]]*)\]", text))


def of_transfer(before: JoinGraph, after: JoinGraph, cache: SegmentCache | None = None) -> Metrics:
    """Counts every relation twice: jobs of their own."""
    return Metrics(before.row_counts(), after.row_counts(), cache.total.hit_ratio if cache else None)
