"""Scan modes: where columns come from and who filters. Every mode gives the same rows.

* pull-up: whole partitions are read and filtered afterwards (nothing reaches the reader but the columns);
* pushdown: zone maps choose partitions, each with what is left of the predicate, and filters reach the reader;
* caching: every column comes through the segment cache, missing ones are fetched and offered to it;
* hybrid: missing segments are offered to the cache; then, for each partition, held columns are used if they cover the
  predicate and at least one projected column (what is missing is fetched and stitched by row number), else the scan is
  pushed down. So what a query brings to the cache isn't read twice;
* adaptive: pushed down or pulled up, by estimated costs and the store's load.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.config import EngineConfig, Mode
from spindrift.functions.expressions import Node, columns_of, leaves, to_column, typed
from spindrift.operators.pruning import prune, selectivity
from spindrift.sources import files
from spindrift.sources.cache import FILE, ROW, Block, SegmentCache, stitch, with_rows
from spindrift.sources.catalog import Table
from spindrift.sources.policies import FILTER_RATE, NETWORK_RATE, SCAN_RATE, SegmentKey, pushdown_weight


def _union(frames: Iterable[DataFrame], empty: DataFrame) -> DataFrame:
    frames = list(frames)
    return reduce(DataFrame.unionByName, frames) if frames else empty


def pull_up(spark: SparkSession, table: Table, predicate: Node | None, columns: Sequence[str]) -> DataFrame:
    need = sorted({*columns} | columns_of(predicate))
    df = table.read(spark).select(*need)
    if predicate is None:
        return df.select(*columns)
    # a filter never moves below a column of a non-deterministic expression
    return df.withColumn("_pulled", F.monotonically_increasing_id()).where(to_column(typed(predicate, df)) & (F.col("_pulled") >= 0)).select(*columns)


def pushed_down(spark: SparkSession, table: Table, predicate: Node | None, columns: Sequence[str], zone_maps: bool = True) -> DataFrame:
    """Partitions with the same rest of the predicate are one scan, so plans stay as small as the zones allow."""
    kept = prune(predicate, {p: table.zones.get(p, {}) for p in table.paths}) if zone_maps else dict.fromkeys(table.paths, predicate)
    by: dict[str, tuple[Node | None, list[str]]] = {}
    for path, rest in kept.items():
        by.setdefault(repr(rest), (rest, []))[1].append(path)
    scans = [(d if rest is None else d.where(to_column(typed(rest, d)))).select(*columns) for rest, paths in by.values() for d in [table.read(spark, paths)]]
    return _union(scans, files.read(spark, table.form, [], table.schema).select(*columns))


def cached(spark: SparkSession, table: Table, predicate: Node | None, columns: Sequence[str], cache: SegmentCache) -> DataFrame:
    need = {*columns} | columns_of(predicate)
    missing = {p: miss for p in table.paths if (miss := cache.lookup(table, p, need)[1])}
    cache.store(table, missing)
    parts = _from_cache(spark, table, dict.fromkeys(table.paths, predicate), need, cache)
    return _union((df.select(*columns) for df in parts), files.read(spark, table.form, [], table.schema).select(*columns))


def _from_cache(spark: SparkSession, table: Table, kept: dict[str, Node | None], need: set[str], cache: SegmentCache) -> list[DataFrame]:
    """The columns of partitions, each filtered by its predicate. Partitions with the same predicate and the same blocks are
    one scan of the cache, to which what isn't held is joined by file and row number, after the filter where that can be."""
    by: dict[tuple, tuple[dict[str, Block], Node | None, list[str]]] = {}
    for p, predicate in kept.items():
        held = cache.blocks(table, p, need)
        by.setdefault((frozenset(held.items()), repr(predicate)), (held, predicate, []))[2].append(p)

    def scan_of(held: dict[str, Block], predicate: Node | None, partitions: list[str]) -> DataFrame:
        def where(df: DataFrame) -> DataFrame:
            return df if predicate is None else df.where(to_column(typed(predicate, df)))

        rest = need - set(held)
        if not held:
            return where(with_rows(spark, table, partitions, rest))
        df = cache.frame(partitions, held)
        if not rest:
            return where(df)
        fetched = with_rows(spark, table, partitions, rest)
        rows, dealt = cache.rows(partitions, held), len(set(held.values())) > 1
        if columns_of(predicate) <= set(held):
            return stitch(where(df), [fetched], rows, dealt=dealt)
        return where(stitch(df, [fetched], rows, dealt=dealt))

    return [scan_of(*group) for group in by.values()]


def hybrid(spark: SparkSession, table: Table, predicate: Node | None, columns: Sequence[str], cache: SegmentCache, zone_maps: bool = True) -> DataFrame:
    need, tests = {*columns} | columns_of(predicate), columns_of(predicate)
    kept = prune(predicate, {p: table.zones.get(p, {}) for p in table.paths}) if zone_maps else dict.fromkeys(table.paths, predicate)
    missing = {p: miss for p in kept if (miss := cache.lookup(table, p, need)[1])}
    row = sum(table.column_bytes.values()) or 8.0 * len(need)
    for p, miss in missing.items():
        share = selectivity(predicate, table.zones.get(p, {}))
        for c in miss:
            cache.policy.on_weight(SegmentKey(table.name, p, c), pushdown_weight(share, row, table.column_bytes.get(c, 8.0), leaves(predicate), len(miss)))
    cache.store(table, missing)
    usable = {p: set(cache.blocks(table, p, need)) for p in kept}
    usable = {p for p, hit in usable.items() if tests <= hit and hit & {*columns}}
    parts = [df.select(*columns) for df in _from_cache(spark, table, {p: rest for p, rest in kept.items() if p in usable}, need, cache)]
    if pushed := [p for p in kept if p not in usable]:
        parts.append(pushed_down(spark, replace(table, paths=pushed), predicate, columns, zone_maps))
    return _union(parts, files.read(spark, table.form, [], table.schema).select(*columns))


def scan(spark: SparkSession, table: Table, predicate: Node | None, columns: Sequence[str], config: EngineConfig, cache: SegmentCache | None = None) -> DataFrame:
    if config.mode is Mode.PULL_UP:
        return pull_up(spark, table, predicate, columns)
    if config.mode is Mode.PUSHDOWN_ONLY:
        return pushed_down(spark, table, predicate, columns, config.zone_maps)
    if config.mode is Mode.ADAPTIVE:
        return adaptive(spark, table, predicate, columns, config)
    if cache is None:
        raise ValueError(f"{config.mode} needs a cache")
    if config.mode is Mode.CACHING_ONLY:
        return cached(spark, table, predicate, columns, cache)
    return hybrid(spark, table, predicate, columns, cache, config.zone_maps)


def filter_bitmap(spark: SparkSession, table: Table, predicate: Node) -> DataFrame:
    """The rows (file, row number) that satisfy a predicate, as a side that evaluated it would send them."""
    df = (lambda d: d.where(to_column(typed(predicate, d))))(table.read(spark))
    return df.select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def scan_by_bitmap(spark: SparkSession, table: Table, bitmap: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of the rows in a bitmap, without reading the predicate's own columns."""
    df = table.read(spark).select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW), *columns)
    return df.join(bitmap, [FILE, ROW], "left_semi").select(*columns)


def push_down_now(pushdown_seconds: float, wait_seconds: float, pullup_seconds: float, fallbacks: int, max_pullups: int) -> bool:
    """The adaptive decision at a storage node: take a request if waiting for it and running it is faster than the rounds of
    pull-ups that the requests refused so far make; alike, it is refused."""
    return max(1, math.ceil(fallbacks / max(max_pullups, 1))) * pullup_seconds > pushdown_seconds + wait_seconds


def adaptive(spark: SparkSession, table: Table, predicate: Node | None, columns: Sequence[str], config: EngineConfig) -> DataFrame:
    """Pushed down or pulled up, as the cost model and the store's load (``config.store``) say."""
    rows = table.rows if table.rows is not None else 1_000_000
    width = lambda names: sum(table.column_bytes.get(c, 8.0) for c in names)
    need = {*columns} | columns_of(predicate)
    share = sum(selectivity(predicate, table.zones.get(p, {})) for p in table.paths) / max(len(table.paths), 1)
    pushed = rows * (width(need) / SCAN_RATE + leaves(predicate) / FILTER_RATE + share * width(columns) / NETWORK_RATE) / 1e9
    pulled = rows * width(need) / NETWORK_RATE / 1e9
    if push_down_now(pushed, config.store.wait_seconds, pulled, config.store.fallbacks, config.store.max_pullups):
        return pushed_down(spark, table, predicate, columns, config.zone_maps)
    return pull_up(spark, table, predicate, columns)
