"""The segment cache: persisted columns of partitions, under a replacement policy."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.sources.catalog import Table, partition_of
from spindrift.sources.policies import Policy, SegmentKey

FILE, ROW = "_file", "_row"
#: Rows for each task that stitches columns. Spark deals by compressed bytes, of which a file's name in every row has next to
#: none, or to a fixed number of tasks: either lets a task sort many times more.
STITCHED_ROWS = 500_000


@dataclass
class CacheMetrics:
    hits: int = 0
    misses: int = 0
    evicted: int = 0
    refused: int = 0

    @property
    def hit_ratio(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


def with_rows(spark: SparkSession, table: Table, partitions: list[str], columns: Iterable[str]) -> DataFrame:
    """Columns of partitions with a file and a number for each row that are the same in every read."""
    return table.read(spark, partitions).select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW), *sorted(columns))


def stitch(first: DataFrame, others: Sequence[DataFrame], rows: int, *, dealt: bool = False) -> DataFrame:
    """The columns of frames side by side, by file and row number, in as many tasks as the rows ask for. ``dealt``: the first
    comes from here and lies so already."""
    n = max(1, math.ceil(rows / STITCHED_ROWS))
    return reduce(lambda a, b: a.join(b.repartition(n, FILE, ROW), [FILE, ROW]), others, first if dealt else first.repartition(n, FILE, ROW))


@dataclass(eq=False)
class Block:
    """The same columns of some partitions, persisted by one job; ``files`` and ``rows`` are those of each partition."""

    frame: DataFrame
    files: dict[str, list[str]]
    rows: dict[str, int]
    held: set[SegmentKey]
    size: float

    def rows_of(self, partitions: Iterable[str]) -> DataFrame:
        """The rows of some of the partitions, by the shorter list of files."""
        wanted = set(partitions)
        inside = [f for p, fs in self.files.items() if p in wanted for f in fs]
        outside = [f for p, fs in self.files.items() if p not in wanted for f in fs]
        if not outside:
            return self.frame
        return self.frame.where(F.col(FILE).isin(inside) if len(inside) <= len(outside) else ~F.col(FILE).isin(outside))


class SegmentCache:
    """Held segments lie in blocks (memory, then disk), keyed by file and row number, by which columns from several blocks are
    stitched. What a scan adds is persisted by one job for each set of columns, however many partitions there are. A block
    is rewritten without what was evicted once that halves it, so blocks take at most about twice the policy's capacity.
    Sizes are estimates from statistics."""

    def __init__(self, spark: SparkSession, policy: Policy, *, frozen: bool = False) -> None:
        self.spark, self.policy, self.frozen = spark, policy, frozen
        self.frames: dict[SegmentKey, Block] = {}
        self.total, self.query = CacheMetrics(), CacheMetrics()

    def new_query(self) -> None:
        self.query = CacheMetrics()
        self.policy.on_new_query()

    def lookup(self, table: Table, partition: str, columns: Iterable[str]) -> tuple[set[str], set[str]]:
        """Columns that are held, and that are not; counts both and tells the policy."""
        hit = set(self.blocks(table, partition, columns))
        miss = set(columns) - hit
        for c in columns:
            self.policy.on_load(SegmentKey(table.name, partition, c))
        for m in (self.total, self.query):
            m.hits += len(hit)
            m.misses += len(miss)
        return hit, miss

    def blocks(self, table: Table, partition: str, columns: Iterable[str]) -> dict[str, Block]:
        """The blocks of the columns that are held."""
        return {c: b for c in columns if (b := self.frames.get(SegmentKey(table.name, partition, c))) is not None}

    def frame(self, partitions: list[str], blocks: Mapping[str, Block]) -> DataFrame:
        """Columns of partitions from their blocks. Spark's in-memory scan skips batches by bounds that leave NaN out, so
        floating columns come as expressions, by which it doesn't."""
        by: dict[Block, list[str]] = {}
        for column, block in sorted(blocks.items()):
            by.setdefault(block, []).append(column)

        def part(block: Block, columns: list[str]) -> DataFrame:
            floating = {f.name for f in block.frame.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
            return block.rows_of(partitions).select(FILE, ROW, *(F.nanvl(c, c).alias(c) if c in floating else c for c in columns))

        first, *others = (part(block, columns) for block, columns in by.items())
        return stitch(first, others, self.rows(partitions, blocks)) if others else first

    @staticmethod
    def rows(partitions: list[str], blocks: Mapping[str, Block]) -> int:
        """Rows of partitions that lie in the blocks."""
        block = next(iter(blocks.values()))
        return sum(block.rows[p] for p in partitions)

    def size(self, table: Table, column: str) -> float:
        rows = (table.rows or 1_000_000) / max(len(table.paths), 1)
        return rows * table.column_bytes.get(column, 8)

    def store(self, table: Table, missing: Mapping[str, Iterable[str]]) -> None:
        """Lets the policy decide on each partition's columns and persists those admitted that no later one displaced."""
        if self.frozen:
            return
        admitted: dict[SegmentKey, None] = {}
        shrunk: set[Block] = set()
        for partition, columns in missing.items():
            for key in self.policy.to_cache([SegmentKey(table.name, partition, c) for c in sorted(columns)]):
                gone = self.policy.on_store(key, self.size(table, key.column))
                if gone is None:
                    for m in (self.total, self.query):
                        m.refused += 1
                    continue
                admitted[key] = None
                for victim in gone:
                    admitted.pop(victim, None)
                    if (block := self.frames.pop(victim, None)) is not None:
                        block.held.discard(victim)
                        shrunk.add(block)
                        for m in (self.total, self.query):
                            m.evicted += 1
        for block in shrunk:
            self._shrink(block)
        columns_of: dict[str, set[str]] = {}
        for key in admitted:
            columns_of.setdefault(key.partition, set()).add(key.column)
        by: dict[frozenset[str], list[str]] = {}
        for partition, columns in columns_of.items():
            by.setdefault(frozenset(columns), []).append(partition)
        for columns, partitions in by.items():
            self._add(table, partitions, columns)

    def _add(self, table: Table, partitions: list[str], columns: Iterable[str]) -> None:
        """One job, which also says which files the partitions have."""
        frame = with_rows(self.spark, table, partitions, columns).persist(StorageLevel.MEMORY_AND_DISK)
        files: dict[str, list[str]] = {p: [] for p in partitions}
        rows = dict.fromkeys(partitions, 0)
        find = partition_of(partitions)
        for r in frame.groupBy(FILE).count().collect():
            files[find(r[FILE])].append(r[FILE])
            rows[find(r[FILE])] += r["count"]
        keys = {SegmentKey(table.name, p, c) for p in partitions for c in columns}
        block = Block(frame, files, rows, keys, sum(self.policy.held[k].size for k in keys))
        self.frames.update(dict.fromkeys(keys, block))

    def _shrink(self, block: Block) -> None:
        """Frees a block of which nothing is held; rewrites one by a job where that halves it."""
        if not block.held:
            block.frame.unpersist()
            return
        partitions, columns = {k.partition for k in block.held}, {k.column for k in block.held}
        column_size = {k.column: self.policy.held[k].size for k in block.held}
        left = len(partitions) * sum(column_size.values())
        if 2 * left > block.size:
            return
        frame = block.rows_of(partitions).select(FILE, ROW, *sorted(columns)).persist(StorageLevel.MEMORY_AND_DISK)
        frame.count()
        block.frame.unpersist()
        block.frame, block.files, block.size = frame, {p: block.files[p] for p in partitions}, left
        block.rows = {p: block.rows[p] for p in partitions}

    def clear(self) -> None:
        for block in set(self.frames.values()):
            block.frame.unpersist()
        self.frames.clear()
        self.policy.on_clear()
