"""Vector bin packing by the dot-product heuristic, under limits on tokens, segments and loss-bearing tokens at once.

An open sequence takes, of the waiting items that fit in every dimension, the one whose demand has the largest dot
product with what is left (both as shares of the limits). Where items may be cut, an item's front closes what is left.

Each task packs its own rows with a pool of bounded size, so nothing is shuffled and no group is ever gathered; a task
that is run again gives the same sequences for the same rows. Sequence ids are unique: the task's number above 2**33.

Defined cases: a null or empty text is one item of its end id alone; repeated rows are packed each; a null id stays
null; an empty table gives no rows; an example over a limit by itself gets no sequence (``pack_examples``).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.bpe import encoder
from spindrift.llm.storage import type_of

SEQUENCE_TOKENS, MAX_SEGMENTS, MAX_LOSS_TOKENS = 1024, 128, 1023
#: Items that wait in a task for a sequence that they fit.
POOL_ITEMS = 1024
#: A cut leaves no piece shorter than this, unless the last sequence of a task is cut into powers of two.
MIN_PIECE = 8
#: Rows of a result batch.
BATCH_ROWS = 4096


@dataclass(frozen=True)
class Limits:
    tokens: int = SEQUENCE_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_LOSS_TOKENS

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], dtype=np.float64)


class Pool:
    """Waiting items: a matrix of demands, and what each stands for."""

    def __init__(self, limits: Limits, size: int) -> None:
        self.caps = limits.vector()
        self.demand = np.full((size, 3), np.inf)
        self.what: list = [None] * size
        self.free = list(range(size))[::-1]

    def put(self, demand: tuple[float, float, float], what: object) -> None:
        i = self.free.pop()
        self.demand[i] = demand
        self.what[i] = what

    def take(self, i: int) -> object:
        found, self.what[i] = self.what[i], None
        self.demand[i] = np.inf
        self.free.append(i)
        return found

    def best(self, left: np.ndarray) -> int | None:
        """The waiting item that fits and has the largest dot product with what is left."""
        fits = (self.demand <= left).all(axis=1)
        if not fits.any():
            return None
        where = np.flatnonzero(fits)
        return int(where[np.argmax(self.demand[where] @ (left / self.caps**2))])

    def longest(self) -> int | None:
        held = np.where(np.isfinite(self.demand[:, 0]), self.demand[:, 0], -1)
        return int(held.argmax()) if held.max() > 0 else None

    @property
    def full(self) -> bool:
        return not self.free

    @property
    def empty(self) -> bool:
        return len(self.free) == len(self.what)


def _piece_demand(length: int) -> tuple[int, int, int]:
    """A piece of plain text: one segment; every id but the first bears loss."""
    return length, 1, length - 1


class DocumentPacker:
    """Documents as ids, cut and packed. Items are (document, start, packed ids)."""

    def __init__(self, limits: Limits = Limits(), pool: int = POOL_ITEMS, first_id: int = 0) -> None:
        self.limits, self.pool, self.next = limits, Pool(limits, pool), first_id
        self.whole = min(limits.tokens, limits.loss + 1)

    def _emit(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for document, start, ids in pieces:
            yield *document, start, len(ids) // 4, zlib.crc32(ids), self.next, at
            at += len(ids) // 4
        self.next += 1

    def add(self, document: tuple, ids: bytes) -> Iterator[tuple]:
        """``document``: id and number of tokens. Yields the rows of sequences that are closed by it."""
        n, whole = len(ids) // 4, self.whole
        for start in range(0, n - n % whole, whole):
            yield from self._emit([(document, start, ids[4 * start : 4 * (start + whole)])])
        if n % whole:
            self.pool.put(_piece_demand(n % whole), (document, n - n % whole, ids[4 * (n - n % whole) :]))
            if self.pool.full:
                yield from self._closed(self._fill())

    def _fill(self) -> list:
        """The pieces of one sequence; the pool holds at least one item."""
        left, pieces = self.limits.vector(), []
        while (i := self.pool.best(left)) is not None:
            left -= self.pool.demand[i]
            pieces.append(self.pool.take(i))
        room = int(min(left[0], left[2] + 1)) if left[1] >= 1 else 0
        if room >= MIN_PIECE and (i := self.pool.longest()) is not None and self.pool.demand[i, 0] >= room + MIN_PIECE:
            document, start, ids = self.pool.take(i)
            pieces.append((document, start, ids[: 4 * room]))
            self.pool.put(_piece_demand(len(ids) // 4 - room), (document, start + room, ids[4 * room :]))
        return pieces

    def _closed(self, pieces: list, last: bool = False) -> Iterator[tuple]:
        """A filled sequence. The last one, and one that the limit of segments has closed early, is cut to powers of two,
        which need no padding."""
        total = sum(len(p[2]) // 4 for p in pieces)
        if not last and (len(pieces) < self.limits.segments or self.limits.tokens - total < MIN_PIECE):
            yield from self._emit(pieces)
            return
        pieces = list(pieces)
        while total and total != self.limits.tokens:
            size = 1 << (total.bit_length() - 1)
            part, room = [], size
            while room:
                document, start, ids = pieces.pop(0)
                if len(ids) // 4 > room:
                    pieces.insert(0, (document, start + room, ids[4 * room :]))
                    ids = ids[: 4 * room]
                part.append((document, start, ids))
                room -= len(ids) // 4
            yield from self._emit(part)
            total -= size
        if pieces:
            yield from self._emit(pieces)

    def finish(self) -> Iterator[tuple]:
        while not self.pool.empty:
            pieces = self._fill()
            yield from self._closed(pieces, self.pool.empty)


PIECES = pa.schema([("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _batches(rows: Iterator[tuple], schema: Callable[[], pa.Schema]) -> Iterator[pa.RecordBatch]:
    """Rows in batches; ``schema`` is asked for when there are rows."""

    def made(kept: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema(), strict=True)], schema=schema())

    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) == BATCH_ROWS:
            yield made(kept)
            kept = []
    if kept:
        yield made(kept)


def pack_documents(df: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0, limits: Limits = Limits(), pool: int = POOL_ITEMS) -> DataFrame:
    """Pieces of all documents (ids of the whole text, then ``end_id``) with their places in sequences. Map-only."""
    end = end_id.to_bytes(4, "little")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        packer, schema = DocumentPacker(limits, pool, TaskContext.get().partitionId() << 33), PIECES

        def rows() -> Iterator[tuple]:
            nonlocal schema
            for batch in batches:
                schema = pa.schema([pa.field("doc_id", batch.schema.field(0).type), *PIECES])
                for doc_id, string in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encode(string.as_py()) + end
                    yield from packer.add((doc_id, len(ids) // 4), ids)
            yield from packer.finish()

        yield from _batches(rows(), lambda: schema)

    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(packed, f"doc_id {type_of(df, key)}, {PIECES_DDL}")


EXAMPLES = pa.schema([("key", pa.string()), ("tokens", pa.int64()), ("segments", pa.int64()), ("loss", pa.int64()), ("sequence_id", pa.int64()), ("position", pa.int64())])


def pack_examples(df: DataFrame, key: str, tokens: str, segments: str, loss: str, limits: Limits, *, pool: int = POOL_ITEMS) -> DataFrame:
    """Instruction examples, which are never cut: key (as text), the demands, sequence_id and position in the sequence. A null
    or negative demand counts as 0. An example beyond a limit by itself fits no sequence: its sequence_id and position are
    null, so that the caller can split or truncate it."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, caps, number = Pool(limits, pool), limits.vector(), TaskContext.get().partitionId() << 33

        def one() -> Iterator[tuple]:
            nonlocal number
            left, position = limits.vector(), 0
            while (i := waiting.best(left)) is not None:
                demand = waiting.demand[i].copy()
                left -= demand
                yield waiting.take(i), *map(int, demand), number, position
                position += 1
            number += 1

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, *demand in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    vector = tuple(max(int(x or 0), 0) for x in demand)
                    if any(np.array(vector) > caps):
                        yield name, *vector, None, None
                        continue
                    waiting.put(vector, name)
                    if waiting.full:
                        yield from one()
            while not waiting.empty:
                yield from one()

        yield from _batches(rows(), lambda: EXAMPLES)

    demands = [F.col(c).cast("long") for c in (tokens, segments, loss)]
    return df.select(F.col(key).cast("string"), *demands).mapInArrow(packed, "key string, tokens long, segments long, loss long, sequence_id long, position long")


def conversation_demands(df: DataFrame, vocabulary: str, *, key: str = "conv_id", role: str = "role", text: str = "text", learned: tuple[str, ...] = ("assistant",), end_id: int = 0) -> DataFrame:
    """What each conversation takes as one example: key, tokens (of all turns, each with ``end_id``), segments (its turns) and
    loss (tokens of turns whose role is ``learned``). Null texts are empty turns; rows without a key are one conversation.
    Turns are counted where they are read, so a long conversation is added up from partial sums."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        count = encoder(vocabulary).count
        return pd.Series([count(t) + 1 for t in texts], dtype="int64")

    turns = df.select(F.col(key).alias("_key"), F.coalesce(F.col(role).isin(*learned), F.lit(False)).alias("_learned"), counted(F.col(text).cast("string")).alias("_n"))
    return turns.groupBy("_key").agg(F.sum("_n").alias("tokens"), F.count("*").alias("segments"), F.sum(F.when(F.col("_learned"), F.col("_n")).otherwise(0)).alias("loss")).withColumnRenamed("_key", key)
