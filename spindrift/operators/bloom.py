"""Blocked Bloom filters of built-in functions only, as tables that are joined, never collected.

A key's hash picks a block of 2**15 bits; all of its k bits lie there, so that a probe is one equi-join on the block and
k bit tests. Blocks are kept as words of 64 bits: Spark reads one of an array in place, but copies a whole binary for each
row. A filter of n rows at rate p has about n * |ln p| / (ln 2)**2 bits: 1.2 bytes a row at 1 %.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 1 << 15
WORD_BITS = 64
#: Filters up to this many bytes are broadcast; a larger one is joined as Spark chooses.
MAX_BROADCAST_BYTES = 32 << 20
#: Rows of the keys that a task makes blocks of. It gets all keys of its blocks: were blocks made where keys lie, each task would
#: send nearly the whole filter, and what is shuffled would grow with tasks times rows.
DEALT_ROWS = 500_000


def parameters(rows: int, rate: float) -> tuple[int, int]:
    """Bits a key sets, and blocks."""
    k = max(1, math.ceil(math.log(1 / rate) / math.log(2)))
    bits = math.ceil(max(rows, 1) * abs(math.log(rate)) / math.log(2) ** 2)
    return k, max(1, math.ceil(1.1 * bits / BLOCK_BITS))


def _block(keys: Sequence[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("long")


def _bits(keys: Sequence[Column], k: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i + 1), *keys), F.lit(BLOCK_BITS)).cast("long") for i in range(k)]


def build(df: DataFrame, keys: Sequence[str], rows: int, rate: float = 0.01) -> DataFrame:
    """Columns block and words (512 of 64 bits). ``rows`` is the number expected; more only raise the rate."""
    k, blocks = parameters(rows, rate)
    there = df.where(F.expr(" and ".join(f"`{c}` is not null" for c in keys)))
    dealt = there.select(_block([F.col(c) for c in keys], blocks).alias("block"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys))).repartition(max(1, math.ceil(rows / DEALT_ROWS)), "block")
    rows_of = dealt.select("block", F.explode(F.array(*_bits([F.col(f"_k{i}") for i in range(len(keys))], k))).alias("bit"))
    bitmaps = rows_of.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
    word = lambda i: F.conv(F.hex(F.substring("bitmap", i * (WORD_BITS // 8) + 1, F.lit(WORD_BITS // 8))), 16, -10).cast("long")
    return bitmaps.select("block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // WORD_BITS - 1)), word).alias("words"))


def probe(df: DataFrame, keys: Sequence[str], bloom: DataFrame, rows: int, rate: float = 0.01) -> DataFrame:
    """Rows of ``df`` whose keys may be in the filter: all that are, and about ``rate`` of the others."""
    k, blocks = parameters(rows, rate)
    columns = [F.col(c) for c in keys]
    filter_ = bloom.select(F.col("block").alias("_block"), F.col("words").alias("_words"))
    if blocks * BLOCK_BITS // 8 <= MAX_BROADCAST_BYTES:
        filter_ = F.broadcast(filter_)
    joined = df.withColumn("_at", _block(columns, blocks)).join(filter_, F.col("_at") == F.col("_block"))
    for bit in _bits(columns, k):
        word = F.get("_words", F.shiftright(bit, 6).cast("int"))
        # a word's first byte is its highest
        joined = joined.where(F.getbit(word, bit.bitwiseAND(F.lit(WORD_BITS - 1)).bitwiseXOR(F.lit(WORD_BITS - 8)).cast("int")) == 1)
    return joined.select(*df.columns)


def prefilter(probe_side: DataFrame, probe_keys: Sequence[str], build_side: DataFrame, build_keys: Sequence[str], *, rows: int, rate: float = 0.01, max_rows: int = 20_000_000) -> DataFrame:
    """``probe_side`` without most rows that find no partner; unchanged if the build side has more than ``max_rows``."""
    if rows > max_rows:
        return probe_side
    return probe(probe_side, probe_keys, build(build_side, build_keys, rows, rate), rows, rate)
