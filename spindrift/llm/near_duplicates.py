"""Near-duplicate documents: DartMinHash signatures, banded joining, exact verification, connected components.

Two texts are near duplicates if the Jaccard similarity of their sets of five-word shingles is at least 0.8 (weighting
"count" makes the signatures those of shingle counts). With 35 bands of 6 coordinates a pair at 0.8 shares a band with
probability 0.99998, and more above. What shares a band is only compared, never taken as alike.

Exact copies share one node from the start. A bucket (a band's key) never expands to all its pairs. First each node is
compared with a few leaders of its buckets, which joins large groups at once. Buckets that then still hold more than one
component are finished exactly: in those of at most ``SMALL`` nodes all nodes of different components are compared; larger
ones are cut into blocks, and each pair of blocks is a group of bounded size in which all nodes of different components are
compared. Only pairs inside a bucket's largest component are left out, and pairs whose numbers of shingles alone rule the
similarity out. So every pair that shares a band is compared unless it is linked already, and no pairs come out of a block.

What a bucket is asked for (its size, leaders, components) is aggregated first and written, so that the joins with it are
plain ones: Spark broadcasts a small side and splits a hot bucket or class otherwise. The first steps are linear in bucket
entries; the last grows with the product of what is not linked in a bucket and its size, spread over groups.

Defined cases: a null text is a class of its own; texts without words (also empty ones) are alike only if equal; shorter
texts than a shingle are one shingle; repeated rows are copies of each other; an empty table gives no rows; the input's
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.components import connected_components
from spindrift.llm.dart_minhash import U, bands, shingles, signature, texts_of
from spindrift.llm.storage import discard, free_names, materialize, type_of
from spindrift.llm.worker import turn

SIMILARITY = 0.8
BANDS, ROWS = 35, 6
#: Buckets up to this many nodes are compared by a join; larger ones in blocks.
SMALL = 8
#: A block of an open bucket has about so many nodes, and so many shingles, at most.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Orders in which buckets choose a leader in the first round.
ORDERS = 3
#: Up to so many ids to drop (24 bytes each) are broadcast; beyond, Spark chooses the join.
MAX_BROADCAST_ROWS = 2_000_000
#: Texts that a task remembers, so that copies in it are hashed once.
KEPT_TEXTS = 1 << 20

_SIGNED = ("rid", "id", "h1", "h2", "bands", "shingles")


def _lists(parts: list[np.ndarray | None], dtype) -> pa.ListArray:
    lengths = [0 if p is None else len(p) for p in parts]
    values = np.concatenate([p for p in parts if p is not None] or [np.zeros(0, dtype)]).astype(dtype, copy=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([p is None for p in parts]))


def signed(df: DataFrame, *, key: str = "doc_id", text: str = "text", weighting: str = "set", n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row per document: rid (a number of its own once written), id, two hashes of the text (null for a null text),
    band keys and sorted 32-bit shingle hashes; both are null for what a task has had before or what has no words."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("near duplicates")
        rid, seen = TaskContext.get().partitionId() << 33, set()
        for batch in batches:
            h1s, h2s = (batch.column(i).to_pylist() for i in (2, 3))
            keys, sets, size, begun = [], [], 0, 0
            for i, raw in enumerate(texts_of(batch.column(1))):
                mine, found, had = None, None, (h1s[i], h2s[i])
                if raw is not None and had not in seen:
                    if len(seen) < KEPT_TEXTS:
                        seen.add(had)
                    all_of = shingles(raw)
                    if len(all_of):
                        distinct, count = np.unique(all_of, return_counts=True)
                        mine = bands(signature(distinct, n_bands * rows, count.astype(float) if weighting == "count" else None), rows).view(np.int64)
                        found = np.unique((distinct >> U(32)).astype(np.uint32)).view(np.int32)
                        size += len(found)
                keys.append(mine)
                sets.append(found)
                if size > 1 << 20 or i + 1 == batch.num_rows:
                    span = slice(begun, i + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(range(rid, rid + len(keys)), pa.int64()), batch.column(0).slice(begun, i + 1 - begun), pa.array(h1s[span], pa.int64()), pa.array(h2s[span], pa.int64()), _lists(keys, np.int64), _lists(sets, np.int32)], names=_SIGNED)
                    rid, begun, size, keys, sets = rid + len(keys), i + 1, 0, [], []

    string = F.col(text).cast("string")
    h1 = F.when(string.isNotNull(), F.xxhash64(string))
    h2 = F.when(string.isNotNull(), F.xxhash64(F.lit(1), string))
    return df.select(F.col(key), string, h1, h2).mapInArrow(made, f"rid long, id {type_of(df, key)}, h1 long, h2 long, bands array<long>, shingles array<int>")


def _near(na: Column, nb: Column, similarity: float) -> Column:
    """Whether sets of so many shingles can be that similar."""
    return F.least(na, nb) >= similarity * F.greatest(na, nb)


def _leader_pairs(entries: DataFrame, similarity: float) -> DataFrame:
    """For each node, and each of a few orders, the leader of one of its buckets that shares most buckets with it: pairs
    a, b."""
    order = [F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(i))).alias(f"l{i}") for i in range(ORDERS)]
    leaders = materialize(entries.groupBy("band").agg(*order), "leaders")
    led = entries.join(leaders, "band").select(F.col("node").alias("b"), "n", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"l{i}.node").alias("a"), F.col(f"l{i}.n").alias("na")) for i in range(ORDERS)))).alias("x"))
    led = led.where((F.col("x.a") != F.col("b")) & _near(F.col("x.na"), F.col("n"), similarity))
    shared = led.groupBy("b", "x.i", "x.a").agg(F.count("*").alias("shared"))
    pairs = shared.groupBy("b", "i").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b").distinct()
    pairs = materialize(pairs, "pairs")
    discard(leaders)
    return pairs


def _open_buckets(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries of buckets that hold more than one component, with the component."""
    known = materialize(entries.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "known")
    several = materialize(known.groupBy("band").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("band"), "several")
    opened = materialize(known.join(several, "band", "left_semi"), "open")
    discard(known)
    discard(several)
    return opened


def _small_pairs(opened: DataFrame, similarity: float) -> DataFrame:
    """All pairs of different components in small buckets."""
    few = opened.where(F.col("k") <= SMALL)
    left, right = few.select("band", F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na")), few.select("band", F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"))
    return left.join(right, "band").where((F.col("ca") < F.col("cb")) & _near(F.col("na"), F.col("nb"), similarity)).select("a", "b").distinct()


def _linked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose shingle sets have at least the similarity."""
    left, right = sets.select(F.col("rid").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("rid").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.select("a", "b").join(right, "b").join(left, "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return joined.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), both.alias("both")).where(F.col("both") >= similarity * (F.col("na") + F.col("nb") - F.col("both"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _blocks(opened: DataFrame) -> DataFrame:
    """Rows band, lo, hi, me, node, component: every two nodes of different components in a bucket meet in a group (band, lo,
    hi). A bucket's largest component has blocks of its own, numbered after the others', which never meet each other."""
    parts = opened.groupBy("band", "component").agg(F.count("*").alias("k"), F.sum(F.col("n").cast("long")).alias("n"))
    largest = F.struct("k", "component")
    buckets = parts.groupBy("band").agg(F.max_by("component", largest).alias("major"), F.max_by("k", largest).alias("mk"), F.max_by("n", largest).alias("mn"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    many = lambda k, n: F.ceil(F.greatest(k / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    buckets = buckets.select("band", "major", many(F.col("k") - F.col("mk"), F.col("n") - F.col("mn")).alias("minors"), many(F.col("mk"), F.col("mn")).alias("majors"))
    held, mix = opened.drop("n", "k").join(materialize(buckets, "buckets"), "band"), F.xxhash64("node", F.lit(0))
    major = F.col("component") == F.col("major")
    me = F.when(major, F.col("minors") + F.pmod(mix, "majors")).otherwise(F.pmod(mix, "minors")).cast("int")
    met = F.sequence(F.lit(0), F.when(major, F.col("minors")).otherwise(F.col("minors") + F.col("majors")) - 1)
    dealt = held.select("band", "node", "component", me.alias("me"), F.explode(met).alias("other"))
    return dealt.select("band", F.least("me", "other").alias("lo"), F.greatest("me", "other").alias("hi"), "me", "node", "component")


def _compared(table: pa.Table, similarity: float) -> pa.Table:
    """Links between the two blocks of a group (or in its one block) that join different components, no more than it takes."""
    node, label, me, lo, hi = (table.column(c).to_numpy().copy() for c in ("node", "component", "me", "lo", "hi"))
    column = table.column("shingles").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.diff(offsets)
    left, right = np.flatnonzero(me == lo), np.flatnonzero(me == hi)
    found: list[tuple[int, int]] = []
    if len(left) and len(right):
        held = np.concatenate([values[offsets[j] : offsets[j + 1]] for j in right])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], np.repeat(np.arange(len(right), dtype=np.int32), size[right])[order]
        for i in left:
            wanted = (label[right] != label[i]) & (size[right] >= similarity * size[i]) & (size[i] >= similarity * size[right])
            if not wanted.any():
                continue
            mine = values[offsets[i] : offsets[i + 1]]
            first, many = np.searchsorted(held, mine), np.searchsorted(held, mine, side="right")
            many -= first
            at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            both = np.bincount(owner[at], minlength=len(right))
            for j in right[wanted & (both >= similarity * (size[i] + size[right] - both))]:
                if label[i] != label[j]:
                    found.append((node[i], node[j]))
                    label[label == label[j]] = label[i]
    return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})


def _finished(opened: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All links that open buckets still need: exact, without rows for pairs."""
    rows = _blocks(opened).join(sets.select(F.col("rid").alias("node"), "shingles"), "node")
    return rows.groupBy("band", "lo", "hi").applyInArrow(lambda t: _compared(t, similarity), "u long, v long")


def near_duplicate_classes(df: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """A row per document row: id, h1 and h2 (hashes of its text), class_id (the least id in its class), class_rows (rows
    in the class) and first (whether this row is the one to keep: the least id, then the least rid)."""
    table = materialize(signed(df, key=key, text=text, weighting=weighting), "signed")
    texts = table.where("h1 is not null").groupBy("h1", "h2").agg(F.min(F.when(F.col("bands").isNotNull(), F.col("rid"))).alias("node"), F.min("rid").alias("least_rid"))
    texts = materialize(texts.select("h1", "h2", F.coalesce("node", "least_rid").alias("node")), "texts")
    banded = table.where("bands is not null").select("rid", F.size("shingles").alias("n"), "bands").join(texts, F.col("rid") == F.col("node"), "left_semi")
    entries = banded.select(F.col("rid").alias("node"), "n", F.explode("bands").alias("band"))
    # buckets of one text need no further look
    shared = materialize(entries.groupBy("band").agg(F.count("*").alias("k")).where("k > 1"), "shared")
    entries = materialize(entries.join(shared, "band"), "entries")
    discard(shared)
    # from here on only the shingles of texts that share a bucket are read
    nodes = entries.select(F.col("node").alias("rid")).distinct()
    sets = materialize(table.where("shingles is not null").select("rid", "shingles").join(nodes, "rid", "left_semi"), "sets")

    pairs = _leader_pairs(entries, similarity)
    links = materialize(_linked(pairs, sets, similarity), "links")
    labels = materialize(connected_components(links), "labels")
    opened = _open_buckets(entries, labels)
    more = materialize(_linked(_small_pairs(opened, similarity), sets, similarity), "links")
    links, used = links.unionByName(more), [table, texts, sets, entries, pairs, links, labels, more, opened]
    if not (large := opened.where(F.col("k") > SMALL)).isEmpty():
        if not more.isEmpty():
            labels = materialize(connected_components(links), "labels")
            used.append(labels)
        large = _open_buckets(large.select("node", "n", "band", "k"), labels)
        most = materialize(_finished(large, sets, similarity), "links")
        links = links.unionByName(most)
        used += [large, most]
    labels = materialize(connected_components(links), "labels")
    node = texts.join(labels, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("c"))
    rows = materialize(table.select("rid", "id", "h1", "h2").join(node, ["h1", "h2"], "left").select("rid", "id", "h1", "h2", F.coalesce("c", "rid").alias("c")), "rows")
    first = materialize(rows.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("rid").alias("rid"))).alias("f"), F.count("*").alias("class_rows")), "first")
    result = materialize(rows.join(first, "c").select("id", "h1", "h2", F.col("f.id").alias("class_id"), "class_rows", (F.col("rid") == F.col("f.rid")).alias("first")), "classes")
    for written in [*used, labels, rows, first]:
        discard(written)
    return result


def keep_first(df: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``df`` with one row of each class of near duplicates; all columns stay. Of rows that repeat both id and text the one
    whose other columns sort first is kept (maps don't count there). Texts are not shuffled unless there are more than
    ``MAX_BROADCAST_ROWS`` ids to drop."""
    string = F.col(text).cast("string")
    found = near_duplicate_classes(df, key=key, text=text, **options)
    # every null text is the first of its class
    ids = free_names(df, "_id", "_h1", "_h2")
    keys = found.groupBy(F.col("id").alias(ids[0]), F.coalesce("h1", F.lit(0)).alias(ids[1]), F.coalesce("h2", F.lit(0)).alias(ids[2])).agg(F.max("first").alias("_first"), F.count("h1").alias("_rows"))
    keys = materialize(keys.where("not _first or _rows > 1"), "dropped")
    discard(found)
    size = (lambda x: F.broadcast(x)) if keys.count() <= MAX_BROADCAST_ROWS else (lambda x: x)
    h1, h2 = F.coalesce(F.when(string.isNotNull(), F.xxhash64(string)), F.lit(0)), F.coalesce(F.when(string.isNotNull(), F.xxhash64(F.lit(1), string)), F.lit(0))
    same = F.col(key).eqNullSafe(F.col(ids[0])) & (h1 == F.col(ids[1])) & (h2 == F.col(ids[2]))
    once = df.join(size(keys.select(*ids)), same, "left_anti")
    again = df.join(size(keys.where("_first").select(*ids)), same, "left_semi")
    order = F.struct(*(F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))
    again = again.groupBy(F.col(key).alias(ids[0]), F.xxhash64(string).alias(ids[1]), F.xxhash64(F.lit(1), string).alias(ids[2])).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), order).alias("_row"))
    return once.unionByName(again.select("_row.*"))
