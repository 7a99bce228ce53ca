"""Benchmark decontamination: the windows of test items as a hash set, looked up for every token window of the corpus.

DataFrame operations only. The windows of a document are rows of a generated sequence that never leave their stage: each is
hashed where it stands and looked up in the broadcast hash table of the items' windows, in compiled code; hits are verified
word by word. Only verified windows and one row per document are shuffled. Where the items' windows are more than
``MAX_BROADCAST_BYTES``, a bit table of them (a literal of the plan, of bounded size) leaves few windows, and these are joined
with the items' in whatever way Spark chooses.

Words are ``WORD`` after A-Z are lower-cased. A window is ``n`` consecutive words of an item; an item of fewer words, but
not none, is one window. Defined cases: a null or empty text has no words, no hit and no items; a null item id never
counts as an item, though its windows hit; repeated document rows give a row each; repeated items count once; with an
empty benchmark nothing is hit; no columns but those named are read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.storage import free_names, materialize

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: Bits of the table for each window, and in all; with more windows than fit, more of a document's go to the join.
BITS_PER_WINDOW, MAX_TABLE_BITS = 32, 1 << 25
#: Up to this many bytes the windows themselves are broadcast; beyond, Spark chooses the join.
MAX_BROADCAST_BYTES = 64 << 20
#: Up to so many contaminated documents (16 bytes each) are broadcast to remove them; beyond, Spark chooses the join.
MAX_BROADCAST_ROWS = 2_000_000


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text: Column) -> Column:
    between = WORD.replace("([^", "[").replace("+)", "+")  # splitting there is faster than finding the words themselves
    return F.coalesce(F.array_remove(F.split(lower_ascii(text.cast("string")), between), ""), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, n: int, *, item: str = "item_id", text: str = "text") -> DataFrame:
    """Columns gram (its words) and items (the ids, as strings, of the items that have it)."""
    listed = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    return listed.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("gram")).groupBy("gram").agg(F.collect_set("item").alias("items"))


def _passes(table: Column, bits: int, h: Column) -> Column:
    """Whether both of the hash's bits are set."""

    def on(place: Column) -> Column:
        return F.getbit(F.element_at(table, (F.shiftright(place, 6) + 1).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

    return on(h.bitwiseAND(F.lit(bits - 1))) & on(F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))


def _hash(w: Column, start: Column, k: int) -> Column:
    """Of the k words of w from ``start`` (from 0)."""
    return F.xxhash64(*(w[start + j] for j in range(k)))


def _gram_hash(lengths: list[int]) -> Column:
    found = [F.when(F.size("gram") == k, _hash(F.col("gram"), F.lit(0), k)) for k in lengths]
    return F.coalesce(*found, F.lit(None).cast("long"))


def _table(grams: DataFrame, count: int) -> tuple[Column, int]:
    """The windows' bit table, as a literal array of longs. The words of the table, at most ``MAX_TABLE_BITS`` / 64, are made
    in an aggregate."""
    bits = 1 << min(max(10, (count * BITS_PER_WINDOW - 1).bit_length()), MAX_TABLE_BITS.bit_length() - 1)
    places = grams.select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1)))).alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("x")).collect()
    longs = [0] * (bits // 64)
    for i, x in words:
        longs[i] = x
    return F.expr(f"cast(split('{','.join(map(str, longs))}', ',') as array<bigint>)"), bits


def find_leaks(documents: DataFrame, benchmark: DataFrame, *, n: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per document row: key, text_hash, n_words, n_hit (words inside any occurrence of a window), spans (the
    hits as [first word, end) pairs, from 0), items (sorted ids of the items with occurring windows)."""
    grams = item_windows(benchmark, n, item=item, text=item_text)
    lengths = {r[0]: (r[1], r[2]) for r in grams.groupBy(F.size("gram").alias("n")).agg(F.count("*"), F.sum(F.octet_length(F.array_join("gram", " ")))).collect()}  # at most n rows
    count, size = (sum(x[i] for x in lengths.values()) for i in (0, 1))

    string = F.col(text).cast("string")
    listed = documents.select(F.col(key).alias("_key"), F.xxhash64(string).alias("_hash"), F.octet_length(string).alias("_bytes"), words(F.col(text)).alias("w"))
    # a row with s = -1 stands for the document itself
    starts = listed.select("_key", "_hash", "_bytes", "w", F.size("w").alias("n_words"), F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("s"))
    one = {k: F.when((F.col("s") >= 0) & (F.col("s") + k <= F.col("n_words")), _hash(F.col("w"), F.col("s"), k)) for k in sorted(lengths)}
    grams = grams.select("gram", "items", F.size("gram").alias("n"), _gram_hash(sorted(lengths)).alias("h"))
    if size > MAX_BROADCAST_BYTES:
        table = _table(grams, count)
        starts = starts.where(reduce(or_, (_passes(*table, h) for h in one.values()), F.col("s") < 0))
    else:
        grams = F.broadcast(grams)
    if len(lengths) > 1:
        each = F.array(*(F.struct(F.lit(k).alias("k"), h.alias("h")) for k, h in one.items()))
        none = F.array(F.struct(F.lit(0).alias("k"), F.lit(None).cast("long").alias("h")))
        starts = starts.select("*", F.explode(F.when(F.col("s") < 0, none).otherwise(each)).alias("x")).select("_key", "_hash", "_bytes", "w", "n_words", "s", "x.k", "x.h")
    else:
        starts = starts.select("*", F.lit(min(lengths, default=0)).alias("k"), (*one.values(), F.lit(None).cast("long"))[0].alias("h"))
    same = (F.col("gram") == F.when(F.col("s") >= 0, F.slice("w", F.col("s") + 1, F.col("k")))) & (F.col("n") == F.col("k"))
    joined = starts.join(grams, "h", "left").where((F.col("s") < 0) | (F.col("gram").isNotNull() & same)).drop("w")

    span = F.when(F.col("s") >= 0, F.struct(F.col("s"), (F.col("s") + F.col("k")).alias("e")))
    by = joined.groupBy("_key", "_hash", "_bytes").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum((F.col("s") < 0).cast("int")).alias("copies"),
        F.sort_array(F.collect_set(span)).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    hit = F.aggregate("hits", F.named_struct(F.lit("e"), F.lit(0), F.lit("n"), F.lit(0).cast("long")), lambda a, x: F.named_struct(F.lit("e"), F.greatest(a["e"], x["e"]), F.lit("n"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["e"], x["s"])))), lambda a: a["n"])
    return by.select(F.col("_key").alias(key), F.col("_hash").alias("text_hash"), "n_words", hit.alias("n_hit"), F.col("hits").alias("spans"), "items", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")


def leak_report(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    found = find_leaks(documents, benchmark, key=key, **options)
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def remove_documents(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``documents`` without those that hold a window of the benchmark; all columns stay. Texts are not shuffled unless there
    are more than ``MAX_BROADCAST_ROWS`` of those."""
    k, h = free_names(documents, "_bad_key", "_bad_hash")
    bad = find_leaks(documents, benchmark, key=key, text=text, **options).where("n_hit > 0").select(F.col(key).alias(k), F.col("text_hash").alias(h)).distinct()
    bad = materialize(bad, "contaminated")
    if bad.count() <= MAX_BROADCAST_ROWS:
        bad = F.broadcast(bad)
    return documents.join(bad, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(F.col(text).cast("string")) == F.col(h)), "left_anti")


def remove_spans(documents: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", mark: str = " ", **options) -> DataFrame:
    """``documents`` with each run of hit words, from its first to its last word, replaced by ``mark``. Every
    other character stays as it is."""
    k, h, spans = free_names(documents, "_bad_key", "_bad_hash", "_bad_spans")
    bad = find_leaks(documents, benchmark, key=key, text=text, **options).where("n_hit > 0").select(F.col(key).alias(k), F.col("text_hash").alias(h), F.col("spans").alias(spans)).dropDuplicates([k, h])
    joined = documents.join(bad, F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(F.col(text).cast("string")) == F.col(h)), "left")
    any_word = F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)")
    # what stands before each word: gaps has one entry more than there are words
    gaps, found = F.split(F.col(text), any_word), F.regexp_extract_all(F.col(text), any_word, 1)
    kept = F.zip_with(gaps, F.concat(found, F.array(F.lit(""))), lambda g, w: F.named_struct(F.lit("g"), g, F.lit("w"), w))

    def hit(i: Column) -> Column:
        return F.exists(spans, lambda s: (s["s"] <= i) & (i < s["e"]))

    put = F.transform(kept, lambda x, i: F.when(~hit(i), F.concat(x["g"], x["w"])).when(hit(i - 1), F.lit("")).otherwise(F.concat(x["g"], F.lit(mark))))
    return joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.array_join(put, ""))).select(*documents.columns)
