import io

import pytest
from pyspark.sql import functions as F

from spindrift import cli
from spindrift.config import EngineConfig, Mode, Prefilter, TransferOrder
from spindrift.functions.expressions import call, col, lit
from spindrift.operators import bloom
from spindrift.operators.pruning import prune
from spindrift.plans import features, metrics, modes, workload
from spindrift.plans.joingraph import Edge, JoinGraph, co_located, estimated_rows
from spindrift.plans.engine import Engine, places
from spindrift.plans.sql import normalise, run_sql, tables_in
from spindrift.sources import files
from spindrift.sources.cache import SegmentCache
from spindrift.sources.catalog import Catalog, Table, collect_rows, collect_zones
from spindrift.sources.policies import LFU, LRU, Belady, LFUSize, SegmentKey, WeightedLFU, pushdown_weight

D = "/root/testdata/sf0.001"


def test_normalise():
    assert normalise("select \"value\" from \"date\" where x = 'it''s \"q\"';") == "select `value` from `date` where x = 'it''s \"q\"'"
    assert normalise("d - interval '90' day (3)") == "d - interval '90' day"
    assert normalise("select 'day (3)' -- \"c\"\n") == "select 'day (3)' -- \"c\""
    assert tables_in("SELECT * FROM Orders o, lineitem") == ("orders", "lineitem")


def test_pruning():
    zones = {"a": {"x": (0, 9), "y": (1, 1)}, "b": {"x": (10, 19)}, "c": {}}
    less = call("gt", lit(10), col("x"))
    assert set(prune(less, zones)) == {"a", "c"}
    assert prune(None, zones) == {"a": None, "b": None, "c": None}
    either = call("or", call("eq", col("x"), lit(12)), call("eq", col("y"), lit(1)))
    kept = prune(either, zones)
    assert kept["a"]["op"] == "eq" and kept["a"]["args"][0] == col("y") and kept["b"]["op"] == "or"
    assert set(prune(call("and", less, call("ne", col("y"), lit(1))), zones)) == {"c"}
    assert set(prune(call("in", col("x"), values=[11, 30]), zones)) == {"b", "c"}
    assert prune(call("between", col("x"), lit(100), lit(200)), {"a": zones["a"]}) == {}
    assert set(prune(call("eq", col("x"), lit("text")), zones)) == {"a", "b", "c"}


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("zones"))
    spark.read.parquet(f"{D}/lineitem.parquet").repartitionByRange(4, "l_quantity").write.parquet(f"{folder}/lineitem.parquet")
    table = Catalog.from_folder(spark, folder, ["lineitem"])["lineitem"]
    collect_rows(spark, table)
    collect_zones(spark, table, ["l_quantity", "l_returnflag"])
    return table


def test_modes_agree(spark, lines):
    predicate = call("and", call("lt", col("l_quantity"), lit(11.0)), call("eq", col("l_returnflag"), lit("R")))
    columns = ["l_orderkey", "l_tax"]
    assert 0 < len(prune(predicate, lines.zones)) < len(lines.paths)
    rows = {}
    for mode in Mode:
        cache = SegmentCache(spark, LRU(1 << 30))
        for again in range(2):
            cache.new_query()
            df = modes.scan(spark, lines, predicate, columns, EngineConfig(mode=mode), cache)
            rows[mode, again] = sorted(map(tuple, df.collect()))
            if mode is Mode.CACHING_ONLY:
                assert cache.query.hit_ratio == again
        if mode is Mode.HYBRID:
            cache.new_query()
            wider = modes.scan(spark, lines, predicate, [*columns, "l_discount"], EngineConfig(mode=mode), cache)
            assert len(wider.collect()) == len(rows[mode, 0]) and 0 < cache.query.hit_ratio < 1
        cache.clear()
        assert not cache.frames and cache.policy.free == cache.policy.capacity
    assert len({str(v) for v in rows.values()}) == 1 and rows[Mode.PULL_UP, 0]
    none = call("gt", col("l_quantity"), lit(1e9))
    assert modes.pushed_down(spark, lines, none, columns).count() == 0
    pulled, pushed = (metrics.of_plan(modes.scan(spark, lines, predicate, columns, EngineConfig(mode=m))) for m in (Mode.PULL_UP, Mode.PUSHDOWN_ONLY))
    assert not any("l_quantity" in f for f in pulled.pushed_filters) and any("l_quantity" in f for f in pushed.pushed_filters)
    by_bitmap = modes.scan_by_bitmap(spark, lines, modes.filter_bitmap(spark, lines, predicate), columns)
    assert sorted(map(tuple, by_bitmap.collect())) == rows[Mode.PULL_UP, 0]


def test_small_cache_evicts_and_agrees(spark, lines):
    column = lines.rows / len(lines.paths) * 8
    cache = SegmentCache(spark, LRU(3 * column))
    for columns in (["l_tax"], ["l_discount", "l_tax"], ["l_orderkey", "l_suppkey", "l_partkey", "l_tax"], ["l_tax"]):
        got = modes.cached(spark, lines, None, columns, cache).agg(F.count("*"), *(F.round(F.sum(c), 2) for c in columns)).first()
        assert got == lines.read(spark).agg(F.count("*"), *(F.round(F.sum(c), 2) for c in columns)).first()
    assert cache.total.evicted and cache.policy.free >= 0
    cache.clear()


def test_blocks_of_many_partitions(spark, lines):
    read = lambda cache, columns, predicate=None: sorted(map(tuple, modes.cached(spark, lines, predicate, columns, cache).collect()))
    cache = SegmentCache(spark, LRU(1 << 30))
    one, three = ["l_tax"], ["l_orderkey", "l_suppkey", "l_tax"]
    assert read(cache, one) == sorted(map(tuple, lines.read(spark).select(*one).collect()))
    assert len(set(cache.frames.values())) == 1 and len(cache.frames) == len(lines.paths) > 2
    assert read(cache, three) == sorted(map(tuple, lines.read(spark).select(*three).collect()))
    # one block for each set of columns that came, and one scan for all partitions
    assert len(set(cache.frames.values())) == 2
    plan = modes.cached(spark, lines, None, three, cache)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InMemoryRelation") == 2 and "Union" not in plan
    cache.clear()
    # evicted partitions leave a block; it is rewritten once half of it is gone, and goes with its last segment
    cache = SegmentCache(spark, LRU(len(lines.paths) * cache.size(lines, "l_tax")))
    read(cache, one)
    block = next(iter(cache.frames.values()))
    before = block.size
    for n, path in enumerate(lines.paths, 1):
        cache.store(lines, {path: ["l_discount"]})
        assert sum(k.column == "l_tax" for k in cache.frames) == len(lines.paths) - n
        assert block.size == before or 2 * block.size <= before
        assert read(_frozen_view(cache), one) == sorted(map(tuple, lines.read(spark).select(*one).collect()))
    assert block not in cache.frames.values() and not block.frame.is_cached
    cache.clear()


def test_cached_partitions_may_be_folders(spark, tmp_path):
    for i in range(2):
        spark.range(i * 100, i * 100 + 60).withColumn("x", F.col("id") * 2).repartition(3).write.parquet(f"{tmp_path}/a b/t.{i}")
    table = Table("t", "parquet", [f"{tmp_path}/a b/t.{i}" for i in range(2)], spark.read.parquet(f"{tmp_path}/a b/t.0").schema, rows=120)
    cache = SegmentCache(spark, LRU(1 << 20))
    cache.store(table, {table.paths[0]: ["id"], table.paths[1]: ["id", "x"]})
    for mode in Mode:
        rows = modes.scan(spark, table, call("lt", col("id"), lit(110)), ["x"], EngineConfig(mode=mode), cache).collect()
        assert sorted(r.x for r in rows) == [2 * i for i in (*range(60), *range(100, 110))], mode
    cache.clear()


def _frozen_view(cache):
    """The same held segments, to which nothing is added."""
    view = SegmentCache(cache.spark, LRU(0), frozen=True)
    view.frames = cache.frames
    return view


def key(c):
    return SegmentKey("t", "p", c)


def play(policy, text, sizes=None):
    hits = 0
    for c in text:
        policy.on_new_query()
        policy.on_load(key(c))
        if key(c) in policy.held:
            hits += 1
        elif policy.to_cache([key(c)]):
            policy.on_store(key(c), (sizes or {}).get(c, 1))
    return hits


def test_policies():
    assert play(LRU(2), "abacab") == 2 and play(LRU(2), "aabbcc") == 3
    lfu = LFU(1)
    assert play(lfu, "aaab") == 2 and key("a") in lfu.held and lfu.on_store(key("b"), 1) is None
    assert play(LFUSize(4), "aabb", {"a": 4, "b": 1}) == 2
    weighted = WeightedLFU(1)
    weighted.on_weight(key("a"), 1)
    weighted.on_store(key("a"), 1)
    weighted.on_weight(key("b"), 5)
    assert weighted.on_store(key("b"), 1) == [key("a")]
    text = "abcabcabdabc"
    best = play(Belady(2, [{key(c)} for c in text]), text)
    assert best >= max(play(LRU(2), text), play(LFU(2), text))
    assert LRU(1).on_store(key("x"), 2) is None
    assert pushdown_weight(0.5, 100, 8, 2, 1) > pushdown_weight(0.1, 100, 8, 1, 1)


def test_workloads():
    parts = [str(i) for i in range(50)]
    assert len(workload.skewed(parts, 40, 1.2, 3)) == 40 and all(len(q) == 3 for q in workload.uniform(parts, 5, 3))
    often = [q[0] for q in workload.skewed(parts, 3000, 1.5)]
    assert often.count("0") > 10 * max(often.count("40"), 1)
    assert workload.recurring(parts, 6, 2)[:2] == workload.recurring(parts, 6, 2)[4:]
    assert sum(q == parts[:1] for q in workload.hot(parts, 1000, 0.9)) > 800


def test_bloom(spark):
    build = spark.range(0, 3000, 3).withColumnRenamed("id", "k").unionByName(spark.createDataFrame([(None,)], "k long"))
    probe = spark.range(0, 20000).withColumnRenamed("id", "k")
    kept = {r.k for r in bloom.prefilter(probe, ["k"], build, ["k"], rows=1000).collect()}
    assert set(range(0, 3000, 3)) <= kept and len(kept) < 1000 + 0.03 * 19000
    assert bloom.prefilter(probe, ["k"], build, ["k"], rows=1000, max_rows=10) is probe
    assert bloom.prefilter(probe, ["k"], build.limit(0), ["k"], rows=0).count() == 0


def test_bloom_filters_are_words_that_are_read_in_place(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    k, blocks = bloom.parameters(4 * 1000, 0.01)
    filter_ = bloom.build(keys, ["k"], 4 * 1000, 0.01)
    assert dict(filter_.dtypes) == {"block": "bigint", "words": "array<bigint>"}  # a binary would be copied for each row
    found = {(r.block, i * 64 + j) for r in filter_.collect() for i, w in enumerate(r.words) for j, x in enumerate(reversed(f"{w % 2**64:064b}")) if x == "1"}
    want = keys.select(bloom._block([F.col("k")], blocks).alias("block"), F.explode(F.array(*bloom._bits([F.col("k")], k))).alias("bit")).collect()
    assert blocks > 1 and found == {(r.block, r.bit ^ 56) for r in want}  # a word's first byte is its highest
    every = spark.range(20000).withColumnRenamed("id", "k")
    kept = {r.k for r in bloom.probe(every, ["k"], filter_, 4 * 1000, 0.01).collect()}
    bits: dict[int, set] = {}
    for r in every.select("k", bloom._block([F.col("k")], blocks).alias("block"), F.array(*bloom._bits([F.col("k")], k)).alias("bits")).collect():
        bits[r.k] = {(r.block, b ^ 56) for b in r.bits}
    assert kept == {n for n, b in bits.items() if b <= found}


def test_bloom_filters_are_dealt_by_block_before_bits_are_made(spark):
    keys = spark.range(0, 4000, 1, 8).select(F.col("id").alias("block"), (F.col("id") % 7).alias("other"))
    plan = bloom.build(keys, ["block", "other"], 3 * bloom.DEALT_ROWS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate explode") < plan.index("Exchange")  # printed from the last step on
    assert "hashpartitioning(block" in plan and ", 3), REPARTITION_BY_NUM" in plan
    kept = bloom.prefilter(keys, ["block", "other"], keys.where("block < 1000"), ["block", "other"], rows=1000)
    assert set(range(1000)) <= {r.block for r in kept.collect()} and kept.count() < 1000 + 0.03 * 3000


def test_predicate_transfer_reduces_and_keeps_answers(spark):
    graph = features.q05_graph(spark, D)
    want = graph.join(graph.order()).count()
    for how, order in ((Prefilter.BLOOM, TransferOrder.BREADTH_FIRST), (Prefilter.SEMI, TransferOrder.SMALL_TO_LARGE)):
        reduced = graph.transfer(EngineConfig(prefilter=how, transfer_order=order))
        assert reduced.join(reduced.order()).count() == want
        m = metrics.of_transfer(graph, reduced)
        assert m.removed > 0 and 0 < m.rows_after["nation"] <= 5
    assert graph.order()[0] == "region" and graph.transfer(EngineConfig()) is graph
    directed = [(a, b) for a, b, _ in graph.small_to_large()]
    assert all(graph.size(a) < graph.size(b) for a, b in directed) and len(graph.breadth_first()) == 5


def test_joins_that_multiply_rows_come_last(spark):
    order = features.q05_graph(spark, "/root/testdata/sf0.01").order()
    assert order.index("customer") > order.index("orders") > order.index("lineitem")  # not by the supplier's nation alone
    a = spark.range(40).selectExpr("id AS x", "id % 4 AS g")
    b = spark.range(60).selectExpr("id AS y", "id % 40 AS x_of_y", "id % 4 AS h")
    c = spark.range(900).selectExpr("id AS z", "id % 60 AS y_of_z", "nullif(id % 40, 0) AS x_of_z")
    edges = [Edge("a", "b", ("g",), ("h",)), Edge("b", "c", ("y",), ("y_of_z",)), Edge("a", "c", ("x",), ("x_of_z",))]
    graph = JoinGraph({"a": a, "b": b, "c": c}, {"a": 40, "b": 60, "c": 900}, edges).count_keys()
    assert graph.times(edges[0]) == pytest.approx(10, rel=0.1) and graph.times(edges[1]) == graph.times(edges[2]) == 1.0
    assert graph.order() == ["a", "c", "b"] and graph.join(graph.order()).count() == graph.join(["a", "b", "c"]).count()
    # keys that repeat in the smaller relation but not in the larger one multiply nothing
    few = spark.range(20).selectExpr("id % 2 AS k")
    assert JoinGraph({"few": few, "a": a}, {"few": 20, "a": 40}, [one := Edge("few", "a", ("k",), ("x",))]).count_keys().times(one) == 1.0


@pytest.mark.parametrize(("how", "by"), [(Prefilter.SEMI, TransferOrder.BREADTH_FIRST), (Prefilter.BLOOM, TransferOrder.BREADTH_FIRST), (Prefilter.BLOOM, TransferOrder.SMALL_TO_LARGE)])
def test_reduced_graphs_join_by_keys_that_do_not_multiply(spark, how, by):
    order = features.q05_graph(spark, "/root/testdata/sf0.01").transfer(EngineConfig(prefilter=how, transfer_order=by)).order()
    assert order.index("customer") > order.index("orders")


def test_keys_of_an_edge_are_sent_once(spark):
    a = spark.range(8).selectExpr("id AS x")
    b = spark.range(4000).selectExpr("if(id % 100 = 0, id % 400 / 100, 3) AS x_of_b", "id AS y_of_b")  # 3 is in nearly all rows
    c = spark.range(5000).selectExpr("id AS y")
    edges = [Edge("a", "b", ("x",), ("x_of_b",)), Edge("b", "c", ("y_of_b",), ("y",))]
    graph = JoinGraph({"a": a, "b": b, "c": c}, {"a": 8, "b": 4000, "c": 5000}, edges)
    reduced = graph.transfer(EngineConfig(prefilter=Prefilter.SEMI, transfer_order=TransferOrder.BREADTH_FIRST))
    sent = reduced.relations["a"]._jdf.queryExecution().analyzed().right()
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sent).collectAsList()
    assert rows.size() == 4 and {r.x for r in reduced.relations["a"].collect()} == {0, 1, 2, 3}


@pytest.mark.parametrize("mode", [Mode.CACHING_ONLY, Mode.HYBRID])
def test_stitching_deals_rows_by_their_number(spark, monkeypatch, mode):
    from spindrift.sources import cache as of

    monkeypatch.setattr(of, "STITCHED_ROWS", 300)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = Catalog.from_folder(spark, D, ["lineitem"])["lineitem"]
        plain = table.read(spark).select("l_discount", "l_quantity")
        for first in (["l_discount"], ["l_discount", "l_tax"]):
            cache = SegmentCache(spark, LRU(1 << 30))
            for c in first:
                modes.scan(spark, table, None, [c], EngineConfig(mode=Mode.CACHING_ONLY), cache)
            cache.frozen = True
            stitched = modes.scan(spark, table, None, ["l_discount", "l_quantity", *first[1:]], EngineConfig(mode=mode), cache)
            # with four shuffle partitions a task would get a quarter of both sides, however many rows there are
            assert stitched.rdd.getNumPartitions() >= plain.count() / 300 and stitched.rdd.glom().map(len).max() < 600
            assert sorted(stitched.select("l_discount", "l_quantity").collect()) == sorted(plain.collect())
            cache.clear()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_outer_joins_are_never_reduced_wrongly(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "x long")
    b = spark.createDataFrame([(2,), (3,), (None,)], "y long")
    for how, n in (("left", 3), ("right", 3), ("full", 5), ("inner", 1), ("left_semi", 1)):
        graph = JoinGraph({"a": a, "b": b}, {"a": 3, "b": 3}, [Edge("a", "b", ("x",), ("y",), how)])
        for pre in Prefilter:
            assert graph.transfer(EngineConfig(prefilter=pre)).join().count() == n
        assert graph.join(["b", "a"]).count() == n if how != "left_semi" else True


def test_co_location_and_adaptive_decision():
    edge = Edge("o", "l", ("ok",), ("lk",))
    assert co_located([edge], {"o": "ok", "l": "lk"}) == [edge] and co_located([edge], {"o": "ok"}) == []
    assert estimated_rows(edge, {"o": 10, "l": 40}, {"o": "ok", "l": "lk"}) == 20
    assert modes.push_down_now(1, 0, 2, 0, 4) and not modes.push_down_now(1, 5, 2, 4, 4) and not modes.push_down_now(1, 1, 2, 4, 4) and modes.push_down_now(1, 4.5, 2, 9, 4)


def test_bucketed_join_needs_no_exchange(spark):
    try:
        o = files.bucket(spark.read.parquet(f"{D}/orders.parquet"), "spindrift_orders", 4, "o_orderkey")
        line = files.bucket(spark.read.parquet(f"{D}/lineitem.parquet"), "spindrift_lines", 4, "l_orderkey")
        joined = line.hint("merge").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        assert metrics.of_plan(joined).exchanges == 0 and joined.count() == line.count()
    finally:
        for t in ("spindrift_orders", "spindrift_lines"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_metadata_catalog(spark, tmp_path):
    (tmp_path / "t_sharded").mkdir()
    for i, text in enumerate(("A|B|D\n1|x|2020-01-02\n", "A|B|D\n2||2021-01-02\n")):
        (tmp_path / f"t_sharded/t.tbl.{i}").write_text(text)
    meta = {
        "schema.json": '{"schemaName": "s", "tables": [{"name": "T", "format": {"name": "csv", "fieldDelimiter": "|"}, "numPartitions": 2, "fields": [{"name": "A", "type": "int64"}, {"name": "B", "type": "string"}, {"name": "D", "type": "date"}]}]}',
        "stats.json": '{"tables": [{"name": "T", "stats": {"rowCount": 2, "apxColumnLength": {"A": 8, "B": 3, "D": 8}}}]}',
        "zoneMap.json": '{"tables": [{"name": "T", "zoneMap": [{"field": "A", "valuePairs": [{"min": 1, "max": 1}, {"min": 2, "max": 2}]}]}]}',
        "hash_keys.json": '{"hashKeys": [{"table": "T", "key": "A"}]}',
    }
    table = Catalog.from_metadata(meta.get, f"file://{tmp_path}")["t"]
    assert table.rows == 2 and table.hash_key == "a" and table.column_bytes["b"] == 3
    assert sorted((r.a, r.b) for r in table.read(spark).collect()) == [(1, "x"), (2, None)]
    predicate = call("eq", col("a"), lit(2))
    assert list(prune(predicate, table.zones)) == [table.paths[1]]
    assert [r.b for r in modes.pushed_down(spark, table, predicate, ["b"]).collect()] == [None]
    with pytest.raises(ValueError, match="no table"):
        Catalog({})["x"]


def test_prompt(spark, tmp_path):
    (tmp_path / "q.sql").write_text('select count(*) as "n" from nation;')
    out = io.StringIO()
    cli.serve(spark, D, iter(["sql select r_name\n", "from region where r_regionkey = 1;\n", f"file {tmp_path}/q.sql;\n", "sql select broken from;\n", "what;\n", "quit\n", "sql select 1;\n"]), out)
    text = out.getvalue()
    assert "AMERICA" in text and "25" in text and text.count("error:") == 1 and "unknown command" in text and text.count(" s\n") == 2


def test_prompt_with_options(spark):
    folder, config = cli.options([D, "--mode", "hybrid", "--prefilter", "semi", "--cache-bytes", "1000000", "--no-zone-maps"])
    assert folder == D and config == EngineConfig(mode=Mode.HYBRID, prefilter=Prefilter.SEMI, cache_bytes=1000000, zone_maps=False)
    assert cli.options([D]) == (D, None)
    out = io.StringIO()
    cli.serve(spark, D, iter(["sql select r_name, count(*) as n from region, nation where r_regionkey = n_regionkey and r_name = 'ASIA' group by r_name;\n"] * 2), out, config)
    assert out.getvalue().count("ASIA") == 2 and "error" not in out.getvalue()


def test_zones_with_nan_agree_in_every_mode(spark, tmp_path):
    nan = float("nan")
    for i, values in enumerate(([1.0, 20.0, nan], [2.0, 3.0], [nan], [None, 4.0])):
        spark.createDataFrame([(i, v) for v in values], "k int, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    for predicate, n in ((call("gt", col("x"), lit(5.0)), 3), (call("le", col("x"), lit(3.0)), 3), (call("eq", col("x"), lit(nan)), 2), (call("ne", col("x"), lit(4.0)), 6), (call("in", col("x"), values=[4.0, 20.0]), 2), (call("lt", col("x"), lit(nan)), 5)):
        for mode in Mode:
            table = Catalog.from_folder(spark, str(tmp_path), ["t"])["t"]
            collect_rows(spark, table)
            collect_zones(spark, table, ["x"])
            cache = SegmentCache(spark, LRU(1 << 30))
            assert modes.scan(spark, table, predicate, ["k"], EngineConfig(mode=mode), cache).count() == n, (predicate, mode)
            cache.clear()


def test_equal_file_names_and_hive_columns(spark, tmp_path):
    spark.range(80).selectExpr("id", "id % 8 as p", "id * 1.0D as x").repartition(1).write.partitionBy("p").parquet(f"{tmp_path}/t.parquet")
    table = Catalog.from_folder(spark, str(tmp_path), ["t"])["t"]
    names = {p.rsplit("/", 1)[1] for p in table.paths}
    assert len(table.paths) == 8 and len(names) == 1
    collect_rows(spark, table)
    assert len(collect_zones(spark, table, ["x", "p"])) == 8
    predicate = call("and", call("eq", col("p"), lit(3)), call("gt", col("x"), lit(40.0)))
    assert len(prune(predicate, table.zones)) == 1
    for mode in Mode:
        rows = modes.scan(spark, table, predicate, ["id", "p"], EngineConfig(mode=mode), SegmentCache(spark, LRU(1 << 30))).collect()
        assert sorted((r.id, r.p) for r in rows) == [(43, 3), (51, 3), (59, 3), (67, 3), (75, 3)], mode


def test_places_of_tables_in_a_text():
    pieces, names = places("select part.x, 'from orders' from part, orders o -- join part\n join nation as n on a = part.b where x in (select 1 from part) and orders = 2", {"part", "orders", "nation"})
    assert names == ["part", "orders", "nation", "part"]
    assert "".join(f"<{p}>" if isinstance(p, int) else p for p in pieces) == "select part.x, 'from orders' from <0> AS part, <1> o -- join part\n join <2> as n on a = part.b where x in (select 1 from <3> AS part) and orders = 2"


def test_traced_joins(spark):
    engine = Engine(spark, D, EngineConfig())
    found = engine.trace(*places("select n_name, count(*) from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' group by n_name", {"customer", "nation", "region"}))
    assert {frozenset(e.left_keys + e.right_keys) for e in found.edges} == {frozenset({"c_nationkey", "n_nationkey"}), frozenset({"n_regionkey", "r_regionkey"})}
    assert found.places[2].predicate is not None and not found.places[2].whole and found.places[0].whole
    # a grouping key may be reduced, an aggregate may not
    found = engine.trace(*places("select * from (select o_custkey as k, max(o_orderkey) as m from orders group by o_custkey) a, customer c, lineitem l where a.k = c.c_custkey and a.m = l.l_orderkey", {"orders", "customer", "lineitem"}))
    assert [sorted(e.left_keys + e.right_keys) for e in found.edges] == [["c_custkey", "o_custkey"]]


@pytest.mark.parametrize("config", [EngineConfig(prefilter=Prefilter.BLOOM), EngineConfig(prefilter=Prefilter.SEMI), EngineConfig(mode=Mode.HYBRID, cache_policy="w-lfu")])
def test_options_keep_answers_of_odd_joins(spark, config):
    engine = Engine(spark, D, config)
    for text in (
        "select count(*), count(s_suppkey) from nation left join (select * from supplier where s_acctbal > 5000) s on n_nationkey = s_nationkey and n_regionkey = 1",
        "select count(*) from nation n left join supplier s on n.n_nationkey = s.s_nationkey left join customer c on s.s_nationkey = c.c_nationkey and c.c_acctbal > 9000",
        "select count(*) from nation where not exists (select 1 from supplier, customer where s_nationkey = c_nationkey and s_nationkey = n_nationkey and c_acctbal > 9000)",
        "with a as (select n_nationkey k, n_name from nation where n_regionkey < 3) select count(*) from a x, a y, supplier where x.k = s_nationkey and y.k = x.k + 1 and y.n_name like 'N%'",
        "select count(*) from (select * from orders order by o_orderkey limit 50) o join customer on o_custkey = c_custkey and c_mktsegment = 'BUILDING'",
        "select count(*) from (select c_custkey k from customer where c_acctbal > 0 union all select o_custkey from orders) u, customer c where u.k = c.c_custkey and c.c_acctbal < 100",
    ):
        assert engine.sql(text).collect() == run_sql(spark, D, text).collect(), text
