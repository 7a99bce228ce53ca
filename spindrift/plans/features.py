"""Registered queries that take another road to an answer of ``queries_sql``: same oracle, other physical strategy."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.config import EngineConfig, Mode, Prefilter, TransferOrder
from spindrift.functions.expressions import call, col, lit
from spindrift.operators import relational as R
from spindrift.operators.bloom import prefilter
from spindrift.plans import modes, workload
from spindrift.plans.joingraph import Edge, JoinGraph
from spindrift.plans.queries_sql import SQL
from spindrift.plans.sql import run_sql
from spindrift.sources import files
from spindrift.sources.cache import SegmentCache
from spindrift.sources.catalog import Catalog, Table, collect_rows, collect_zones
from spindrift.sources.policies import POLICIES, Belady, SegmentKey
from spindrift.sources.shared import scratch_path
from spindrift.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
#: As in ``queries_sql``: off the ties of two decimals.
OFF = 0.0000037
REVENUE = call("multiply", col("l_extendedprice"), call("subtract", lit(1.0), col("l_discount")))


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _rows(spark: SparkSession, folder: str, name: str) -> int:
    """From the footers alone."""
    return _table(spark, folder, name).count()


def _money(column: str, name: str):
    return F.round(F.sum(column) + OFF, 2).alias(name)


# Q5: six relations, one cycle

Q5_EDGES = [
    Edge("customer", "orders", ("c_custkey",), ("o_custkey",)),
    Edge("orders", "lineitem", ("o_orderkey",), ("l_orderkey",)),
    Edge("supplier", "lineitem", ("s_suppkey",), ("l_suppkey",)),
    Edge("supplier", "customer", ("s_nationkey",), ("c_nationkey",)),
    Edge("nation", "supplier", ("n_nationkey",), ("s_nationkey",)),
    Edge("region", "nation", ("r_regionkey",), ("n_regionkey",)),
]


def q05_graph(spark: SparkSession, folder: str) -> JoinGraph:
    names = ("customer", "orders", "lineitem", "supplier", "nation", "region")
    relations = {n: _table(spark, folder, n) for n in names}
    relations["region"] = relations["region"].where("r_name = 'EUROPE'")
    relations["lineitem"] = relations["lineitem"].select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    relations["orders"] = relations["orders"].select("o_orderkey", "o_custkey")
    relations["customer"] = relations["customer"].select("c_custkey", "c_nationkey")
    relations["supplier"] = relations["supplier"].select("s_suppkey", "s_nationkey")
    return JoinGraph(relations, {n: _rows(spark, folder, n) for n in names}, Q5_EDGES, whole={*names} - {"region"}).count_keys()


def _q05(prefilter_by: Prefilter, order: TransferOrder = TransferOrder.SMALL_TO_LARGE) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        graph = q05_graph(spark, folder).transfer(EngineConfig(prefilter=prefilter_by, transfer_order=order))
        return graph.join(graph.order()).groupBy("n_name").agg(_money("revenue", "revenue"))

    return query


def _pt_left_join_q13(spark: SparkSession, folder: str) -> DataFrame:
    relations = {"customer": _table(spark, folder, "customer").select("c_custkey"), "orders": _table(spark, folder, "orders").where("o_orderpriority not like '%URGENT%'").select("o_orderkey", "o_custkey")}
    graph = JoinGraph(relations, {n: _rows(spark, folder, n) for n in relations}, [Edge("customer", "orders", ("c_custkey",), ("o_custkey",), "left")])
    joined = graph.transfer(EngineConfig(prefilter=Prefilter.BLOOM)).join(["customer", "orders"])
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count")).groupBy("c_count").agg(F.count("*").alias("custdist"))


def _bloom_q03(spark: SparkSession, folder: str) -> DataFrame:
    customer = _table(spark, folder, "customer").where("c_mktsegment = 'HOUSEHOLD'").select("c_custkey")
    orders = _table(spark, folder, "orders").where("o_orderdate < timestamp '1997-03-25'").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = prefilter(orders, ["o_custkey"], customer, ["c_custkey"], rows=_rows(spark, folder, "customer")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    lines = _table(spark, folder, "lineitem").where("l_shipdate > timestamp '1997-03-25'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    lines = prefilter(lines, ["l_orderkey"], orders, ["o_orderkey"], rows=_rows(spark, folder, "orders"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(_money("v", "revenue"))
    return joined.orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


# Q6: one scan, all modes

Q6_PREDICATE = call(
    "and",
    call("le", lit("1997-01-01T00:00:00", "timestamp"), col("l_shipdate")),
    call("lt", col("l_shipdate"), lit("1998-01-01T00:00:00", "timestamp")),
    call("between", col("l_discount"), lit(0.02), lit(0.04)),
    call("lt", col("l_quantity"), lit(24.0)),
)
Q6_COLUMNS = ("l_extendedprice", "l_discount")


def _q06(df: DataFrame) -> DataFrame:
    return df.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")) + OFF, 2).alias("revenue"))


def _mode_q06(mode: Mode, policy: str = "lru") -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        table = Catalog.from_folder(spark, folder, ["lineitem"])["lineitem"]
        cache = SegmentCache(spark, POLICIES[policy](1 << 30)) if mode in (Mode.CACHING_ONLY, Mode.HYBRID) else None
        if cache:  # the cache holds part of what the query needs, as after an earlier one
            modes.scan(spark, table, None, ["l_discount", "l_quantity", "l_shipdate"], EngineConfig(mode=Mode.CACHING_ONLY), cache)
            cache.new_query()
        return _q06(modes.scan(spark, table, Q6_PREDICATE, Q6_COLUMNS, EngineConfig(mode=mode), cache))

    return query


_prepared: dict[tuple[str, str, str], Any] = {}


def _once(spark: SparkSession, folder: str, name: str, make: Callable[[], Any]) -> Any:
    """A layout of a folder's tables, made once for an application: that is part of loading data, not of a query."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _prepared:
        _prepared[key] = make()
    return _prepared[key]


def _by_date(spark: SparkSession, folder: str) -> Table:
    path = scratch_path(spark, "lineitem-by-date")
    lines = _table(spark, folder, "lineitem").select("l_shipdate", "l_discount", "l_quantity", "l_extendedprice")
    lines.repartitionByRange(8, "l_shipdate").write.parquet(f"{path}/lineitem.parquet")
    table = Catalog.from_folder(spark, path, ["lineitem"])["lineitem"]
    collect_zones(spark, table, ["l_shipdate", "l_discount", "l_quantity"])
    return table


def _zonemap_q06(spark: SparkSession, folder: str) -> DataFrame:
    """Over a copy that is range-partitioned by date, so that zones tell partitions apart."""
    table = _once(spark, folder, "by date", lambda: _by_date(spark, folder))
    return _q06(modes.pushed_down(spark, table, Q6_PREDICATE, Q6_COLUMNS))


def _bitmap_q06(split: bool) -> Query:
    """One side evaluates the predicate and sends the rows' numbers; the other reads the rest by them. Split: each side takes
    half of the predicate."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        table = Catalog.from_folder(spark, folder, ["lineitem"])["lineitem"]
        if not split:
            return _q06(modes.scan_by_bitmap(spark, table, modes.filter_bitmap(spark, table, Q6_PREDICATE), Q6_COLUMNS))
        first, second = ({**Q6_PREDICATE, "args": half} for half in (Q6_PREDICATE["args"][:2], Q6_PREDICATE["args"][2:]))
        both = modes.filter_bitmap(spark, table, first).join(modes.filter_bitmap(spark, table, second), ["_file", "_row"])
        return _q06(modes.scan_by_bitmap(spark, table, both, Q6_COLUMNS))

    return query


def _csv_q06(spark: SparkSession, folder: str) -> DataFrame:
    path, columns = scratch_path(spark, "lineitem-csv"), ["l_shipdate", "l_discount", "l_quantity", "l_extendedprice"]
    lines = _table(spark, folder, "lineitem").select(*columns)
    files.write_csv(lines, f"{path}/csv")
    files.convert(spark, f"{path}/csv", f"{path}/lineitem.parquet", lines.schema)
    table = Catalog.from_folder(spark, path, ["lineitem"])["lineitem"]
    return _q06(modes.pushed_down(spark, table, Q6_PREDICATE, Q6_COLUMNS))


def _bucketed_co_join_2(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables rewritten by the hash of the join key."""
    return run_sql(spark, _once(spark, folder, "by order", lambda: _by_order(spark, folder)), SQL["co_join_2"])


def _by_order(spark: SparkSession, folder: str) -> str:
    path = scratch_path(spark, "by-orderkey")
    files.hash_partition(_table(spark, folder, "lineitem").select("l_orderkey", "l_shipdate"), f"{path}/lineitem.parquet", 8, "l_orderkey")
    files.hash_partition(_table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), f"{path}/orders.parquet", 8, "o_orderkey")
    return path


def _ops_joins(spark: SparkSession, folder: str) -> DataFrame:
    """Every kind of hash join and a join by a predicate, as DataFrame operators."""
    nation = R.project(_table(spark, folder, "nation"), ["n_nationkey", "n_name", "n_regionkey"])
    rich = R.scan(_table(spark, folder, "supplier"), call("gt", col("s_acctbal"), lit(5000.0)), ["s_suppkey", "s_nationkey"])
    out = []
    for how in ("inner", "left", "right", "full", "left_semi", "right_semi", "left_anti"):
        joined = R.hash_join(nation, rich, how, ["n_nationkey"], ["s_nationkey"])
        one = R.aggregate(joined, {"n": ("count", None), "k": ("sum0", col("s_suppkey" if "s_suppkey" in joined.columns else "n_nationkey"))})
        out.append(one.select(F.lit(how).alias("how"), F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k")))
    region = _table(spark, folder, "region")
    below = R.nested_loop_join(nation, region, "inner", call("lt", col("n_regionkey"), col("r_regionkey")))
    out.append(R.aggregate(below, {"n": ("count", None), "k": ("sum0", col("r_regionkey"))}).select(F.lit("theta").alias("how"), F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k")))
    return reduce(DataFrame.unionByName, out)


_JOINED = "SELECT '{how}' AS how, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum({k}), 0) AS BIGINT) AS k FROM {source}"
_RICH = "(SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 5000) s"
_JOINS_SQL = " UNION ALL ".join(
    [_JOINED.format(how=how, k="s_suppkey", source=f"nation {how} JOIN {_RICH} ON n_nationkey = s_nationkey") for how in ("inner", "left", "right", "full")]
    + [_JOINED.format(how="left_semi", k="n_nationkey", source=f"nation WHERE n_nationkey IN (SELECT s_nationkey FROM {_RICH})")]
    + [_JOINED.format(how="right_semi", k="s_suppkey", source=f"{_RICH} WHERE s_nationkey IN (SELECT n_nationkey FROM nation)")]
    + [_JOINED.format(how="left_anti", k="n_nationkey", source=f"nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {_RICH})")]
    + [_JOINED.format(how="theta", k="r_regionkey", source="nation JOIN region ON n_regionkey < r_regionkey")]
)


def _ops_limit_sort(spark: SparkSession, folder: str) -> DataFrame:
    return R.limit_sort(_table(spark, folder, "orders"), 15, [("o_totalprice", "DESC"), ("o_orderkey", "ASC")]).select("o_orderkey", "o_totalprice")


def _ops_divide(spark: SparkSession, folder: str) -> DataFrame:
    """Integers divide to integers, also where a double would lose digits; by zero to null."""
    big = call("add", lit(9007199254740993), col("o_orderkey"))
    zero = call("subtract", col("o_custkey"), col("o_custkey"))
    return R.project(_table(spark, folder, "orders"), ["o_orderkey"], {"q": call("divide", big, col("o_custkey")), "z": call("divide", big, zero)})


def _zonemap_nan(spark: SparkSession, folder: str) -> DataFrame:
    """Zones of a column with NaN, which is above all numbers."""
    path = scratch_path(spark, "nan")
    lines = _table(spark, folder, "lineitem").select("l_orderkey", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("x"))
    lines.repartitionByRange(8, "l_orderkey").write.parquet(f"{path}/lines.parquet")
    table = Catalog.from_folder(spark, path, ["lines"])["lines"]
    collect_zones(spark, table, ["x"])
    return modes.pushed_down(spark, table, call("gt", col("x"), lit(49.0)), ["l_orderkey"]).groupBy().agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("s"))


def _csv_gzip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "nation-gz")
    nation = _table(spark, folder, "nation")
    files.write_csv(nation, f"{path}/nation", codec="gzip")
    return files.read(spark, "csv", [f"{path}/nation"], nation.schema)


def _stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return windows.run_available(windows.sessions(windows.read_stream(spark, folder)), "sessions")


def _belady_q06(spark: SparkSession, folder: str) -> DataFrame:
    """The hybrid scan of q06 with a cache that knows the queries to come."""
    table = Catalog.from_folder(spark, folder, ["lineitem"])["lineitem"]
    coming = [{SegmentKey("lineitem", p, c) for p in table.paths for c in cs} for cs in (["l_discount", "l_quantity", "l_shipdate"], ["l_discount", "l_extendedprice", "l_quantity", "l_shipdate"], ["l_discount"])]
    cache = SegmentCache(spark, Belady(1 << 30, coming))
    cache.new_query()
    modes.scan(spark, table, None, ["l_discount", "l_quantity", "l_shipdate"], EngineConfig(mode=Mode.CACHING_ONLY), cache)
    cache.new_query()
    return _q06(modes.scan(spark, table, Q6_PREDICATE, Q6_COLUMNS, EngineConfig(mode=Mode.HYBRID), cache))


def _under(name: str, config: EngineConfig) -> tuple[Query, str]:
    """A query's text under options."""
    return (lambda spark, folder: run_sql(spark, folder, SQL[name], config)), SQL[name]


BLOOM, YANNAKAKIS = EngineConfig(prefilter=Prefilter.BLOOM), EngineConfig(prefilter=Prefilter.SEMI, transfer_order=TransferOrder.BREADTH_FIRST)
_TEXTS = [name for name in SQL if name[0] == "q" and name[1:3].isdigit()]


def _ops_q01(spark: SparkSession, folder: str) -> DataFrame:
    lines = R.scan(_table(spark, folder, "lineitem"), call("le", col("l_shipdate"), call("subtract", lit("1998-12-01T00:00:00", "timestamp"), lit(90, "interval_day"))))
    grouped = R.group(
        R.project(lines, ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"], {"disc": REVENUE, "charge": call("multiply", REVENUE, call("add", lit(1.0), col("l_tax")))}),
        ["l_returnflag", "l_linestatus"],
        {"q": ("sum", col("l_quantity")), "b": ("sum", col("l_extendedprice")), "d": ("sum", col("disc")), "c": ("sum", col("charge")), "aq": ("avg", col("l_quantity")), "ap": ("avg", col("l_extendedprice")), "ad": ("avg", col("l_discount")), "n": ("count", None)},
    )
    money = [F.round(F.col(c) + OFF, 2).alias(n) for c, n in (("q", "sum_qty"), ("b", "sum_base"), ("d", "sum_disc"), ("c", "sum_charge"))]
    return R.sort(grouped, [("l_returnflag", "ASC"), ("l_linestatus", "ASC")]).select("l_returnflag", "l_linestatus", *money, F.round("aq", 4).alias("avg_qty"), F.round("ap", 4).alias("avg_price"), F.round("ad", 6).alias("avg_disc"), F.col("n").alias("count_order"))


#: Shipping years that workloads of generated queries range over, and the policy that each is run under.
YEARS = [str(y) for y in range(1995, 2002)]
WORKLOADS = {
    "uniform": ("lru", workload.uniform(YEARS, 6, 2, seed=1)),
    "skewed": ("w-lfu", workload.skewed(YEARS, 6, 1.5, 2, seed=1)),
    "recurring": ("lfu", workload.recurring(YEARS, 6, 2, 2, seed=1)),
    "hot": ("lfu-s", workload.hot(YEARS, 6, 0.7, 2, seed=1)),
}


def _by_year(spark: SparkSession, folder: str) -> Table:
    """A folder for each year, written without a shuffle: a year that holds most rows has the files of many tasks."""
    path = scratch_path(spark, "lineitem-by-year")
    lines = _table(spark, folder, "lineitem").select("l_discount", "l_extendedprice", "l_quantity", F.year("l_shipdate").alias("year"))
    lines.write.partitionBy("year").parquet(f"{path}/lineitem.parquet")
    table = Catalog.from_folder(spark, path, ["lineitem"])["lineitem"]
    collect_rows(spark, table)
    collect_zones(spark, table, ["year"])
    return table


def _workload(name: str) -> tuple[Query, str]:
    """Generated queries one after another through one cache, which has room for the three columns of three years."""
    policy, asked = WORKLOADS[name]

    def query(spark: SparkSession, folder: str) -> DataFrame:
        table = _once(spark, folder, "by year", lambda: _by_year(spark, folder))
        cache = SegmentCache(spark, POLICIES[policy](3 * 3 * 8 * table.rows / len(YEARS)))
        out = []
        for i, years in enumerate(asked):
            cache.new_query()
            within = call("between", col("year"), lit(int(years[0])), lit(int(years[-1])))
            df = modes.scan(spark, table, within, ["l_extendedprice", "l_discount"], EngineConfig(mode=Mode.HYBRID), cache)
            revenue = F.coalesce(F.sum(F.col("l_extendedprice") * F.col("l_discount")), F.lit(0.0))
            out.append(df.agg(F.lit(i).alias("query"), F.count("*").alias("n"), F.round(revenue + OFF, 2).alias("revenue")))
        return reduce(DataFrame.unionByName, out)

    one = "SELECT {i} AS query, CAST(count(*) AS BIGINT) AS n, round(coalesce(sum(l_extendedprice * l_discount), 0) + 0.0000037, 2) AS revenue FROM lineitem WHERE extract(year FROM l_shipdate) BETWEEN {a} AND {b}"
    return query, " UNION ALL ".join(one.format(i=i, a=years[0], b=years[-1]) for i, years in enumerate(asked))


def _stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows.run_available(windows.window_totals(windows.read_stream(spark, folder)), "windows")


FEATURES: dict[str, tuple[Query, str]] = {
    "pt_small_to_large_q05": (_q05(Prefilter.BLOOM), SQL["q05_local_supplier"]),
    "pt_bfs_q05": (_q05(Prefilter.BLOOM, TransferOrder.BREADTH_FIRST), SQL["q05_local_supplier"]),
    "yannakakis_q05": (_q05(Prefilter.SEMI, TransferOrder.BREADTH_FIRST), SQL["q05_local_supplier"]),
    "join_order_heuristic_q05": (_q05(Prefilter.NONE), SQL["q05_local_supplier"]),
    "pt_left_join_q13": (_pt_left_join_q13, SQL["q13_left_join_hist"]),
    "bloom_q03": (_bloom_q03, SQL["q03_shipping_priority"]),
    "mode_pullup_q06": (_mode_q06(Mode.PULL_UP), SQL["q06_forecast"]),
    "mode_pushdown_q06": (_mode_q06(Mode.PUSHDOWN_ONLY), SQL["q06_forecast"]),
    "mode_caching_q06": (_mode_q06(Mode.CACHING_ONLY), SQL["q06_forecast"]),
    "mode_hybrid_q06": (_mode_q06(Mode.HYBRID), SQL["q06_forecast"]),
    "mode_hybrid_wlfu_q06": (_mode_q06(Mode.HYBRID, "w-lfu"), SQL["q06_forecast"]),
    "zonemap_prune_q06": (_zonemap_q06, SQL["q06_forecast"]),
    "bitmap_compute_q06": (_bitmap_q06(False), SQL["q06_forecast"]),
    "bitmap_store_q06": (_bitmap_q06(True), SQL["q06_forecast"]),
    "csv_roundtrip_q06": (_csv_q06, SQL["q06_forecast"]),
    "hash_partitioned_co_join_2": (_bucketed_co_join_2, SQL["co_join_2"]),
    "mode_hybrid_lfu_q06": (_mode_q06(Mode.HYBRID, "lfu"), SQL["q06_forecast"]),
    "mode_hybrid_lfus_q06": (_mode_q06(Mode.HYBRID, "lfu-s"), SQL["q06_forecast"]),
    "mode_hybrid_belady_q06": (_belady_q06, SQL["q06_forecast"]),
    "mode_adaptive_q06": (_mode_q06(Mode.ADAPTIVE), SQL["q06_forecast"]),
    "zonemap_nan": (_zonemap_nan, "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(l_orderkey) AS BIGINT) AS s FROM lineitem WHERE l_linenumber = 1 OR l_quantity > 49"),
    "csv_gzip_scan": (_csv_gzip, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "ops_api_joins": (_ops_joins, _JOINS_SQL),
    "ops_api_limit_sort": (_ops_limit_sort, SQL["limit_sort"]),
    "ops_api_divide": (_ops_divide, "SELECT o_orderkey, (9007199254740993 + o_orderkey) // nullif(o_custkey, 0) AS q, CAST(NULL AS BIGINT) AS z FROM orders"),
    "ops_api_q01": (_ops_q01, SQL["q01_pricing_summary"]),
    "stream_event_windows": (_stream_windows, "SELECT date_trunc('hour', ts) AS window_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value) + 0.0000037, 2) AS total FROM events GROUP BY 1, 2"),
    "stream_event_sessions": (
        _stream_sessions,
        """SELECT user_id, min(ts) AS session_start, CAST(count(*) AS BIGINT) AS n FROM (
             SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM (
               SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < interval '30' minute THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, part""",
    ),
}
FEATURES |= {f"pt_sql_{name}": _under(name, BLOOM) for name in _TEXTS}
FEATURES |= {f"yannakakis_sql_{name}": _under(name, YANNAKAKIS) for name in _TEXTS}
FEATURES |= {f"bloom_join_sql_{name}": _under(name, EngineConfig(prefilter=Prefilter.JOIN)) for name in ("q03_shipping_priority", "q05_local_supplier", "q10_returned_item", "q21_exists_not_exists")}
FEATURES |= {f"{mode.value}_sql_{name}": _under(name, EngineConfig(mode=mode)) for mode in Mode for name in ("q03_shipping_priority", "q05_local_supplier", "q06_forecast", "q10_returned_item")}
FEATURES |= {f"workload_{name}": _workload(name) for name in WORKLOADS}
