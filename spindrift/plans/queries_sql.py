"""Decision-support queries as SQL text. Unless a text is given for both, one text serves Spark and the oracle.

Float aggregates are rounded (with an offset off the ties, so that the order of a sum does not show) and every computed column is cast and named, so results compare by value.
"""

from __future__ import annotations

REVENUE = "l_extendedprice * (1 - l_discount)"

SQL: dict[str, str] = {
    "q01_pricing_summary": f"""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity) + 0.0000037, 2) AS sum_qty, round(sum(l_extendedprice) + 0.0000037, 2) AS sum_base,
       round(sum({REVENUE}) + 0.0000037, 2) AS sum_disc, round(sum({REVENUE} * (1 + l_tax)) + 0.0000037, 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
       round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS count_order
FROM lineitem WHERE l_shipdate <= timestamp '1998-12-01' - interval '90' day GROUP BY l_returnflag, l_linestatus""",
    "q02_min_cost_supplier": """
WITH ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_cost FROM lineitem GROUP BY l_partkey, l_suppkey)
SELECT s_name, n_name, p_partkey, round(ps_cost, 4) AS cost FROM part, supplier, ps, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND p_type LIKE '%O%' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND ps_cost = (SELECT min(ps2.ps_cost) FROM ps ps2, supplier s2, nation n2, region r2 WHERE ps2.ps_partkey = p_partkey AND s2.s_suppkey = ps2.ps_suppkey
                 AND s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'EUROPE')""",
    "q03_shipping_priority": f"""
SELECT l_orderkey, round(sum({REVENUE}) + 0.0000037, 2) AS revenue, o_orderdate FROM customer, orders, lineitem
WHERE c_mktsegment = 'HOUSEHOLD' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < timestamp '1997-03-25' AND l_shipdate > timestamp '1997-03-25'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q04_exists": """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS cnt FROM orders o
WHERE o_orderdate >= timestamp '1996-10-01' AND o_orderdate < timestamp '1996-10-01' + interval '3' month
  AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate + interval '30' day) GROUP BY o_orderpriority""",
    "q05_local_supplier": f"""
SELECT n_name, round(sum({REVENUE}) + 0.0000037, 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'EUROPE' GROUP BY n_name""",
    "q06_forecast": """
SELECT round(sum(l_extendedprice * l_discount) + 0.0000037, 2) AS revenue FROM lineitem
WHERE l_shipdate >= timestamp '1997-01-01' AND l_shipdate < timestamp '1997-01-01' + interval '1' year AND l_discount BETWEEN 0.02 AND 0.04 AND l_quantity < 24""",
    "q07_volume_shipping": f"""
SELECT supp, cust, y, round(sum(v) + 0.0000037, 2) AS rev FROM (
  SELECT n1.n_name AS supp, n2.n_name AS cust, CAST(extract(year FROM l_shipdate) AS BIGINT) AS y, {REVENUE} AS v
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))) AS shipping GROUP BY supp, cust, y""",
    "q08_market_share": f"""
SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, round(sum(CASE WHEN n2.n_name = 'NATION_4' THEN {REVENUE} ELSE 0.0 END) / sum({REVENUE}), 6) AS share
FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
  AND n1.n_regionkey = r_regionkey AND r_name = 'MIDDLE EAST' AND s_nationkey = n2.n_nationkey AND p_size BETWEEN 10 AND 40 GROUP BY 1""",
    "q09_product_profit": f"""
WITH ps AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, 0.6 * min(l_extendedprice / l_quantity) AS ps_cost FROM lineitem GROUP BY l_partkey, l_suppkey)
SELECT n_name, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, round(sum({REVENUE} - ps_cost * l_quantity) + 0.0000037, 2) AS profit
FROM part, supplier, lineitem, ps, orders, nation
WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey
  AND p_name LIKE '%a%' GROUP BY n_name, 2""",
    "q10_returned_item": f"""
SELECT c_custkey, c_name, round(sum({REVENUE}) + 0.0000037, 2) AS rev, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY rev DESC, c_custkey LIMIT 20""",
    "q11_having_scalar_sub": """
SELECT l_partkey, round(sum(l_extendedprice) + 0.0000037, 2) AS v FROM lineitem GROUP BY l_partkey
HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.0008 FROM lineitem)""",
    "q12_case_pivot": """
SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS hi,
       CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS lo
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND o_orderdate < l_shipdate GROUP BY l_returnflag""",
    "q13_left_join_hist": """
SELECT c_count, CAST(count(*) AS BIGINT) AS custdist FROM (
  SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey
) AS c_orders GROUP BY c_count""",
    "q14_promo": f"""
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0.0 END) / sum({REVENUE}), 6) AS promo
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= timestamp '1996-01-01' AND l_shipdate < timestamp '1996-01-01' + interval '1' month""",
    "q15_top_supplier": f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, sum({REVENUE}) AS total FROM lineitem WHERE l_shipdate >= timestamp '1996-01-01' AND l_shipdate < timestamp '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, round(total + 0.0000037, 2) AS total FROM supplier, revenue WHERE s_suppkey = supplier_no AND round(total, 2) = (SELECT round(max(total), 2) FROM revenue)""",
    "q16_count_distinct_not_in": """
SELECT p_brand, p_type, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS c FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand <> 'Brand#1' AND p_type NOT LIKE 'ECO%' AND p_size IN (1, 5, 9, 14, 23, 36, 45)
  AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type""",
    "q17_corr_avg": """
SELECT round(sum(l_extendedprice) / 7.0 + 0.0000037, 2) AS v FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand = 'Brand#13' AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "q18_large_orders": """
SELECT c_name, o_orderkey, o_totalprice, round(sum(l_quantity) + 0.0000037, 2) AS q FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, o_orderkey, o_totalprice""",
    "q19_or_of_ands": f"""
SELECT round(sum({REVENUE}) + 0.0000037, 2) AS rev FROM lineitem, part
WHERE (p_partkey = l_partkey AND p_brand = 'Brand#1' AND l_quantity BETWEEN 2 AND 12 AND p_size BETWEEN 1 AND 15)
   OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity BETWEEN 14 AND 24 AND p_size BETWEEN 1 AND 25)""",
    "q20_nested_in": """
SELECT s_name, n_name FROM supplier, nation WHERE s_suppkey IN (
  SELECT o.l_suppkey FROM lineitem o WHERE o.l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%')
    AND o.l_quantity > (SELECT 0.9 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = o.l_partkey AND i.l_suppkey <> 0)) AND s_nationkey = n_nationkey""",
    "q21_exists_not_exists": """
SELECT s_name, CAST(count(*) AS BIGINT) AS numwait FROM supplier, lineitem l1, orders
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F'
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s_name""",
    "q22_anti_substring": """
SELECT substring(c_name FROM 16 FOR 1) AS code, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal) + 0.0000037, 2) AS s FROM customer
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY 1""",
    "join_inner": "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "join_left": "SELECT n_name, s_suppkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON n_nationkey = s_nationkey",
    "join_right": "SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "join_full": "SELECT n_nationkey, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s FULL JOIN nation ON s_nationkey = n_nationkey AND n_regionkey = 1",
    "join_left_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "join_right_semi": "SELECT n_nationkey, n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 6000)",
    "join_left_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '2-HIGH')",
    "join_cross": "SELECT r1.r_name AS a, r2.r_name AS b FROM region r1 CROSS JOIN region r2",
    "join_theta": "SELECT r1.r_name AS a, r2.r_name AS b FROM region r1 JOIN region r2 ON r1.r_regionkey < r2.r_regionkey",
    "join_theta_left": "SELECT r1.r_name AS a, r2.r_name AS b FROM region r1 LEFT JOIN region r2 ON r1.r_regionkey < r2.r_regionkey",
    "join_theta_full": "SELECT r1.r_name AS a, n.n_name AS b FROM (SELECT * FROM region WHERE r_regionkey < 2) r1 FULL JOIN (SELECT * FROM nation WHERE n_nationkey < 6) n ON r1.r_regionkey = n.n_regionkey AND n.n_nationkey > 2",
    "join_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "group_no_aggs": "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "select_distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "agg_empty": "SELECT CAST(count(*) AS BIGINT) AS c, sum(l_quantity) AS s, min(l_quantity) AS mn, avg(l_quantity) AS av FROM lineitem WHERE l_quantity < 0",
    "agg_ungrouped": "SELECT CAST(count(*) AS BIGINT) AS c, CAST(count(l_tax) AS BIGINT) AS ct, round(sum(l_quantity) + 0.0000037, 2) AS s, min(l_shipdate) AS mn, max(l_returnflag) AS mx, round(avg(l_linenumber), 6) AS av, min(l_discount) + 0.0 AS md FROM lineitem",
    "agg_over_expression": "SELECT o_orderstatus, round(sum(o_totalprice * 2 + 1) + 0.0000037, 2) AS s, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM orders GROUP BY o_orderstatus",
    "agg_filter_clause": "SELECT o_orderstatus, CAST(count(*) FILTER (WHERE o_totalprice > 100000) AS BIGINT) AS big, CAST(count(DISTINCT o_custkey) AS BIGINT) AS cust FROM orders GROUP BY o_orderstatus",
    "group_rollup": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS c FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "group_cube": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS c FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "group_grouping_sets": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS c FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sort_all": "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey ASC",
    "limit_sort": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15",
    "limit_sort_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "bytes_read_sweep": "SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice FROM lineitem WHERE l_discount <= 0.02 ORDER BY l_returnflag, l_linestatus, l_quantity, l_extendedprice LIMIT 10",
    "filter_in_between_like": "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#2', 'Brand#5') AND p_type NOT LIKE '%N%' AND NOT (p_retailprice < 910)",
    "filter_or_ranges": "SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR p_size > 45 OR p_size = 20",
    "filter_null_logic": "SELECT n_nationkey, x IS NULL AS is_null, (x > 0) IS TRUE AS is_true, (x > 0) IS NOT FALSE AS is_not_false FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey - 10 END AS x FROM nation) AS t",
    "project_expressions": "SELECT o_orderkey, round(o_totalprice * 0.5 - 10 + o_orderkey / 4.0, 4) AS e, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(extract(day FROM o_orderdate) AS BIGINT) AS d, substring(o_orderpriority FROM 3 FOR 4) AS p, CAST(o_totalprice AS BIGINT) - CAST(o_totalprice AS BIGINT) AS z FROM orders",
    "co_join_2": "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS c FROM lineitem, orders WHERE l_orderkey = o_orderkey AND o_orderdate >= timestamp '1997-01-01' AND l_shipdate > o_orderdate GROUP BY o_orderpriority",
    "co_join_3": "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS c FROM lineitem l, orders o, part p WHERE l.l_orderkey = o.o_orderkey AND l.l_partkey = p.p_partkey AND o.o_orderdate >= timestamp '1997-01-01' AND p.p_size < 20 AND o.o_orderpriority NOT LIKE '%LOW%' GROUP BY o_orderpriority",
    "ssb_1_1": "SELECT round(sum(l_extendedprice * l_discount) + 0.0000037, 2) AS revenue FROM lineitem, orders WHERE l_orderkey = o_orderkey AND extract(year FROM o_orderdate) = 1996 AND l_discount BETWEEN 0.01 AND 0.03 AND l_quantity < 25",
    "ssb_1_2": "SELECT round(sum(l_extendedprice * l_discount) + 0.0000037, 2) AS revenue FROM lineitem, orders WHERE l_orderkey = o_orderkey AND extract(year FROM o_orderdate) = 1996 AND extract(month FROM o_orderdate) = 1 AND l_discount BETWEEN 0.04 AND 0.06 AND l_quantity BETWEEN 26 AND 35",
    "ssb_2_1": f"SELECT round(sum({REVENUE}) + 0.0000037, 2) AS revenue, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, p_brand FROM supplier, lineitem, orders, part, nation, region WHERE l_orderkey = o_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND p_type = 'PROMO' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'AMERICA' GROUP BY 2, p_brand",
    "ssb_2_2": f"SELECT round(sum({REVENUE}) + 0.0000037, 2) AS revenue, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, p_brand FROM supplier, lineitem, orders, part, nation, region WHERE l_orderkey = o_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND p_brand BETWEEN 'Brand#11' AND 'Brand#18' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY 2, p_brand",
    "ssb_3_1": f"SELECT cn.n_name AS c_nation, sn.n_name AS s_nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, round(sum({REVENUE}) + 0.0000037, 2) AS revenue FROM supplier, lineitem, orders, customer, nation cn, nation sn, region cr, region sr WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND c_nationkey = cn.n_nationkey AND s_nationkey = sn.n_nationkey AND cn.n_regionkey = cr.r_regionkey AND sn.n_regionkey = sr.r_regionkey AND cr.r_name = 'ASIA' AND sr.r_name = 'ASIA' AND o_orderdate < timestamp '1999-01-01' GROUP BY 1, 2, 3",
    "ssb_3_3": f"SELECT cn.n_name AS c_nation, sn.n_name AS s_nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, round(sum({REVENUE}) + 0.0000037, 2) AS revenue FROM supplier, lineitem, orders, customer, nation cn, nation sn WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND c_nationkey = cn.n_nationkey AND s_nationkey = sn.n_nationkey AND (cn.n_name = 'NATION_3' OR cn.n_name = 'NATION_6') AND (sn.n_name = 'NATION_3' OR sn.n_name = 'NATION_6') GROUP BY 1, 2, 3",
    "ssb_4_1": f"SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, cn.n_name AS c_nation, round(sum({REVENUE} - 0.4 * p_retailprice) + 0.0000037, 2) AS profit FROM supplier, lineitem, orders, customer, part, nation cn, nation sn, region cr, region sr WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND l_partkey = p_partkey AND c_nationkey = cn.n_nationkey AND s_nationkey = sn.n_nationkey AND cn.n_regionkey = cr.r_regionkey AND sn.n_regionkey = sr.r_regionkey AND cr.r_name = 'AMERICA' AND sr.r_name = 'AMERICA' AND (p_type = 'PROMO' OR p_type = 'ECONOMY') GROUP BY 1, 2",
    "ssb_1_3": "SELECT round(sum(l_extendedprice * l_discount) + 0.0000037, 2) AS revenue FROM lineitem, orders WHERE l_orderkey = o_orderkey AND extract(week FROM o_orderdate) = 6 AND extract(year FROM o_orderdate) = 1996 AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity BETWEEN 26 AND 35",
    "ssb_2_3": f"SELECT round(sum({REVENUE}) + 0.0000037, 2) AS revenue, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, p_brand FROM supplier, lineitem, orders, part, nation, region WHERE l_orderkey = o_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND p_brand = 'Brand#12' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE' GROUP BY 2, p_brand",
    "ssb_3_2": f"SELECT c_mktsegment, s_name, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, round(sum({REVENUE}) + 0.0000037, 2) AS revenue FROM supplier, lineitem, orders, customer, nation cn, nation sn WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND c_nationkey = cn.n_nationkey AND s_nationkey = sn.n_nationkey AND cn.n_name = 'NATION_3' AND sn.n_name = 'NATION_7' AND o_orderdate >= timestamp '1996-01-01' AND o_orderdate < timestamp '2000-01-01' GROUP BY c_mktsegment, s_name, 3",
    "ssb_3_4": f"SELECT cn.n_name AS c_nation, sn.n_name AS s_nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, round(sum({REVENUE}) + 0.0000037, 2) AS revenue FROM supplier, lineitem, orders, customer, nation cn, nation sn WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND c_nationkey = cn.n_nationkey AND s_nationkey = sn.n_nationkey AND cn.n_name IN ('NATION_3', 'NATION_9') AND sn.n_name IN ('NATION_3', 'NATION_9') AND extract(year FROM o_orderdate) = 1997 AND extract(month FROM o_orderdate) = 12 GROUP BY cn.n_name, sn.n_name, 3",
    "ssb_4_2": f"SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, sn.n_name AS s_nation, p_type, round(sum({REVENUE} - 0.4 * p_retailprice) + 0.0000037, 2) AS profit FROM supplier, lineitem, orders, customer, part, nation cn, nation sn, region cr, region sr WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND l_partkey = p_partkey AND c_nationkey = cn.n_nationkey AND s_nationkey = sn.n_nationkey AND cn.n_regionkey = cr.r_regionkey AND sn.n_regionkey = sr.r_regionkey AND cr.r_name = 'AMERICA' AND sr.r_name = 'AMERICA' AND extract(year FROM o_orderdate) IN (1997, 1998) AND (p_type = 'ECONOMY' OR p_type = 'PROMO') GROUP BY 1, sn.n_name, p_type",
    "ssb_4_3": f"SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, s_name, p_brand, round(sum({REVENUE} - 0.4 * p_retailprice) + 0.0000037, 2) AS profit FROM supplier, lineitem, orders, customer, part, nation sn WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND l_partkey = p_partkey AND s_nationkey = sn.n_nationkey AND sn.n_name = 'NATION_5' AND extract(year FROM o_orderdate) IN (1997, 1998) AND p_type = 'STANDARD' GROUP BY 1, s_name, p_brand",
    "limit_unordered": "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 LIMIT 100) t",
    "set_union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey AS k FROM supplier",
    "set_intersect": "SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey AS k FROM supplier",
    "set_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0",
    "window_rank": "SELECT n_regionkey, s_suppkey, rk FROM (SELECT n_regionkey, s_suppkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS rk FROM supplier, nation WHERE s_nationkey = n_nationkey) t WHERE rk <= 3",
}


def _star(by: str, tables: str, filters: str) -> str:
    """A star query of revenue by month and other columns; filters come in the order of dimension, measure, year."""
    month = "CAST(extract(year FROM o_orderdate) * 100 + extract(month FROM o_orderdate) AS BIGINT)"
    return f"SELECT {month} AS month, {by}, round(sum({REVENUE}) + 0.0000037, 2) AS revenue FROM lineitem, orders, {tables} WHERE l_orderkey = o_orderkey AND {filters} GROUP BY {month}, {by}"


_SOLD = "l_suppkey = s_suppkey AND s_nationkey = sn.n_nationkey"
_BOUGHT = "o_custkey = c_custkey AND c_nationkey = cn.n_nationkey"
#: Star queries as a workload generator makes them: drill-downs of three kinds, each at a dimension value, a band of a measure and a year.
SQL |= {
    "ssb_generated_1": _star("p_brand", "part, supplier, nation sn, region", f"l_partkey = p_partkey AND {_SOLD} AND n_regionkey = r_regionkey AND r_name = 'EUROPE' AND p_brand BETWEEN 'Brand#1' AND 'Brand#3' AND l_discount BETWEEN 0.01 AND 0.03 AND extract(year FROM o_orderdate) = 1996"),
    "ssb_generated_2": _star("c_mktsegment, s_name", "supplier, customer, nation sn, nation cn", f"{_SOLD} AND {_BOUGHT} AND sn.n_regionkey = 3 AND cn.n_regionkey = 3 AND l_quantity BETWEEN 16 AND 26 AND extract(year FROM o_orderdate) = 1995"),
    "ssb_generated_3": _star("sn.n_name, p_type", "supplier, customer, part, nation sn, nation cn", f"l_partkey = p_partkey AND {_SOLD} AND {_BOUGHT} AND sn.n_regionkey = 4 AND cn.n_regionkey = 4 AND (p_brand = 'Brand#2' OR p_brand = 'Brand#3') AND l_discount BETWEEN 0 AND 0.02 AND extract(year FROM o_orderdate) = 1995"),
    "ssb_generated_4": _star("p_brand", "part, supplier, nation sn, region", f"l_partkey = p_partkey AND {_SOLD} AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND p_brand = 'Brand#5' AND l_quantity BETWEEN 17 AND 27 AND extract(year FROM o_orderdate) = 1997"),
    "ssb_generated_5": _star("c_name, s_name", "supplier, customer, nation sn, nation cn", f"{_SOLD} AND {_BOUGHT} AND sn.n_name IN ('NATION_3', 'NATION_6') AND cn.n_regionkey = 1 AND l_quantity BETWEEN 12 AND 22 AND extract(year FROM o_orderdate) = 1996"),
}
