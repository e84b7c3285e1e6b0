"""Forms of a scan, join and aggregation workload: wide aggregates, joins of two and three tables, groups and orders over joins."""

from __future__ import annotations

from oxbow.plans.sqlrun import split

SHIPPED = "l_shipdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1995-06-30 00:00:00'"

TEXTS = {
    "load_scan_wide_aggregate": "SELECT min(l_orderkey) AS a, max(l_partkey) AS b, min(l_suppkey) AS c, round(avg(l_linenumber), 6) AS d, round(sum(l_extendedprice), 2) AS e, round(avg(l_discount), 6) AS f, count(l_tax) AS g, count(l_shipdate) AS h FROM lineitem WHERE l_shipdate <= TIMESTAMP '1996-08-31 00:00:00'",
    "load_scan_narrow_range": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_extendedprice BETWEEN 50000 AND 50500",
    "load_scan_count_two_filters": "SELECT count(*) AS n, max(l_partkey) AS top FROM lineitem WHERE l_shipdate > TIMESTAMP '1997-08-01 00:00:00' AND l_quantity < 25",
    "load_join_two": f"SELECT p_partkey, l_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size BETWEEN 1 AND 5 AND {SHIPPED}",
    "load_join_three": f"SELECT p_partkey, s_suppkey, l_orderkey, l_linenumber FROM part, lineitem, supplier WHERE p_partkey = l_partkey AND l_suppkey = s_suppkey AND p_size BETWEEN 1 AND 5 AND {SHIPPED}",
    "load_aggregate_join_three": f"SELECT min(p_partkey) AS a, max(s_suppkey) AS b, count(*) AS n FROM part, lineitem, supplier WHERE p_partkey = l_partkey AND l_suppkey = s_suppkey AND p_size BETWEEN 1 AND 5 AND {SHIPPED}",
    "load_aggregate_both_sides": "SELECT round(avg(o_totalprice), 4) AS a, round(sum(l_extendedprice), 2) AS b, max(o_orderstatus) AS c, min(l_returnflag) AS d, max(l_shipdate) AS e, count(l_quantity) AS f FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "load_group_order": "SELECT l_quantity, count(*) AS n, max(l_shipdate) AS last, min(l_shipdate) AS first FROM lineitem GROUP BY l_quantity ORDER BY l_quantity",
    "load_group_over_join": "SELECT l_returnflag, max(l_shipdate) AS a, min(l_shipdate) AS b, max(o_orderdate) AS c, min(o_orderdate) AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_returnflag",
    "load_group_unshown_key": "SELECT count(l_quantity) AS a, count(p_size) AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_quantity",
    "load_group_order_over_join": "SELECT o_orderpriority, min(o_orderstatus) AS a, max(o_orderstatus) AS b, count(l_orderkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority ORDER BY 1",
    "load_order_over_join": "SELECT l_quantity, p_size, l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'PROMO' ORDER BY l_quantity, p_size, l_orderkey, l_linenumber",
    "load_filter_both_sides": "SELECT o_orderpriority, max(l_shipdate) AS a, round(avg(o_totalprice), 4) AS b, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate > TIMESTAMP '1997-08-01 00:00:00' AND o_totalprice < 100000 AND l_shipdate > TIMESTAMP '1997-08-01 00:00:00' GROUP BY o_orderpriority ORDER BY o_orderpriority",
    "load_small_dimension_group": "SELECT p_brand, count(*) AS n, round(avg(l_quantity), 6) AS a, round(avg(p_retailprice), 6) AS b, round(avg(l_tax), 6) AS c FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size = 50 GROUP BY p_brand ORDER BY p_brand",
    "load_nested_aggregate": "SELECT n_per_order, count(*) AS orders FROM (SELECT l_orderkey, count(*) AS n_per_order FROM lineitem GROUP BY l_orderkey) x GROUP BY n_per_order",
}

QUERIES, ORACLE = split(TEXTS)
