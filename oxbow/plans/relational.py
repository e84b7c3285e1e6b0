"""Relational core: scans, predicates, joins, aggregation, ordering, set operations, sub-queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.plans.sqlrun import split
from oxbow.session import table

N = "nullif(o_orderpriority, '3-MEDIUM')"  # the tables have no nulls: one value becomes null
TEXTS: dict[str, str | tuple[str, str | None]] = {
    # scans and predicates
    "scan_filter_pushdown": "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate < DATE '1995-06-01' AND l_quantity >= 49",
    "scan_filter_or_group": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' OR o_orderstatus = 'F' AND o_totalprice > 490000",
    "scan_column_vs_column": "SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal < c_custkey AND c_nationkey <> c_custkey",
    "scan_extent_range": "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderkey BETWEEN 1000 AND 2000",
    "proj_arith": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, -l_quantity AS neg,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity / (l_linenumber - 3) END AS ratio FROM lineitem""",
    "proj_divide_by_zero": ("SELECT o_orderkey, try_divide(o_totalprice, o_orderkey % 3) AS q FROM orders",
                            "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / (o_orderkey % 3) END AS q FROM orders"),
    "proj_constant": "SELECT 1 AS one, 'x' AS letter, CAST(NULL AS INT) AS nothing, TRUE AS yes",
    "proj_constant_column": "SELECT n_nationkey, 42 AS answer, 'tag' AS label FROM nation",
    "pred_constant_false": "SELECT o_orderkey FROM orders WHERE 1 = 0",
    "pred_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%wid_et' AND p_name NOT LIKE 'red%'",
    "pred_xor": ("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND NOT (o_totalprice > 250000)) OR (NOT (o_orderstatus = 'F') AND o_totalprice > 250000)",
                 "SELECT o_orderkey FROM orders WHERE xor(CAST(o_orderstatus = 'F' AS INT), CAST(o_totalprice > 250000 AS INT)) = 1"),
    "pred_in_list": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_custkey NOT IN (1, 2, 3)",
    "pred_between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 AND p_retailprice NOT BETWEEN 950 AND 1000",
    "pred_null_matrix": f"""SELECT sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END) * 1.0 AS n_null, count(v) AS n_not_null, sum(CASE WHEN v = '5-LOW' THEN 1 ELSE 0 END) * 1.0 AS n_eq,
  sum(CASE WHEN v <> '5-LOW' THEN 1 ELSE 0 END) * 1.0 AS n_ne, sum(CASE WHEN v < '9' THEN 1 ELSE 0 END) * 1.0 AS n_lt, sum(CASE WHEN v > '0' THEN 1 ELSE 0 END) * 1.0 AS n_gt
FROM (SELECT {N} AS v FROM orders) x""",
    "pred_is_null": f"SELECT o_orderkey FROM orders WHERE {N} IS NULL AND o_orderstatus IS NOT NULL",
    "pred_expression": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE length(l_returnflag) + l_linenumber = 5 AND abs(l_quantity - 25) < 2",
    "pred_regexp": ("SELECT p_partkey FROM part WHERE p_name RLIKE '^(red|blue) [a-m]'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '^(red|blue) [a-m]')"),
    "proj_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "proj_case": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS simple_case,
  CASE WHEN o_totalprice > 400000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' END AS searched_case FROM orders""",
    "view_nested": "WITH a AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey, max(o_totalprice) AS top FROM a GROUP BY o_custkey) SELECT c_name, top FROM b JOIN customer ON c_custkey = o_custkey WHERE top > 450000",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000",
    "join_left": "SELECT c_custkey, o.o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) o ON c_custkey = o.o_custkey",
    "join_right": "SELECT c_custkey, o.o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 480000) o RIGHT JOIN customer ON c_custkey = o.o_custkey",
    "join_full": "SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000) a FULL OUTER JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') b ON a.o_orderkey = b.o_orderkey",
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000) o ON c_custkey = o_custkey",
                  "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey",
                  "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "join_null_aware_anti": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, -1) FROM orders WHERE o_totalprice > 300000)",
    "join_null_aware_anti_null": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 5) FROM orders)",
    "join_outer_on_filter": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 495000 WHERE c_acctbal > 9000",
    "join_residual": "SELECT o_orderkey, l_partkey, l_suppkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate AND l_quantity * 10000 > o_totalprice",
    "join_expr_key": "SELECT s_suppkey, n_name FROM supplier JOIN nation ON (s_nationkey + 1) % 25 = n_nationkey",
    "join_compound_key": "SELECT a.l_orderkey AS a_order, b.l_quantity AS qty FROM lineitem a JOIN (SELECT l_orderkey, l_partkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_partkey) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_quantity = b.l_quantity",
    "join_string_key": "SELECT a.p_partkey AS p1, b.p_partkey AS p2 FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey",
    "join_self": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_unsigned": ("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON CAST(o_custkey AS DECIMAL(20,0)) = CAST(c_custkey AS DECIMAL(20,0)) WHERE o_totalprice > 495000",
                      "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON CAST(o_custkey AS UBIGINT) = CAST(c_custkey AS UBIGINT) WHERE o_totalprice > 495000"),
    "join_multiway": """SELECT r_name, c_mktsegment, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE p_size < 10 GROUP BY r_name, c_mktsegment""",
    "join_large_both": "SELECT o_orderpriority, l_returnflag, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority, l_returnflag",
    # aggregation
    "agg_count": f"SELECT count(*) AS n_rows, count({N}) AS n_values FROM orders",
    "agg_sum_avg": "SELECT l_linenumber, round(sum(l_extendedprice), 2) AS s, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY l_linenumber",
    "agg_min_max": "SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderpriority) AS first_p, max(o_orderpriority) AS last_p, min(o_orderdate) AS d0, max(o_orderdate) AS d1 FROM orders GROUP BY o_orderstatus",
    "agg_count_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus",
    "agg_sum_avg_distinct": ("SELECT p_brand, sum(DISTINCT p_size) AS s, round(avg(DISTINCT p_size), 6) AS a FROM part GROUP BY p_brand",
                             "SELECT p_brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, round(avg(DISTINCT p_size), 6) AS a FROM part GROUP BY p_brand"),
    "agg_count_distinct_multi": ("SELECT o_orderstatus, count(DISTINCT o_custkey, o_orderpriority) AS n FROM orders GROUP BY o_orderstatus",
                                 "SELECT o_orderstatus, count(DISTINCT (o_custkey, o_orderpriority)) AS n FROM orders GROUP BY o_orderstatus"),
    "agg_stats": "SELECT p_type, round(stddev_pop(p_size), 6) AS sp, round(stddev_samp(p_size), 6) AS ss, round(var_pop(p_size), 6) AS vp, round(var_samp(p_size), 6) AS vs FROM part GROUP BY p_type",
    "agg_bits": "SELECT o_orderstatus, bit_and(o_custkey) AS b_and, bit_or(o_custkey) AS b_or, bit_xor(o_custkey) AS b_xor FROM orders GROUP BY o_orderstatus",
    "agg_bits_empty": ("SELECT coalesce(bit_and(o_custkey), -1) AS b_and, coalesce(bit_or(o_custkey), 0) AS b_or FROM orders WHERE o_orderkey < 0",
                       "SELECT coalesce(bit_and(o_custkey), -1) AS b_and, coalesce(bit_or(o_custkey), 0) AS b_or FROM orders WHERE o_orderkey < 0"),
    "agg_group_concat": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey",
                         "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey"),
    "agg_group_concat_distinct": ("SELECT p_brand, listagg(DISTINCT p_type, '|') WITHIN GROUP (ORDER BY p_type) AS kinds FROM part GROUP BY p_brand",
                                  "SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS kinds FROM part GROUP BY p_brand"),
    "agg_constant": "SELECT o_orderstatus, 'fixed' AS tag, count(*) AS n FROM orders GROUP BY o_orderstatus",
    "agg_expr_over_agg": "SELECT o_orderstatus, round(sum(o_totalprice) / count(*) - avg(o_totalprice), 4) AS zero, max(o_orderkey) - min(o_orderkey) AS spread FROM orders GROUP BY o_orderstatus",
    "agg_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING count(*) >= 15 AND sum(o_totalprice) > 3000000",
    "agg_group_by_position": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "agg_group_by_expr": "SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y, o_custkey % 4 AS q, count(*) AS n FROM orders GROUP BY CAST(extract(year FROM o_orderdate) AS INT), o_custkey % 4",
    "agg_empty_input": "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderdate) AS m FROM orders WHERE o_orderkey < 0",
    "agg_over_join": "SELECT n_name, count(*) AS n, round(avg(c_acctbal), 6) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "agg_high_cardinality": "SELECT l_orderkey, l_partkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_orderkey, l_partkey",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS no_status, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    # order, limit, top-k
    "sort_full": "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey",
    "sort_by_position": "SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2",
    "sort_nulls": f"SELECT o_orderkey, {N} AS p FROM orders ORDER BY p ASC NULLS FIRST, o_orderkey",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "topk_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 15",
    "topk_zero": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0",
    "topk_distinct": "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey DESC LIMIT 12",
    "limit_plain": ("SELECT o_orderkey FROM orders LIMIT 7", None),
    # set operations
    "union_all": "SELECT CAST(c_custkey AS BIGINT) AS k, c_name AS nm FROM customer UNION ALL SELECT CAST(s_suppkey AS BIGINT), s_name FROM supplier UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name FROM nation",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation",
    "union_mixed": "SELECT k FROM (SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region) x UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey < 5",
    "union_types": "SELECT CAST(n_nationkey AS DOUBLE) AS v FROM nation UNION ALL SELECT c_acctbal FROM customer",
    "union_in_derived": "SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier) u WHERE k < 10 GROUP BY kind",
    "set_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9700",
    # sub-queries
    "subq_scalar": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)",
    "subq_scalar_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.7 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "subq_scalar_between": "SELECT count(*) AS n FROM orders WHERE o_totalprice BETWEEN (SELECT avg(o_totalprice) FROM orders) AND (SELECT max(o_totalprice) * 0.9 FROM orders)",
    "subq_scalar_in_list": "SELECT n_name FROM nation WHERE n_nationkey IN ((SELECT min(n_nationkey) FROM nation), (SELECT max(n_nationkey) FROM nation))",
    "subq_scalar_is_null": "SELECT r_name FROM region WHERE (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 22) IS NULL",
    "subq_row_compare": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1)",
    "subq_in": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9900)",
    "subq_not_in": "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9800)",
    "subq_in_correlated": "SELECT c_custkey FROM customer c WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > c.c_acctbal)",
    "subq_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000)",
    "subq_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 100000)",
    "subq_from": "SELECT y, max(s) AS top FROM (SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y, o_orderstatus, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY CAST(extract(year FROM o_orderdate) AS INT), o_orderstatus) d GROUP BY y",
    "subq_select_list": "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT max(r_name) FROM region WHERE r_regionkey = n_regionkey) AS region_name FROM nation",
    "subq_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT 1.8 * count(*) / count(DISTINCT o_custkey) FROM orders)",
    "subq_union_in": "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9980 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9500)",
}

QUERIES, ORACLE = split(TEXTS)

#: A side is broadcast by hint only if the catalogue's estimate of its size is below this (bytes).
BROADCAST_BOUND = 64 << 20


def small_enough(df: DataFrame, bound: int = BROADCAST_BOUND) -> bool:
    """Whether the optimizer's size estimate of a frame is within the bound."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= bound


def checked_broadcast(df: DataFrame, bound: int = BROADCAST_BOUND) -> DataFrame:
    """The frame with a broadcast hint if its estimated size allows it, else as it is (a shuffled join)."""
    return F.broadcast(df) if small_enough(df, bound) else df


def join_broadcast(spark: SparkSession, d: str) -> DataFrame:
    """Central or distributed join, decided by a checked size."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    return table(spark, d, "customer").join(checked_broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


def join_salted(spark: SparkSession, d: str) -> DataFrame:
    """Equi-join on a skewed key: the large side's key gets a salt, the small side's rows all salts."""
    salts = 8
    big = table(spark, d, "lineitem").select("l_linenumber", "l_quantity", F.pmod(F.hash("l_orderkey"), F.lit(salts)).alias("salt"))
    small = table(spark, d, "nation").select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    met = big.join(small, (F.col("l_linenumber") == F.col("n_nationkey")) & (big["salt"] == small["salt"]))
    return met.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


QUERIES |= {"join_broadcast": join_broadcast, "join_salted": join_salted}
ORACLE |= {
    "join_broadcast": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "join_salted": "SELECT n_name, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN nation ON l_linenumber = n_nationkey GROUP BY n_name",
}
