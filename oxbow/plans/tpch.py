"""The 22 decision-support queries, with literals and columns that these tables have.

There is no table of offers: where one is needed, lineitem grouped by part and supplier stands in.
Commit and receipt dates give way to ship and order dates.
"""

from __future__ import annotations

from oxbow.plans.sqlrun import split

OFFERS = """(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, round(sum(l_quantity), 2) AS ps_availqty,
  round(min(l_extendedprice), 2) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"""
VOLUME = "l_extendedprice * (1 - l_discount)"
YEAR = "CAST(extract(year FROM {}) AS INT)".format

TEXTS = {
    "tpch_q01": f"""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum({VOLUME}), 2) AS sum_disc_price, round(sum({VOLUME} * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '2001-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q02": f"""
WITH offers AS {OFFERS}
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand
FROM part, supplier, offers, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND p_type = 'PROMO' AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND ps_supplycost = (SELECT min(ps_supplycost) FROM offers, supplier, nation, region
    WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q03": f"""
SELECT l_orderkey, round(sum({VOLUME}), 4) AS revenue, o_orderdate
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q04": """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'
  AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate)
GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q05": f"""
SELECT n_name, round(sum({VOLUME}), 4) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'
GROUP BY n_name ORDER BY revenue DESC""",
    "tpch_q06": """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
    "tpch_q07": f"""
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, {YEAR("l_shipdate")} AS l_year, {VOLUME} AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6') OR (n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7'))
    AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1998-12-31') shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q08": f"""
SELECT o_year, round(sum(CASE WHEN nation_name = 'NATION_2' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT {YEAR("o_orderdate")} AS o_year, {VOLUME} AS volume, n2.n_name AS nation_name
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
    AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey
    AND o_orderdate BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND p_type = 'ECONOMY') all_nations
GROUP BY o_year ORDER BY o_year""",
    "tpch_q09": f"""
WITH red AS (SELECT p_partkey FROM part WHERE p_name LIKE '%red%'),
offers AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, round(min(l_extendedprice), 2) AS ps_supplycost
  FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM red) GROUP BY l_partkey, l_suppkey)
SELECT nation_name, o_year, round(sum(amount), 4) AS sum_profit FROM (
  SELECT n_name AS nation_name, {YEAR("o_orderdate")} AS o_year, {VOLUME} - ps_supplycost * l_quantity / 100 AS amount
  FROM red, supplier, lineitem, offers, orders, nation
  WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey
    AND s_nationkey = n_nationkey) profit
GROUP BY nation_name, o_year ORDER BY nation_name, o_year DESC""",
    "tpch_q10": f"""
SELECT c_custkey, c_name, round(sum({VOLUME}), 4) AS revenue, c_acctbal, n_name
FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1998-10-01' AND o_orderdate < DATE '1999-01-01'
  AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
WITH offers AS {OFFERS}, held AS (
  SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 2) AS worth FROM offers, supplier, nation
  WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY ps_partkey)
SELECT ps_partkey, worth FROM held WHERE worth > (SELECT sum(worth) * 0.002 FROM held) ORDER BY worth DESC, ps_partkey""",
    "tpch_q12": """
SELECT l_returnflag, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1.0 ELSE 0.0 END) AS high_line_count,
  sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1.0 ELSE 0.0 END) AS low_line_count
FROM orders, lineitem
WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01'
GROUP BY l_returnflag ORDER BY l_returnflag""",
    "tpch_q13": """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%'
  GROUP BY c_custkey) c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": f"""
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {VOLUME} ELSE 0 END) / sum({VOLUME}), 6) AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""",
    "tpch_q15": f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({VOLUME}), 4) AS total_revenue FROM lineitem
  WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue
WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "tpch_q16": f"""
WITH offers AS {OFFERS}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM offers, part
WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch_q17": """
SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
    "tpch_q18": """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty
FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": f"""
SELECT round(sum({VOLUME}), 4) AS revenue FROM lineitem, part
WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
   OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
   OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 50)""",
    "tpch_q20": f"""
WITH offers AS {OFFERS}
SELECT s_name, s_suppkey FROM supplier, nation
WHERE s_suppkey IN (SELECT ps_suppkey FROM offers WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%')
    AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey
      AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1999-01-01'))
  AND s_nationkey = n_nationkey AND n_name IN ('NATION_3', 'NATION_7', 'NATION_15') ORDER BY s_name""",
    "tpch_q21": """
SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate
  AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
  AND s_nationkey = n_nationkey AND n_regionkey = 2
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": """
SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
  SELECT substring(c_name, 17, 2) AS cntrycode, c_acctbal FROM customer
  WHERE substring(c_name, 17, 2) IN ('13', '31', '23', '29', '30', '18', '17')
    AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00 AND substring(c_name, 17, 2) IN ('13', '31', '23', '29', '30', '18', '17'))
    AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)) custsale
GROUP BY cntrycode ORDER BY cntrycode""",
}

QUERIES, ORACLE = split(TEXTS)
