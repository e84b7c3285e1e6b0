"""Window functions: ranking, analytic, framed, distinct, percentile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oxbow.operators import windows as W
from oxbow.plans.sqlrun import split
from oxbow.session import table

E1 = "nullif(event_type, 'error')"
TEXTS: dict[str, str | tuple[str, str | None]] = {
    "win_count": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, count(nullif(o_orderpriority, '5-LOW')) OVER (PARTITION BY o_custkey) AS nv FROM orders",
    "win_sum_avg": """SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS s, round(avg(o_totalprice) OVER w, 4) AS a FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "win_min_max": """SELECT o_orderkey, min(o_totalprice) OVER w AS lo, max(o_orderpriority) OVER w AS hi FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "win_stats": """SELECT o_orderkey, round(stddev_pop(o_totalprice) OVER w, 3) AS sp, round(stddev_samp(o_totalprice) OVER w, 3) AS ss, round(var_pop(o_totalprice / 1000) OVER w, 4) AS vp, round(var_samp(o_totalprice / 1000) OVER w, 4) AS vs FROM orders
  WINDOW w AS (PARTITION BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "win_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
    "win_rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS dr FROM part",
    "win_percent_rank": "SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS pr FROM part",
    "win_cume_dist": "SELECT p_partkey, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 9) AS cd FROM part",
    "win_lag_lead": """SELECT event_id, lag(value, 1) OVER w AS before1, lag(value, 2, -1.0) OVER w AS before2, lead(value, 1, 0.0) OVER w AS after1 FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "win_first_last": f"""SELECT event_id, first_value({E1}) OVER w AS f, last_value({E1}) OVER w AS l FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)""",
    "win_first_last_ignore_nulls": (f"""SELECT event_id, first_value({E1}) IGNORE NULLS OVER w AS f, last_value({E1}) IGNORE NULLS OVER w AS l FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)""",
                                    f"""SELECT event_id, first_value({E1} IGNORE NULLS) OVER w AS f, last_value({E1} IGNORE NULLS) OVER w AS l FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING)"""),
    "win_default_frame": "SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS s, count(*) OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS n, last_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM events",
    "win_lead_ignore_nulls": (f"SELECT event_id, lead({E1}, 2) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY event_id) AS second_after FROM events",
                              f"SELECT event_id, lead({E1}, 2 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS second_after FROM events"),
    "win_nth_ignore_nulls": (f"""SELECT event_id, nth_value({E1}, 3) IGNORE NULLS OVER w AS third FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
                             f"""SELECT event_id, nth_value({E1}, 3 IGNORE NULLS) OVER w AS third FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""),
    "win_nth_value": """SELECT event_id, nth_value(value, 3) OVER w AS third FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "win_ntile": "SELECT o_orderkey, ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS bucket FROM orders",
    "win_percentile_cont": ("SELECT p_partkey, round(percentile_cont(0.3) WITHIN GROUP (ORDER BY p_retailprice) OVER (PARTITION BY p_brand), 6) AS p30 FROM part",
                            "SELECT p_partkey, round(q, 6) AS p30 FROM part JOIN (SELECT p_brand AS b, quantile_cont(p_retailprice, 0.3) AS q FROM part GROUP BY p_brand) x ON p_brand = b"),
    "win_percentile_disc": ("SELECT p_partkey, percentile_disc(0.3) WITHIN GROUP (ORDER BY p_size) OVER (PARTITION BY p_brand) AS p30 FROM part",
                            "SELECT p_partkey, CAST(q AS DOUBLE) AS p30 FROM part JOIN (SELECT p_brand AS b, quantile_disc(p_size, 0.3) AS q FROM part GROUP BY p_brand) x ON p_brand = b"),
    "win_regr": """SELECT p_brand, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 4) AS intercept, CAST(regr_count(p_retailprice, p_size) AS BIGINT) AS n,
  round(regr_r2(p_retailprice, p_size), 6) AS r2, round(regr_avgx(p_retailprice, p_size), 6) AS ax, round(regr_avgy(p_retailprice, p_size), 4) AS ay, round(regr_sxx(p_retailprice, p_size), 6) AS sxx,
  round(regr_sxy(p_retailprice, p_size), 6) AS sxy, round(regr_syy(p_retailprice, p_size), 5) AS syy FROM part GROUP BY p_brand""",
    "win_regr_over": "SELECT p_partkey, round(regr_slope(p_retailprice, p_size) OVER (PARTITION BY p_brand), 6) AS slope FROM part",
    "win_frame_rows": """SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead,
  count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM orders""",
    "win_frame_range": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 3 FOLLOWING) AS near FROM part",
    "win_frame_range_desc": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size DESC RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS near FROM part",
    "win_frame_range_interval": """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS last_hour FROM events""",
    "win_running_reverse": "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top_later FROM orders",
    "win_no_partition": "SELECT n_nationkey, row_number() OVER (ORDER BY n_name DESC) AS rn, CAST(sum(n_regionkey) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s FROM nation",
    "win_over_aggregate": """SELECT o_orderstatus, o_orderpriority, n, rank() OVER (PARTITION BY o_orderstatus ORDER BY n DESC) AS r, round(100.0 * n / sum(n) OVER (PARTITION BY o_orderstatus), 4) AS pct
FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority) x""",
    "win_expression": "SELECT o_orderkey, o_totalprice - min(o_totalprice) OVER (PARTITION BY o_custkey) AS above_min FROM orders",
    "win_topk_per_group": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) x WHERE rn <= 2",
}

QUERIES, ORACLE = split(TEXTS)


def win_distinct(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return W.with_distinct(t, "p_size", ["p_brand"], "n", "s", "a").select("p_partkey", "n", "s", F.round("a", 6).alias("a"))


def win_lag_default(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").withColumn("v", F.nullif("event_type", F.lit("error")))
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t.select("event_id", W.lag_default("v", 1, F.lit("none"), w).alias("before"), W.lag_default("v", 1, F.lit("none"), w, lead=True).alias("after"))


def win_lag_ignore_nulls(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select("event_id", "user_id", F.nullif("event_type", F.lit("error")).alias("v"))
    return W.with_lag_ignore_nulls(t, "v", 2, ["user_id"], ["event_id"], "second_before").select("event_id", "second_before")


def win_nth_from_last(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", W.nth_from_last("value", 2, ["user_id"], [F.desc("event_id")]).alias("second_last"))


def win_frame_column_bound(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.pmod("o_orderkey", F.lit(4)).alias("b"), F.pmod("o_custkey", F.lit(3)).alias("f"))
    return W.sum_over_column_bounds(t, "o_orderkey", "b", "f", ["o_custkey"], ["o_orderkey"], "s").select("o_orderkey", "s")


def win_lag_by_column(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").select("event_id", "user_id", "value", (F.pmod("event_id", F.lit(5)) - 1).alias("back"))
    return W.with_lag_by_column(t, "value", "back", ["user_id"], ["event_id"], "v").select("event_id", "v")


def win_frame_column_bound_avg(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey")).alias("v"), F.pmod("o_orderkey", F.lit(4)).alias("b"), F.pmod("o_custkey", F.lit(3)).alias("f"))
    a = W.over_column_bounds(t, "avg", "v", "b", "f", ["o_custkey"], ["o_orderkey"], "a")
    return W.over_column_bounds(a, "count", "v", "b", "f", ["o_custkey"], ["o_orderkey"], "n").select("o_orderkey", F.round("a", 6).alias("a"), "n")


QUERIES |= {
    "win_lag_by_column": win_lag_by_column, "win_frame_column_bound_avg": win_frame_column_bound_avg,
    "win_distinct": win_distinct, "win_lag_default": win_lag_default, "win_lag_ignore_nulls": win_lag_ignore_nulls,
    "win_nth_from_last": win_nth_from_last, "win_frame_column_bound": win_frame_column_bound,
}
ORACLE |= {
    "win_lag_by_column": """WITH t AS (SELECT event_id, user_id, value, event_id % 5 - 1 AS back, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
SELECT a.event_id, b.value AS v FROM t a LEFT JOIN t b ON a.user_id = b.user_id AND b.rn = a.rn - a.back""",
    "win_frame_column_bound_avg": """WITH t AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS v, o_orderkey % 4 AS b, o_custkey % 3 AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT a.o_orderkey, round(avg(x.v), 6) AS a, count(x.v) AS n FROM t a JOIN t x ON a.o_custkey = x.o_custkey AND x.rn BETWEEN a.rn - a.b AND a.rn + a.f GROUP BY a.o_orderkey""",
    "win_distinct": "SELECT p_partkey, count(DISTINCT p_size) OVER w AS n, CAST(sum(DISTINCT p_size) OVER w AS DOUBLE) AS s, round(avg(DISTINCT p_size) OVER w, 6) AS a FROM part WINDOW w AS (PARTITION BY p_brand)",
    "win_lag_default": f"SELECT event_id, coalesce(lag({E1}) OVER w, 'none') AS before, coalesce(lead({E1}) OVER w, 'none') AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "win_lag_ignore_nulls": f"SELECT event_id, lag({E1}, 2 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS second_before FROM events",
    "win_nth_from_last": "SELECT event_id, nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_last FROM events",
    "win_frame_column_bound": """WITH t AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS b, o_custkey % 3 AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT a.o_orderkey, CAST(sum(x.o_orderkey) AS BIGINT) AS s FROM t a JOIN t x ON a.o_custkey = x.o_custkey AND x.rn BETWEEN a.rn - a.b AND a.rn + a.f GROUP BY a.o_orderkey""",
}
