"""User-defined functions, salted and streamed aggregation, plan introspection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.functions import udf
from oxbow.functions.dialect import warehouse_sql
from oxbow.session import register_views, table
from oxbow.sources.location import explain_text
from oxbow.streaming.events import stream_event_windows, windowed_counts


def udf_expression(spark: SparkSession, d: str) -> DataFrame:
    udf.register_examples(spark)
    register_views(spark, d, "part")
    return spark.sql("SELECT p_partkey, ox_add(p_size, p_retailprice) AS added, ox_isnull(nullif(p_type, 'SMALL')) AS nothing FROM part")


def udf_vectorised(spark: SparkSession, d: str) -> DataFrame:
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    udf.register_vectorised(spark, "ox_twice", twice, "double")
    register_views(spark, d, "part")
    return spark.sql("SELECT p_partkey, ox_twice(p_retailprice) AS v FROM part")


def explain_plan(spark: SparkSession, d: str) -> DataFrame:
    text = explain_text(table(spark, d, "orders").filter("o_totalprice > 1").select("o_orderkey"))
    return spark.createDataFrame([("PushedFilters" in text, "ReadSchema" in text)], "pushed boolean, pruned boolean")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events"))


def agg_approx(spark: SparkSession, d: str) -> DataFrame:
    """Approximate distinct counts and percentiles (mergeable sketches)."""
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey").alias("customers"), F.percentile_approx("o_totalprice", 0.5).alias("median"))


#: Statements as the warehouse's users write them, with their twins.
DIALECT = {
    "dialect_group_concat": ("SELECT n_regionkey, GROUP_CONCAT(DISTINCT n_name ORDER BY n_name DESC SEPARATOR '; ') AS names FROM nation GROUP BY n_regionkey",
                             "SELECT n_regionkey, string_agg(DISTINCT n_name, '; ' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey"),
    "dialect_limit": ("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5, 10;", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"),
    "dialect_dates": ("SELECT event_id, DATE_FORMAT(ts, '%d.%m.%Y %H:%i') AS a, WEEK(ts, 3) AS w, DATE_ADD(ts, INTERVAL 3 DAY) AS b, TO_DAYS(DATE(ts)) AS c FROM events",
                      "SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M') AS a, CAST(week(ts) AS INT) AS w, ts + INTERVAL 3 DAY AS b, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS BIGINT) + 719528 AS c FROM events"),
    "dialect_strings": ("SELECT p_partkey, SUBSTRING(p_name, 2, 3) AS a, ELT(p_size % 3, 'x', 'y') AS b, CONCAT_WS('/', p_brand, NULLIF(p_type, 'SMALL')) AS c, LENGTH(p_name) AS d, TRUNCATE(p_retailprice, -1) AS e FROM part WHERE p_name REGEXP '^red'",
                        "SELECT p_partkey, substring(p_name, 2, 3) AS a, CASE p_size % 3 WHEN 1 THEN 'x' WHEN 2 THEN 'y' END AS b, concat_ws('/', p_brand, nullif(p_type, 'SMALL')) AS c, strlen(p_name) AS d, CAST(trunc(CAST(p_retailprice AS DECIMAL(12,2)) / 10) AS DOUBLE) * 10 AS e FROM part WHERE p_name LIKE 'red%'"),
    "dialect_xor": ("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') XOR (o_totalprice > 250000)", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') <> (o_totalprice > 250000)"),
    "dialect_xor_operands": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' XOR o_totalprice > 250000 AND o_custkey > 5 OR o_orderkey < 10",
                             "SELECT o_orderkey FROM orders WHERE ((o_orderstatus = 'F') <> (o_totalprice > 250000 AND o_custkey > 5)) OR o_orderkey < 10"),
    "dialect_zero": ("SELECT o_orderkey, o_totalprice / (o_custkey - o_custkey) AS a, o_orderkey % (o_custkey - o_custkey) AS b, o_orderkey DIV (o_custkey - o_custkey) AS c, CAST(o_orderstatus AS SIGNED) AS e FROM orders",
                     "SELECT o_orderkey, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c, CAST(NULL AS BIGINT) AS e FROM orders"),
    "dialect_greatest": ("SELECT o_orderkey, GREATEST(o_orderstatus, 'M', o_orderpriority) AS s, LEAST(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS t, GREATEST(9007199254740993, o_orderkey) AS n, LEAST(NULL, o_custkey) AS z FROM orders",
                         "SELECT o_orderkey, greatest(o_orderstatus, 'M', o_orderpriority) AS s, least(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS t, greatest(9007199254740993, o_orderkey) AS n, CAST(NULL AS BIGINT) AS z FROM orders"),
    "dialect_str_to_date": ("SELECT event_id, STR_TO_DATE(DATE_FORMAT(ts, '%d.%m.%Y %H:%i:%s'), '%d.%m.%Y %H:%i:%s') AS t, STR_TO_DATE('no date', '%Y-%m-%d') AS n, GET_FORMAT(DATE, 'EUR') AS f FROM events",
                            "SELECT event_id, date_trunc('second', ts) AS t, CAST(NULL AS TIMESTAMP) AS n, '%d.%m.%Y' AS f FROM events"),
    "dialect_extract": ("SELECT event_id, EXTRACT(YEAR_MONTH FROM ts) AS a, EXTRACT(DAY_MINUTE FROM ts) AS b, EXTRACT(HOUR FROM ts) AS c FROM events",
                        "SELECT event_id, CAST(year(ts) * 100 + month(ts) AS BIGINT) AS a, CAST(day(ts) * 10000 + hour(ts) * 100 + minute(ts) AS BIGINT) AS b, CAST(hour(ts) AS BIGINT) AS c FROM events"),
    "dialect_intervals": ("SELECT event_id, DATE_ADD(ts, INTERVAL '1-2' YEAR_MONTH) AS a, DATE_SUB(ts, INTERVAL '3 4:05' DAY_MINUTE) AS b, DATE_ADD(ts, INTERVAL user_id HOUR) AS c FROM events",
                          "SELECT event_id, ts + INTERVAL 14 MONTH AS a, ts - INTERVAL 3 DAY - INTERVAL 4 HOUR - INTERVAL 5 MINUTE AS b, ts + user_id * INTERVAL 1 HOUR AS c FROM events"),
    "dialect_truncate": ("SELECT p_partkey, TRUNCATE(p_retailprice / 7, 12) AS a, TRUNCATE(-p_retailprice, -2) AS b, TRUNCATE(p_retailprice, 40) AS c FROM part",
                         "SELECT p_partkey, CAST(trunc(CAST(p_retailprice / 7 AS DECIMAL(38,18)), 12) AS DOUBLE) AS a, -trunc(p_retailprice / 100) * 100 AS b, p_retailprice AS c FROM part"),
    "dialect_casts": ("SELECT o_orderkey, CAST(o_orderkey AS UNSIGNED) AS u, CONVERT(o_orderkey, CHAR) AS c, CAST('2014-03-05 10:11:12' AS DATETIME) AS t, FORMAT(o_orderkey * 1000, 1) AS f FROM orders",
                      "SELECT o_orderkey, CAST(o_orderkey AS DECIMAL(20,0)) AS u, CAST(o_orderkey AS VARCHAR) AS c, TIMESTAMP '2014-03-05 10:11:12' AS t, format('{:,}', o_orderkey * 1000) || '.0' AS f FROM orders"),
    "dialect_row_equal": ("SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) = (SELECT max(o_custkey), 'F' FROM orders)",
                          "SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders) AND o_orderstatus = 'F'"),
    "dialect_row_not_equal": ("SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) <> (SELECT max(o_custkey), 'F' FROM orders)",
                              "SELECT o_orderkey FROM orders WHERE NOT (o_custkey = (SELECT max(o_custkey) FROM orders) AND o_orderstatus = 'F')"),
}


def _dialect(text: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        register_views(spark, d, "nation", "orders", "events", "part")
        return warehouse_sql(spark, text)

    return query


QUERIES = {f.__name__: f for f in (udf_expression, udf_vectorised, explain_plan, event_windows, stream_event_windows, agg_approx)} | {n: _dialect(x) for n, (x, _) in DIALECT.items()}
ORACLE = {n: y for n, (_, y) in DIALECT.items()} | {
    "udf_expression": "SELECT p_partkey, p_size + p_retailprice AS added, nullif(p_type, 'SMALL') IS NULL AS nothing FROM part",
    "udf_vectorised": "SELECT p_partkey, p_retailprice * 2 AS v FROM part",
    "explain_plan": "SELECT TRUE AS pushed, TRUE AS pruned",
    "stream_event_windows": """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2
HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
