"""Properties of the engine: streams equal tables, errors where the warehouse has them, plans."""

import datetime

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException

from oxbow.plans import registry
from oxbow.plans.relational import small_enough
from oxbow.session import register_views, set_priority, spread
from oxbow.sources.location import explain_text
from oxbow.streaming.events import stream_event_windows, windowed_counts


def test_stream_equals_table(spark, sf):
    """All windows that the watermark passed come out of the stream, with the table's numbers."""
    batch = {(r["window_start"], r["event_type"]): (r["n"], r["total"]) for r in windowed_counts(spark.read.parquet(f"{sf}/events.parquet")).collect()}
    got = {(r["window_start"], r["event_type"]): (r["n"], r["total"]) for r in stream_event_windows(spark, sf).collect()}
    last = spark.read.parquet(f"{sf}/events.parquet").agg({"ts": "max"}).first()[0]
    closed = {k: v for k, v in batch.items() if k[0] + datetime.timedelta(hours=1) <= last - datetime.timedelta(minutes=10)}
    assert got == closed and len(got) > 0


def test_scalar_subquery_of_two_rows_fails(spark, sf):
    register_views(spark, sf, "nation", "region")
    with pytest.raises(Py4JJavaError, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        spark.sql("SELECT r_name FROM region WHERE r_regionkey = (SELECT n_regionkey FROM nation)").collect()


def test_distinct_and_limit_plans(spark, sf):
    q = registry.queries()
    assert "TakeOrderedAndProject" in explain_text(q["topk_offset"](spark, sf))
    assert "BroadcastHashJoin" in explain_text(q["join_broadcast"](spark, sf))
    assert q["join_null_aware_anti"](spark, sf)._jdf.queryExecution().executedPlan().toString().count("LeftAnti, BuildRight, true") == 1
    scan = explain_text(q["scan_filter_pushdown"](spark, sf))
    assert "LessThan(l_shipdate" in scan and "GreaterThanOrEqual(l_quantity,49.0)" in scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double,l_shipdate:timestamp_ntz>" in scan


def test_helpers(spark, sf):
    df = spark.read.parquet(f"{sf}/nation.parquet")
    assert small_enough(df, 1 << 20) and not small_enough(df, 10)
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10b")
        assert spread(df) is df
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    set_priority(spark, "high")
    assert df.count() == 25
    set_priority(spark, None)


@pytest.mark.parametrize("text", [
    "SELECT sum(value) OVER (ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND 1 PRECEDING) FROM events",  # bounds the wrong way round
    "SELECT sum(value) OVER (ORDER BY event_id, user_id RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) FROM events",  # a range over two keys
    "SELECT rank() OVER (PARTITION BY user_id) FROM events",  # no order
    "SELECT event_id FROM events WHERE row_number() OVER (ORDER BY event_id) < 3",
    "SELECT no_such_function(event_id) FROM events",
])
def test_refused_forms(spark, sf, text):
    register_views(spark, sf, "events")
    with pytest.raises(AnalysisException):
        spark.sql(text).collect()
