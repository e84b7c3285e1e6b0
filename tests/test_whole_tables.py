"""Queries return the result over their whole tables, counted from the tables themselves."""

import os

import pyarrow.parquet as pq
import pytest

from oxbow.plans import registry
from tests.compare import rows, spark_rows

QUERIES = registry.queries()
SF = "/root/testdata/sf0.01"  # keys above those of the smallest tables


@pytest.fixture(scope="module")
def more():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF


def read(d, t, *columns):
    return pq.read_table(f"{d}/{t}.parquet", columns=list(columns)).to_pylist()


def test_compound_key_join_of_all_lines(spark, more):
    lines = read(more, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    top = {}
    for x in lines:
        k = x["l_orderkey"], x["l_partkey"]
        top[k] = max(top.get(k, x["l_quantity"]), x["l_quantity"])
    want = [(x["l_orderkey"], x["l_quantity"]) for x in lines if x["l_quantity"] == top[x["l_orderkey"], x["l_partkey"]]]
    assert spark_rows(QUERIES["join_compound_key"](spark, more)) == rows(["a_order", "qty"], want)


def test_arithmetic_over_all_lines(spark, more):
    keys = [(x["l_orderkey"], x["l_linenumber"], -x["l_quantity"]) for x in read(more, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")]
    assert spark_rows(QUERIES["proj_arith"](spark, more).select("l_orderkey", "l_linenumber", "neg")) == rows(["l_orderkey", "l_linenumber", "neg"], keys)


def test_nulls_first_over_all_orders(spark, more):
    orders = [(x["o_orderkey"], x["o_orderpriority"]) for x in read(more, "orders", "o_orderkey", "o_orderpriority")]
    want = sorted(((k, None if p == "3-MEDIUM" else p) for k, p in orders), key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert [tuple(r) for r in QUERIES["sort_nulls"](spark, more).collect()] == want


def test_redistributed_and_inserted_orders_are_whole(spark, more):
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    orders = [tuple(x[c] for c in columns) for x in read(more, "orders", *columns)]
    assert spark_rows(QUERIES["table_redistribute"](spark, more)) == rows(columns, orders)
    new = [(-k - 1, c, "N", None) for k, c, _, _ in orders]
    assert spark_rows(QUERIES["dml_insert"](spark, more)) == rows(columns, orders + new)
