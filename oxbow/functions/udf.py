"""User-defined functions: a registry for SQL and DataFrame use.

A function is registered as an SQL expression (inlined by the optimizer, the fast way) or as
a vectorised Python function over Arrow batches. Row-at-a-time Python is not offered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_expression(spark: SparkSession, name: str, params: str, result: str, body: str) -> None:
    """``name(params)`` as an SQL expression."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")


def register_vectorised(spark: SparkSession, name: str, fn: Callable, result: str) -> Callable:
    """``fn``, from pandas Series to a pandas Series (with type hints), under ``name`` in SQL; also returned for columns."""
    made = F.pandas_udf(fn, result)
    spark.udf.register(name, made)
    return made


def register_examples(spark: SparkSession) -> None:
    """ox_add(a, b): the sum as double; ox_isnull(x)."""
    register_expression(spark, "ox_add", "a DOUBLE, b DOUBLE", "DOUBLE", "a + b")
    register_expression(spark, "ox_isnull", "x STRING", "BOOLEAN", "x IS NULL")
