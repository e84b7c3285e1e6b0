"""Queries given as SQL text: one text for Spark, and the SQL twin where the dialects differ."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oxbow.session import TABLES, register_views

NAMES = re.compile(r"\b(" + "|".join(TABLES) + r")\b")


def from_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the tables that its text names."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        register_views(spark, d, *sorted(set(NAMES.findall(text))))
        return spark.sql(text)

    return run


def split(texts: dict[str, str | tuple[str, str | None]]) -> tuple[dict, dict]:
    """queries and their twins from {name: text} or {name: (Spark text, twin or None)}."""
    queries, oracle = {}, {}
    for name, x in texts.items():
        spark_text, twin = (x, x) if isinstance(x, str) else x
        queries[name] = from_sql(spark_text)
        if twin is not None:
            oracle[name] = twin
    return queries, oracle
