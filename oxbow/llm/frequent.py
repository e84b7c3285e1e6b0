"""Most frequent values of a column.

Method: exact spillable aggregation. Each column's values are grouped by hash with map-side
combining (fixed-width keys and counters: Spark's hash aggregation, which spills), every
partition keeps its own largest groups, and one ordered limit makes the final list. A value
can't be more frequent than its hash, so the values behind the listed hashes, counted exactly in
a second narrow pass, are all there is: hundreds of millions of distinct strings never
leave their map tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.session import table


def _long(df: DataFrame, fields: list[str]) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("item")) for f in fields]))
    return df.select(each.alias("x")).select("x.field", "x.item").filter(F.col("item").isNotNull())


def _counted(df: DataFrame, fields: list[str], hashes: DataFrame) -> DataFrame:
    """Exact counts of the values whose hash is listed. ``hashes``: field, h."""
    long = _long(df, fields).withColumn("h", F.xxhash64("item"))
    return long.join(hashes, ["field", "h"]).groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))


def frequent_items(df: DataFrame, fields: list[str], share: float) -> DataFrame:
    """field, item, n: the values that stand in at least ``share`` of all rows, with exact counts.

    Values are compared exactly as stored (as text); null is none, an empty text is one. Rows with
    null count among all rows. At most 1 / share hashes of a field pass the first aggregation, the
    bound of what the second pass looks for. An empty input gives an empty result.
    """
    total = df.count()
    k = math.floor(1 / share) * len(fields)
    least = share * total
    by_hash = _long(df, fields).groupBy("field", F.xxhash64("item").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    # top k of each partition, then one ordered limit; k = 1 / share a field can't lose a frequent value
    top = by_hash.filter(F.col("n") >= least).orderBy(F.desc("n")).limit(k)
    return _counted(df, fields, F.broadcast(top.select("field", "h"))).filter(F.col("n") >= least)


def top_items(df: DataFrame, field: str, k: int) -> DataFrame:
    """item, n: the k most frequent values (ties by value), exactly. Null is none."""
    by_item = df.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return by_item.orderBy(F.desc("n"), "item").limit(k)


def p4_items(spark: SparkSession, d: str) -> DataFrame:
    """The frequent values with their counts."""
    return frequent_items(table(spark, d, "querystats"), ["query", "user_name"], 0.01)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_items(spark, d).select("field", "item")


def p4_top_users(spark: SparkSession, d: str) -> DataFrame:
    return top_items(table(spark, d, "querystats"), "user_name", 20)


ORACLE = {
    "p4_found": """
SELECT field, item FROM (
  SELECT 'query' AS field, query AS item, count(*) AS n FROM querystats WHERE query IS NOT NULL GROUP BY query
  UNION ALL SELECT 'user_name', user_name, count(*) FROM querystats WHERE user_name IS NOT NULL GROUP BY user_name)
WHERE n >= 0.01 * (SELECT count(*) FROM querystats)""",
    "p4_items": """
SELECT field, item, n FROM (
  SELECT 'query' AS field, query AS item, count(*) AS n FROM querystats WHERE query IS NOT NULL GROUP BY query
  UNION ALL SELECT 'user_name', user_name, count(*) FROM querystats WHERE user_name IS NOT NULL GROUP BY user_name)
WHERE n >= 0.01 * (SELECT count(*) FROM querystats)""",
    "p4_top_users": """
SELECT user_name AS item, count(*) AS n FROM querystats WHERE user_name IS NOT NULL
GROUP BY user_name ORDER BY n DESC, item LIMIT 20""",
}
