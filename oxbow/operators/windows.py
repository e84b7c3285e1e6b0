"""Window forms that Spark has no direct syntax for.

Those with a running count or sum take it from ``ranged_sums``: a partition with a third of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from oxbow.operators.ranks import ranged_sums


def whole(*partition: str) -> WindowSpec:
    """Whole-partition frame."""
    return Window.partitionBy(*partition).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def running(partition: list[str], order: list) -> WindowSpec:
    """Frame from the partition's start to this row."""
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def with_distinct(df: DataFrame, c: str, partition: list[str], count: str, total: str, mean: str) -> DataFrame:
    """COUNT, SUM and AVG (DISTINCT c) OVER whole partitions.

    By a grouped aggregation that is joined back: no partition's set of values is held in one row. Null
    partition values form a partition; without values the sum and the mean are null.
    """
    sums = df.groupBy(*partition).agg(
        F.count_distinct(c).alias(count), F.sum_distinct(F.col(c).cast("double")).alias(total), (F.sum_distinct(F.col(c).cast("double")) / F.nullif(F.count_distinct(c), F.lit(0))).alias(mean)
    )
    keys = sums.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(partition)], count, total, mean)
    on = F.lit(True)
    for i, p in enumerate(partition):
        on = on & F.col(p).eqNullSafe(F.col(f"__p{i}"))
    return df.join(keys, on).drop(*[f"__p{i}" for i in range(len(partition))])


def lag_default(c: str, n: int, default: Column, w: WindowSpec, lead: bool = False) -> Column:
    """LAG/LEAD that gives the default also where the row is there and its value is null."""
    return F.coalesce((F.lead if lead else F.lag)(c, n).over(w), default)


def with_lag_ignore_nulls(df: DataFrame, c: str, n: int, partition: list[str], order: list, out: str) -> DataFrame:
    """LAG(c, n) IGNORE NULLS: the n-th value before each row that isn't null, or null.

    Values that aren't null are numbered; a row that has k of them before it takes number k - n + 1 by an
    equi-join, so no list of a partition is built.
    """
    there = F.col(c).isNotNull().cast("long")
    base = ranged_sums(df, partition, order, {"__upto": there}).withColumn("__before", F.col("__upto") - there)
    values = base.filter(F.col(c).isNotNull()).select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(partition)], (F.col("__before") + n).alias("__at"), F.col(c).alias(out))
    on = F.col("__before") == F.col("__at")
    for i, p in enumerate(partition):
        on = on & F.col(p).eqNullSafe(F.col(f"__p{i}"))
    return base.join(values, on, "left").select(*df.columns, out)


def with_lag_by_column(df: DataFrame, c: str, offset: str, partition: list[str], order: list, out: str) -> DataFrame:
    """LAG(c, offset) where the offset is a column: the value so many rows before, after if it is negative, null where there is none.

    Rows are numbered and each meets the number it asks for by an equi-join. A null offset gives null.
    """
    base = ranged_sums(df, partition, order, {"__rn": F.lit(1).cast("long")})
    values = base.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(partition)], F.col("__rn").alias("__at"), F.col(c).alias(out))
    on = F.col("__rn") - F.col(offset) == F.col("__at")
    for i, p in enumerate(partition):
        on = on & F.col(p).eqNullSafe(F.col(f"__p{i}"))
    return base.join(values, on, "left").select(*df.columns, out)


def nth_from_last(c: str, n: int, partition: list[str], order: list) -> Column:
    """NTH_VALUE(c, n) FROM LAST over the whole partition: the order must be given reversed."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.nth_value(c, n).over(w)


def over_column_bounds(df: DataFrame, kind: str, c: str, before: str, after: str, partition: list[str], order: list, out: str) -> DataFrame:
    """``kind`` ('sum', 'count' or 'avg') over ROWS BETWEEN before PRECEDING AND after FOLLOWING where both bounds are columns; see ``sum_over_column_bounds``."""
    if kind not in ("sum", "count", "avg"):
        raise ValueError(f"no running form of {kind}")
    rows = sum_over_column_bounds(df, c, before, after, partition, order, "__sum_out")
    flags = rows.withColumn("__one", F.col(c).isNotNull().cast("int"))
    both = sum_over_column_bounds(flags, "__one", before, after, partition, order, "__n_out")
    n = F.coalesce("__n_out", F.lit(0))
    known = F.col(before).isNotNull() & F.col(after).isNotNull()
    made = {"sum": F.col("__sum_out"), "count": F.when(known, n), "avg": F.col("__sum_out") / F.nullif(n, F.lit(0))}[kind]
    return both.withColumn(out, made).select(*df.columns, out)


def sum_over_column_bounds(df: DataFrame, c: str, before: str, after: str, partition: list[str], order: list, out: str) -> DataFrame:
    """SUM over ROWS BETWEEN before PRECEDING AND after FOLLOWING where both bounds are columns.

    By running sums: the frame's sum is the difference of two of them, met by an equi-join on the row
    number, so no partition is collected. A null bound gives null; negative bounds count as zero; an
    empty frame gives null.
    """
    one = F.lit(1).cast("long")
    base = ranged_sums(df, partition, order, {"__rn": one, "__sum": F.coalesce(F.col(c), F.lit(0)), "__cnt": F.col(c).isNotNull().cast("long")})
    sizes = df.groupBy(*partition).agg(F.count(F.lit(1)).alias("__n")).select(*[F.col(p).alias(f"__z{i}") for i, p in enumerate(partition)], "__n")
    same = F.lit(True)
    for i, p in enumerate(partition):
        same = same & F.col(p).eqNullSafe(F.col(f"__z{i}"))
    base = base.join(sizes, same).drop(*[f"__z{i}" for i in range(len(partition))])
    base = base.withColumns({"__lo": F.greatest(F.lit(0), F.col("__rn") - F.greatest(F.col(before), F.lit(0)) - 1), "__hi": F.least("__n", F.col("__rn") + F.greatest(F.col(after), F.lit(0)))})
    marks = base.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(partition)], F.col("__rn").alias("__at"), F.col("__sum").alias("__s"), F.col("__cnt").alias("__c"))

    def met(left: DataFrame, at: str, tag: str) -> DataFrame:
        m = marks.select(*[F.col(f"__p{i}").alias(f"__{tag}{i}") for i in range(len(partition))], F.col("__at").alias(f"__{tag}at"), F.col("__s").alias(f"__{tag}s"), F.col("__c").alias(f"__{tag}c"))
        on = F.col(at) == F.col(f"__{tag}at")
        for i, p in enumerate(partition):
            on = on & F.col(p).eqNullSafe(F.col(f"__{tag}{i}"))
        return left.join(m, on, "left")

    x = met(met(base, "__lo", "l"), "__hi", "h")
    total = F.col("__hs") - F.coalesce("__ls", F.lit(0))
    some = F.col("__hc") - F.coalesce("__lc", F.lit(0)) > 0
    return x.withColumn(out, F.when(F.col(before).isNotNull() & F.col(after).isNotNull() & some, total)).select(*df.columns, out)
