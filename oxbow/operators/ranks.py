"""Exact row numbers inside groups of any size, without one task holding a whole group.

A window over a hot group sends all its rows to one task. Here a group is cut into
slices that follow the order (``slice_col`` must be non-decreasing in ``order``): every
slice is numbered on its own and the sizes of the earlier slices are added. Slices are
values of the data, so a recomputed task gives the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oxbow.session import ensure_checkpoint_dir, parallelism


def sliced_sums(df: DataFrame, group: list[str], order: list, slice_expr: Column, sums: dict[str, Column]) -> DataFrame:
    """Add the running sum of each column of ``sums`` (own row included) in its group by ``order``.

    Ties are taken in an unspecified order. Null group values form a group. An empty input gives an empty result.
    """
    s = "__slice"
    cut = df.withColumns({s: slice_expr, **{f"__v{i}": c for i, c in enumerate(sums.values())}})
    totals = cut.groupBy(*group, s).agg(*[F.sum(f"__v{i}").alias(f"__t{i}") for i in range(len(sums))])
    before = Window.partitionBy(*group).orderBy(F.col(s).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col(s).alias("__s"),
        *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))],
    )
    inside = Window.partitionBy(*group, s).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = F.col(s).eqNullSafe(F.col("__s"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    local = cut.withColumns({f"__l{i}": F.coalesce(F.sum(f"__v{i}").over(inside), F.lit(0)) for i in range(len(sums))})
    return local.join(offsets, on).select(*df.columns, *[(F.col(f"__l{i}") + F.col(f"__b{i}")).alias(n) for i, n in enumerate(sums)])


def sliced_row_number(df: DataFrame, group: list[str], order: list, slice_expr: Column, out: str) -> DataFrame:
    """Add ``out``: the 1-based position of each row in its group by ``order``; see ``sliced_sums``."""
    return sliced_sums(df, group, order, slice_expr, {out: F.lit(1).cast("long")})


def ranged_sums(df: DataFrame, group: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """``sliced_sums`` where nothing is known of the order: rows are range partitioned by group and order, and the partitions are the slices.

    The partitioned rows are written first, so a task that is run again finds them where they were.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(parallelism(df.sparkSession), *group, *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    return sliced_sums(ranged, group, order, F.col("__part"), sums).drop("__part")
