"""Percentiles of very large numeric columns from mergeable digests.

Method: merging centroid digests. Sorted values (or centroids) are clustered by a size
function of their quantile, k(q) = delta / (2 pi) asin(2 q - 1): one cluster for each unit of
k, so clusters are narrow at the tails. Digests of separate partitions and days merge by
clustering their centroids again. A second pass counts the values below and at each estimate,
so every percentile comes with its certified rank error; one that misses the stated error is
moved to a value counted exactly.

Partial digests are built where the rows are: no raw value is shuffled, and a host with a third
of all rows is only a few centroids a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.llm.quality import exact_ranks
from oxbow.session import ensure_checkpoint_dir, spread, table

DELTA = 1000
#: Parts in which the digests of one group are put together first.
SALTS = 64
#: Stands for the null group where ranks are joined.
NO_GROUP = "\x01no group"
SCHEMA = "field string, grp string, day date, n long, low double, high double, means array<double>, weights array<long>"
COLUMNS = [x.split(" ")[0] for x in SCHEMA.split(", ")]


def cluster(values: np.ndarray, weights: np.ndarray, delta: float = DELTA) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (means, weights) of weighted values, in order."""
    if not len(values):
        return values.astype(float), weights.astype(np.int64)
    o = np.argsort(values, kind="stable")
    v, w = values[o].astype(float), weights[o].astype(np.int64)
    total = w.sum()
    mid = (np.cumsum(w) - w / 2) / total
    k = np.floor(delta / (2 * np.pi) * (np.arcsin(2 * mid - 1) + np.pi / 2)).astype(np.int64)
    new = np.r_[True, k[1:] != k[:-1]]
    at = np.flatnonzero(new)
    weight = np.add.reduceat(w, at)
    # the mean from the cluster's first value, so that equal values keep their value exactly
    first = v[at]
    shift = np.add.reduceat((v - np.repeat(first, np.diff(np.r_[at, len(v)]))) * w, at) / weight
    return first + shift, weight


def quantile(means: np.ndarray, weights: np.ndarray, low: float, high: float, q: float) -> float:
    """The value at rank q, between the middles of neighbouring centroids."""
    n = weights.sum()
    middle = np.cumsum(weights) - weights / 2
    return float(np.interp(q * n, np.r_[0, middle, n], np.r_[low, means, high]))


def _partial(delta: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def add(key: tuple, v: np.ndarray, w: np.ndarray) -> None:
            x = held.get(key)
            if x is None:
                held[key] = [[v], [w], len(v), v.min(), v.max()]
            else:
                x[0].append(v)
                x[1].append(w)
                x[2] += len(v)
                x[3], x[4] = min(x[3], v.min()), max(x[4], v.max())
                x = held[key]
            if held[key][2] > 10 * delta:
                squeeze(key)

        def squeeze(key: tuple) -> None:
            x = held[key]
            m, w = cluster(np.concatenate(x[0]), np.concatenate(x[1]), delta)
            x[0], x[1], x[2] = [m], [w], len(m)

        def frame() -> pd.DataFrame:
            rows = []
            for key, x in held.items():
                squeeze(key)
                rows.append((*key, int(x[1][0].sum()), float(x[3]), float(x[4]), x[0][0], x[1][0]))
            held.clear()
            return pd.DataFrame(rows, columns=COLUMNS)

        for b in parts:
            fields = [c for c in b.columns if c not in ("__grp", "__day")]
            group, groups = pd.factorize(b["__grp"], use_na_sentinel=False)
            date, dates = pd.factorize(b["__day"], use_na_sentinel=False)
            codes = group.astype(np.int64) * len(dates) + date
            order = np.argsort(codes, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0, True])
            for f in fields:
                v = b[f].to_numpy(float)[order]
                for i in range(len(edges) - 1):
                    x = v[edges[i] : edges[i + 1]]
                    x = x[~np.isnan(x)]
                    if len(x):
                        g, d = groups[group[order[edges[i]]]], dates[date[order[edges[i]]]]
                        add((f, None if pd.isna(g) else g, None if pd.isna(d) else d), *np.unique(x, return_counts=True))
            if len(held) > 20_000:
                yield frame()
        if held:
            yield frame()

    return run


def _merge_sorted(delta: int):
    """Digests in the order of their key, put together as they come: what is held of a key stays below 20 delta centroids."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        key: tuple | None = None
        means: list[np.ndarray] = []
        weights: list[np.ndarray] = []
        held = n = 0
        low = high = 0.0

        def close() -> None:
            m, w = cluster(np.concatenate(means), np.concatenate(weights), delta)
            rows.append((*key, n, low, high, m, w))  # type: ignore[misc]

        for b in parts:
            for f, g, d, c, lo, hi, m, w in b.itertuples(index=False):
                d = None if pd.isna(d) else d
                if (f, g, d) != key:
                    if key is not None:
                        close()
                    key, means, weights, held, n, low, high = (f, g, d), [], [], 0, 0, lo, hi
                means.append(np.asarray(m, float))
                weights.append(np.asarray(w, np.int64))
                held, n, low, high = held + len(m), n + c, min(low, lo), max(high, hi)
                if held > 20 * delta:
                    x, y = cluster(np.concatenate(means), np.concatenate(weights), delta)
                    means, weights, held = [x], [y], len(x)
            if len(rows) > 2000:
                yield pd.DataFrame(rows, columns=COLUMNS)
                rows.clear()
        if key is not None:
            close()
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS)

    return run


def merge(digests: DataFrame, keep_day: bool, delta: int = DELTA) -> DataFrame:
    """Digests put together by (field, grp) or (field, grp, day).

    By day, a group has a digest from each task that saw it: those are put together in SALTS parts first, so no task gets
    all of a hot group. Digests come in a fixed order, so a task that is run again gives the same centroids.
    """
    d = digests if keep_day else digests.withColumn("day", F.lit(None).cast("date"))
    keys, order = ["field", "grp", "day"], ["low", "high", "n"]
    d = d.select(*COLUMNS)
    if keep_day:
        salt = F.pmod(F.xxhash64(*order), F.lit(SALTS))
        d = d.repartition(*keys, salt).sortWithinPartitions(*keys, *order).mapInPandas(_merge_sorted(delta), SCHEMA)
    return d.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(_merge_sorted(delta), SCHEMA)


def daily_digests(df: DataFrame, group: Column, day: Column, fields: list[str], delta: int = DELTA) -> DataFrame:
    """One digest per field, group and day (SCHEMA). Null values are none; null groups and days are groups."""
    src = df.select(group.cast("string").alias("__grp"), day.cast("date").alias("__day"), *[F.col(f).cast("double").alias(f) for f in fields])
    return merge(spread(src).mapInPandas(_partial(delta), SCHEMA), keep_day=True, delta=delta)


def _estimates(qs: tuple[float, ...]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            rows = [
                (f, g, n, [quantile(np.asarray(m), np.asarray(w), lo, hi, q) for q in qs])
                for f, g, n, lo, hi, m, w in zip(b["field"], b["grp"], b["n"], b["low"], b["high"], b["means"], b["weights"])
            ]
            yield pd.DataFrame(rows, columns=["field", "grp", "n", "estimates"])

    return run


def group_percentiles(df: DataFrame, group: Column, day: Column, fields: list[str], qs: tuple[float, ...], error: float = 0.002, delta: int = DELTA) -> DataFrame:
    """grp, field, n, q, estimate, rank_error: the percentiles of each group over all days.

    rank_error is counted over all values: the distance from q to the nearest rank that the estimate
    holds (0 if values equal to it cover q), a share of the group's values. An estimate whose error is above ``error``, or above
    both that share of its smaller tail, error * min(q, 1 - q), and one value, is replaced by the exact percentile of its group, found by exact ranks of its values. Null values are none; a
    null group is a group. An empty input gives an empty result.
    """
    ensure_checkpoint_dir(df.sparkSession)
    digests = merge(daily_digests(df, group, day, fields, delta), keep_day=False, delta=delta)
    est = digests.select("field", "grp", "n", "low", "high", "means", "weights").mapInPandas(_estimates(qs), "field string, grp string, n long, estimates array<double>").checkpoint()
    wide = est.groupBy("grp").pivot("field", fields).agg(F.first("estimates"))
    wide = wide.select(F.col("grp").alias("__grp"), *[F.col(f"`{f}`").alias(f"__{f}") for f in fields])
    src = df.select(group.cast("string").alias("__of"), *[F.col(f).cast("double").alias(f) for f in fields])
    met = src.join(wide, F.col("__of").eqNullSafe(F.col("__grp")))
    counts = []
    for f in fields:
        for i in range(len(qs)):
            e = F.col(f"__{f}")[i]
            counts += [F.sum((F.col(f) < e).cast("long")).alias(f"{f}_{i}_lt"), F.sum((F.col(f) <= e).cast("long")).alias(f"{f}_{i}_le")]
    counted = met.groupBy("__of").agg(*counts)
    each = F.explode(
        F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("i"), F.lit(q).alias("q"), F.col(f"{f}_{i}_lt").alias("lt"), F.col(f"{f}_{i}_le").alias("le")) for f in fields for i, q in enumerate(qs)])
    )
    long = counted.select(F.col("__of").alias("g"), each.alias("x")).select("g", F.col("x.field").alias("f"), "x.i", "x.q", "x.lt", "x.le")
    out = est.join(long, (F.col("field") == F.col("f")) & F.col("grp").eqNullSafe(F.col("g")))
    target = F.col("q") * F.col("n")
    off = F.greatest(F.lit(0.0), F.col("lt") - target, target - F.col("le")) / F.col("n")
    certified = out.select("grp", "field", "n", "q", F.element_at("estimates", F.col("i") + 1).alias("estimate"), off.alias("rank_error")).checkpoint()
    allowed = F.least(F.lit(error), F.greatest(error * F.least(F.col("q"), 1 - F.col("q")), 1 / F.col("n")))
    good = certified.filter(F.col("rank_error") <= allowed)
    bad = certified.filter(F.col("rank_error") > allowed)
    if bad.isEmpty():
        return good
    return good.unionByName(_exact(df, group, bad))


def _exact(df: DataFrame, group: Column, bad: DataFrame) -> DataFrame:
    """The estimates that missed, replaced by the value of their rank: exact ranks of the values of those groups."""
    fields = sorted(r["field"] for r in bad.select("field").distinct().collect())  # at most the columns asked for
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("double").alias("v")) for f in fields]))
    long = df.select(group.cast("string").alias("g"), each.alias("x")).select("g", "x.f", "x.v").filter(F.col("v").isNotNull())
    groups = bad.select(F.col("grp").alias("bg"), F.col("field").alias("bf")).distinct()
    some = long.join(groups, (F.col("f") == F.col("bf")) & F.col("g").eqNullSafe(F.col("bg")), "left_semi")
    ranks = exact_ranks(some.select(F.col("f").alias("stat"), F.coalesce("g", F.lit(NO_GROUP)).alias("lang"), F.col("v").alias("value"))).drop("n")
    hit = bad.join(ranks, (F.col("field") == F.col("stat")) & (F.coalesce("grp", F.lit(NO_GROUP)) == F.col("lang")) & (F.col("below") / F.col("total") >= F.col("q")))
    return hit.groupBy("grp", "field", "n", "q").agg(F.min("value").alias("estimate")).withColumn("rank_error", F.lit(0.0)).select("grp", "field", "n", "q", "estimate", "rank_error")


FIELDS = ["phyio", "cacheio", "blockstouched"]
QS = (0.5, 0.9, 0.99, 0.999)


def _host() -> Column:
    return F.lower(F.element_at(F.split("host", ":"), 1))


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = group_percentiles(table(spark, d, "querystats"), _host(), F.col("starttime"), FIELDS, QS)
    return out.select(F.col("grp").alias("host_name"), "field", "n", "q", "estimate", "rank_error")


def p6_daily(spark: SparkSession, d: str) -> DataFrame:
    """Digests of single days, by host name and field."""
    return daily_digests(table(spark, d, "querystats"), _host(), F.col("starttime"), FIELDS).withColumnRenamed("grp", "host_name")
