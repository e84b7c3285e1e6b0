"""What changed between full snapshots.

``SnapshotIndex`` keeps a key-to-hash index of the last snapshot of each group, bucketed by key:
group, key, 64-bit hash of the value. The rows of the next snapshot probe it; the old value is
fetched only for keys whose hash differs, and then the new rows become the index and the old one
goes. A delivery may hold many snapshots of many groups: each is the index of the one after it, in
tables that are bucketed alike, so the probes shuffle nothing. ``snapshot_changes`` is the same by plain joins.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oxbow.session import ensure_checkpoint_dir, parallelism
from oxbow.sources import storage


def normalised(c: Column) -> Column:
    """Lower case, blanks trimmed and collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def snapshot_changes(df: DataFrame, group: str, snapshot: str, key: str, order: str, value: str) -> DataFrame:
    """Changes between each snapshot of a group and the next one present, without a kept index.

    Result: group, snapshot (the later one), key, change_kind 'added' | 'removed' | 'changed'.
    Of several rows of one key in a snapshot the one with the largest ``order`` counts. Rows
    with a null group, snapshot or key are left out (a snapshot of null keys alone is still
    present). Values are compared in lower case with blanks collapsed; a null value, and a
    value that is the beginning of the other, is no change. The first snapshot gives no rows.
    """
    ensure_checkpoint_dir(df.sparkSession)
    base = df.select(F.col(group).alias("g"), F.col(snapshot).alias("t"), F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).alias("v")).filter(
        F.col("g").isNotNull() & F.col("t").isNotNull()
    )
    w = Window.partitionBy("g").orderBy("t")
    present = base.select("g", "t").distinct().select("g", "t", F.lag("t").over(w).alias("before"), F.lead("t").over(w).alias("after"))
    last = base.filter(F.col("k").isNotNull()).groupBy("g", "t", "k").agg(F.max_by("v", F.struct("o", "v")).alias("v"))
    # Written once to the shared folder: rows with their value, from which the narrow index is read.
    rows = last.join(present, ["g", "t"]).select("g", "t", "k", "before", "after", F.xxhash64(normalised(F.col("v"))).alias("h"), normalised(F.col("v")).alias("v")).checkpoint()
    index = rows.filter(F.col("after").isNotNull()).select("g", F.col("after").alias("t"), "k", F.col("h").alias("old_h"), F.lit(True).alias("was"))
    probe = rows.filter(F.col("before").isNotNull()).select("g", "t", "k", F.col("h").alias("new_h"), F.lit(True).alias("now"))
    differ = (
        index.join(probe, ["g", "t", "k"], "full_outer")
        .filter(F.col("was").isNull() | F.col("now").isNull() | (F.col("old_h") != F.col("new_h")))
        .select("g", "t", "k", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("kind"))
    )
    changed = differ.filter(F.col("kind") == "changed")
    old = rows.select("g", F.col("after").alias("t"), "k", F.col("v").alias("old_v"))
    new = rows.select("g", "t", "k", F.col("v").alias("new_v"))
    real = (
        changed.join(old, ["g", "t", "k"])
        .join(new, ["g", "t", "k"])
        .filter(F.col("old_v").isNotNull() & F.col("new_v").isNotNull() & ~F.startswith("old_v", "new_v") & ~F.startswith("new_v", "old_v"))
        .select("g", "t", "k", "kind")
    )
    return (
        differ.filter(F.col("kind") != "changed")
        .unionByName(real)
        .select(F.col("g").alias(group), F.col("t").alias(snapshot), F.col("k").alias(key), F.col("kind").alias("change_kind"))
    )


class SnapshotIndex:
    """The changes of snapshots as they are delivered, against a bucketed index of the last one of each group.

    The index lives in the folder ``path``, a folder a generation; a small file says which one holds, so
    another session goes on where this one was. Buckets and their number are fixed with the first delivery.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        ensure_checkpoint_dir(spark)
        text = storage.read_text(spark, f"{path}/current.json")
        self.state = json.loads(text) if text else {"generation": -1, "buckets": buckets or parallelism(spark), "schema": None}

    def _name(self, part: str, generation: int) -> str:
        return f"ox_snapshots_{hashlib.md5(self.path.encode()).hexdigest()[:12]}_{part}_{generation}"

    def _folder(self, generation: int) -> str:
        return f"{self.path}/g{generation}"

    def _write(self, df: DataFrame, part: str, generation: int, by: list[str]) -> DataFrame:
        """A bucketed table in the folder of the generation; what a broken run left there is overwritten."""
        name = self._name(part, generation)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        n = self.state["buckets"]
        df.repartition(n, *by).write.mode("overwrite").format("parquet").option("path", f"{self._folder(generation)}/{part}").bucketBy(n, *by).sortBy(*by).saveAsTable(name)
        return self.spark.table(name)

    def _last(self) -> tuple[DataFrame, DataFrame] | None:
        """The index (g, k, h, v) and the snapshots (g, t) it is of."""
        g = self.state["generation"]
        if g < 0:
            return None
        name = self._name("last", g)
        if not self.spark.catalog.tableExists(name):  # another session wrote it
            self.spark.sql(
                f"CREATE TABLE {name} ({self.state['schema']}) USING parquet CLUSTERED BY (g, k) SORTED BY (g, k) INTO {self.state['buckets']} BUCKETS LOCATION '{self._folder(g)}/last'"
            )
        return self.spark.table(name), self.spark.read.parquet(f"{self._folder(g)}/seen")

    def apply(self, delivery: DataFrame, group: str, snapshot: str, key: str, order: str, value: str) -> DataFrame:
        """group, snapshot, key, change_kind of the delivery's snapshots; then the indexes are swapped.

        As ``snapshot_changes``, whose edge cases hold, but the first snapshot of a group is compared with the last one
        known, if there is one; snapshots at or before that are left out. The result is written before the old index goes.
        """
        nxt, last = self.state["generation"] + 1, self._last()
        base = delivery.select(F.col(group).alias("g"), F.col(snapshot).alias("t"), F.col(key).alias("k"), F.col(order).alias("o"), F.col(value).alias("v")).filter(
            F.col("g").isNotNull() & F.col("t").isNotNull()
        )
        snaps = base.select("g", "t").distinct()
        if last is not None:
            known = last[1].select("g", F.col("t").alias("t_known"))
            base = base.join(known, "g", "left").filter(F.col("t_known").isNull() | (F.col("t") > F.col("t_known"))).drop("t_known")
            snaps = snaps.join(known, "g", "left").filter(F.col("t_known").isNull() | (F.col("t") > F.col("t_known"))).select("g", "t", F.lit(False).alias("old")).unionByName(last[1].select("g", "t", F.lit(True).alias("old")))
        else:
            snaps = snaps.withColumn("old", F.lit(False))
        w = Window.partitionBy("g").orderBy("t")
        present = snaps.select("g", "t", "old", F.lag("t").over(w).alias("before"), F.lead("t").over(w).alias("after"), F.coalesce(F.lag("old").over(w), F.lit(False)).alias("old_before")).checkpoint()
        text = normalised(F.col("v"))
        fresh = (
            base.filter(F.col("k").isNotNull()).join(present.drop("old"), ["g", "t"]).repartition(self.state["buckets"], "g", "k", "t")
            .groupBy("g", "k", "t").agg(F.max_by("v", F.struct("o", "v")).alias("v"), *[F.first(c).alias(c) for c in ("before", "after", "old_before")])
            .select("g", "k", "t", "before", "after", "old_before", F.xxhash64(text).alias("h"), text.alias("v"))
        )
        on = ["g", "k", "t"]
        rows = self._write(fresh, "rows", nxt, on)
        index = self._write(rows.filter(F.col("after").isNotNull()).select("g", "k", F.col("after").alias("t"), F.col("h").alias("old_h")), "index", nxt, on)
        parts = [self._changes(index, rows.filter(F.col("before").isNotNull() & ~F.col("old_before")), rows.select("g", "k", F.col("after").alias("t"), F.col("v").alias("old_v")), rows, on)]
        kept = rows.filter(F.col("after").isNull()).select("g", "k", "h", "v")
        if last is not None:
            old = present.filter("old")
            followed = old.filter(F.col("after").isNotNull()).select("g", F.col("after").alias("t"))
            here = last[0].join(followed, "g")
            first = rows.filter("old_before")
            parts.append(self._changes(here.select("g", "k", "t", F.col("h").alias("old_h")), first, here.select("g", "k", "t", F.col("v").alias("old_v")), first, ["g", "k"]))
            kept = kept.unionByName(last[0].join(followed, "g", "left_anti").select("g", "k", "h", "v"))
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        done = out.select(F.col("g").alias(group), F.col("t").alias(snapshot), F.col("k").alias(key), F.col("kind").alias("change_kind")).checkpoint()
        stored = self._write(kept, "last", nxt, ["g", "k"])
        present.filter(F.col("after").isNull()).select("g", "t").write.mode("overwrite").parquet(f"{self._folder(nxt)}/seen")
        state = {**self.state, "generation": nxt, "schema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)}
        storage.write_text(self.spark, f"{self.path}/current.json", json.dumps(state))
        for part in ("rows", "index"):
            self._remove(part, nxt)
        if nxt:
            self._remove("last", nxt - 1)
            storage.delete(self.spark, self._folder(nxt - 1))
        self.state = state
        return done

    @staticmethod
    def _changes(index: DataFrame, probe: DataFrame, old_values: DataFrame, new_values: DataFrame, on: list[str]) -> DataFrame:
        """g, k, t, kind: the index (old_h) probed with new rows (h), values fetched for keys whose hash differs."""
        a = index.withColumn("was", F.lit(True))
        b = probe.select("g", "k", *([F.col("t").alias("t_new")] if "t" not in on else ["t"]), "h").withColumn("now", F.lit(True))
        met = a.join(b, on, "full_outer")
        if "t" not in on:
            met = met.withColumn("t", F.coalesce("t", "t_new")).drop("t_new")
        differ = met.filter(F.col("was").isNull() | F.col("now").isNull() | (F.col("old_h") != F.col("h"))).select(
            "g", "k", "t", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("kind")
        )
        real = (
            differ.filter(F.col("kind") == "changed").join(old_values, ["g", "k", "t"]).join(new_values.select("g", "k", "t", F.col("v").alias("new_v")), ["g", "k", "t"])
            .filter(F.col("old_v").isNotNull() & F.col("new_v").isNotNull() & ~F.startswith("old_v", "new_v") & ~F.startswith("new_v", "old_v"))
            .select("g", "k", "t", "kind")
        )
        return differ.filter(F.col("kind") != "changed").unionByName(real)

    def _remove(self, part: str, generation: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(part, generation)}")
        storage.delete(self.spark, f"{self._folder(generation)}/{part}")

    def drop(self) -> None:
        """The index with its folder."""
        self._remove("last", self.state["generation"])
        storage.delete(self.spark, self.path)
