"""Filling containers of fixed capacity with items, none split unless it is longer than a container.

What is planned is the histogram of sizes, at most ``capacity`` numbers however many items
there are. Planning opens a container with the largest size left, and fills its gap by
exact-complement lookup: one size, a pair or a triple of sizes that fill it to the last
unit, found in an index of the length sums still available (``Sums``); if there is none, the largest
size that fits goes in (best fit) and the smaller gap is looked up again. A pattern is used
as often as its sizes are available. Items then take the places of their size by their rank
in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.llm.tokenizer import DEFAULT_RANKS, encode
from oxbow.operators.ranks import sliced_row_number
from oxbow.session import ensure_checkpoint_dir, table

CAPACITY = 2048


@dataclass(frozen=True)
class Pattern:
    """Sizes with their number in one container, and how many containers are filled so."""

    sizes: tuple[tuple[int, int], ...]
    times: int


class Sums:
    """The sizes still available, and an index of the sums that two of them make.

    ``pairs[g]`` is the number of pairs of sizes with the sum g. It follows the sizes that run out; a size that is only
    held for the container being filled is still counted in it, so what the index offers is looked at once more.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.have = np.zeros(capacity + 1, np.int64)
        for s, n in counts.items():
            self.have[s] = n
        there = (self.have > 0).astype(float)
        n = 1 << (2 * capacity + 1).bit_length()
        both = np.rint(np.fft.irfft(np.fft.rfft(there, n) ** 2, n)[: capacity + 1]).astype(np.int64)
        halves = np.arange(capacity // 2 + 1)
        both[2 * halves] -= self.have[halves] > 0
        self.pairs = both // 2
        self.pairs[2 * halves] += self.have[halves] > 1
        self.sizes = np.flatnonzero(self.have)

    def use(self, used: dict[int, int], times: int) -> None:
        """Take the sizes for good, and those that run out from the index."""
        top = len(self.have) - 1
        for s, k in used.items():
            was = self.have[s]
            self.have[s] -= k * times
            if 2 * s <= top and was > 1 >= self.have[s]:
                self.pairs[2 * s] -= 1
            if self.have[s] == 0:
                self.sizes = self.sizes[self.sizes != s]
                at = self.sizes + s
                self.pairs[at[at <= top]] -= 1

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.have[gap] > 0 else None

    def pair(self, gap: int) -> list[int] | None:
        """Two sizes that make up the gap, the larger as large as may be."""
        if self.pairs[gap] == 0:
            return None
        large = self.sizes[np.searchsorted(self.sizes, (gap + 1) // 2) : np.searchsorted(self.sizes, gap)]
        ok = (self.have[large] > 0) & (self.have[gap - large] > (large * 2 == gap))
        at = np.flatnonzero(ok)
        return [int(large[at[-1]]), gap - int(large[at[-1]])] if len(at) else None

    def triple(self, gap: int) -> list[int] | None:
        """Three sizes that make up the gap: one whose rest two others make."""
        large = self.sizes[np.searchsorted(self.sizes, (gap + 2) // 3) : np.searchsorted(self.sizes, gap - 1)]
        for c in large[(self.have[large] > 0) & (self.pairs[gap - large] > 0)][::-1].tolist():
            self.have[c] -= 1
            p = self.pair(gap - c)
            self.have[c] += 1
            if p:
                return [c, *p]
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that take every item of the histogram once; sizes are within 1..capacity."""
    sums = Sums(counts, capacity)
    have = sums.have
    out: list[Pattern] = []
    while sums.sizes.size:
        used: dict[int, int] = {}

        def take(s: int) -> None:
            used[s] = used.get(s, 0) + 1
            have[s] -= 1

        take(int(sums.sizes[-1]))
        gap = capacity - int(sums.sizes[-1])
        while gap:
            left = sums.sizes[: np.searchsorted(sums.sizes, gap, side="right")]
            i = len(left) - 1
            while i >= 0 and have[left[i]] == 0:  # held for this container
                i -= 1
            if i < 0:
                break
            most = int(left[i])
            fill = None
            if gap <= 3 * most:
                fill = sums.single(gap) or sums.pair(gap) or sums.triple(gap)
            for s in fill or [most]:
                take(s)
                gap -= s
        for s, k in used.items():
            have[s] += k
        times = min(int(have[s]) // k for s, k in used.items())
        sums.use(used, times)
        out.append(Pattern(tuple(sorted(used.items(), reverse=True)), times))
    return out


#: Bits of the rank in a size; the number of a size stands above them.
RANK_BITS = 44


def _places(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sizes, and by (number of the size, first rank): the number of the size in a container, and the first container."""
    sizes = sorted({s for p in patterns for s, _ in p.sizes})
    if len(sizes) >= 1 << (63 - RANK_BITS):
        raise ValueError("too many different sizes")
    code = {s: i for i, s in enumerate(sizes)}
    taken: dict[int, int] = {}
    rows, base = [], 0
    for p in patterns:
        for s, k in p.sizes:
            rows.append((code[s] << RANK_BITS | taken.get(s, 0), k, base))
            taken[s] = taken.get(s, 0) + k * p.times
        base += p.times
    rows.sort()
    a = np.array(rows or [(0, 1, 0)], np.int64)
    return np.array(sizes, np.int64), a[:, 0], a[:, 1], a[:, 2]


def _assign(places):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, start, per, base = places.value
        for b in batches:
            key = (np.searchsorted(sizes, b["size"].to_numpy(np.int64)) << RANK_BITS) + b["rank"].to_numpy(np.int64) - 1
            i = np.searchsorted(start, key, side="right") - 1
            yield b.assign(container=base[i] + (key - start[i]) // per[i])[["key", "piece", "from_unit", "size", "container"]]

    return run


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, slice_expr: Column | None = None) -> DataFrame:
    """Container of every item: key, piece, from_unit, size, container.

    ``size`` in whole units; null and non-positive sizes are no items. An item above the capacity is
    cut into full containers and a rest (pieces 0, 1, ...; from_unit is the offset in it), any
    other is one piece. Repeated rows are items of their own. ``slice_expr`` (default: key / 65536)
    cuts a size's items for ranking and must not fall as the key rises. Nothing but the
    histogram, at most ``capacity`` rows, goes to the driver. An empty input gives an empty result.
    """
    spark = items.sparkSession
    ensure_checkpoint_dir(spark)
    src = items.select(F.col(key).alias("key"), F.col(size).cast("long").alias("n")).filter(F.col("n") > 0).checkpoint()
    pieces = src.select("key", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / capacity).cast("long") - 1)).alias("piece")).select(
        "key", "piece", (F.col("piece") * capacity).alias("from_unit"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("size")
    )
    counts = {int(r["size"]): int(r["count"]) for r in pieces.groupBy("size").count().collect()}
    places = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    cut = slice_expr if slice_expr is not None else F.floor(F.col("key") / 65536)
    ranked = sliced_row_number(pieces, ["size"], ["key", "piece"], cut, "rank")
    kind = src.schema["key"].dataType.simpleString()
    out = ranked.select("key", "piece", "from_unit", "size", "rank").mapInPandas(_assign(places), f"key {kind}, piece long, from_unit long, size long, container long")
    return out.withColumnRenamed("key", key)


def p9_containers(spark: SparkSession, d: str, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    sizes = encode(table(spark, d, "documents"), "doc_id", "text", ranks_path, counts=True)
    return pack(sizes, "doc_id", "n").select("doc_id", "piece", F.col("from_unit").alias("from_token"), F.col("size").alias("n_tokens"), "container")
