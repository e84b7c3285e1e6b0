"""Implausible readings of many sources: spikes, stuck values, impossible values.

Each source's readings, in the order of their snapshots, are the output of a hidden Markov
model. Its states are normal (values near the local level, with the source's own robust
spread and its own share of repetitions), spike (values anywhere but near the level; a chain as long as a
spike may last), shift (values anywhere or near those just before or after, for longer than that: a lasting change), stuck (exact
repetitions), idle (exact zeros of a source that lives near zero) and out of range (values
outside the hard bounds, and nothing else). Forward-backward gives the states'
probabilities for each reading, and they decide; around them stand only the limits that a
task itself sets: the least size of a spike, the least length of a stuck run, and that the
source hardly ever repeats otherwise.

Series are run many at a time as padded arrays. Equal readings of a snapshot are collapsed
before the shuffle. A series is cut into blocks of snapshots that overlap, so no source is ever
one task's whole load; what is usual for a source is counted in all its blocks and added up
before any of them is judged, so verdicts don't depend on where it was cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oxbow.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Reading:
    """One measured field: ``value``, its hard bounds (None: none), the least size of a spike and the least spread.

    ``source`` are the columns that tell its sources apart; a reading with a null among them
    has no source and is only held against the bounds.
    """

    field: str
    value: Column
    low: Column | None
    high: Column | None
    least: float
    resolution: float
    usual: float  # the spread a source of few readings is taken to have, as a share of its level
    source: tuple[Column, ...]


@dataclass(frozen=True)
class Model:
    """Parameters of the model; lengths are in snapshots."""

    # chances of leaving the normal state, and of starting in a shift or idle
    p_spike: float = 0.001
    p_shift: float = 0.00003
    p_stuck: float = 1e-5
    p_idle: float = 0.002
    p_out: float = 0.001
    first_shift: float = 0.02
    first_idle: float = 0.05
    # chances of staying, and of a value that a spike or a shift repeats
    stay_spike: float = 0.4
    stay_shift: float = 0.9
    stay_stuck: float = 0.95
    repeated: float = 0.3
    widen: float = 2.0  # emission spread of normal readings against the robust spread: lets the level drift
    half_window: int = 7
    min_side: int = 4  # readings before or after one that tell the level on that side
    usual_weight: float = 10.0  # readings that the usual spread counts as
    # the limits of the task
    max_spike: int = 3
    min_stuck: int = 10
    max_repeat: float = 0.2  # of a source's other neighbours, the share that may be equal if a run is to be stuck
    min_others: int = 8
    block: int = 2048
    margin: int = 64


#: Bins a factor of two of the histograms from which medians are read.
FINE = 32
#: Histograms and counters of a source; a key is the kind times STRIDE plus the bin.
STRIDE = 1 << 20
RESIDUALS, RESIDUALS_SHORT, VALUES, VALUES_SHORT, COUNTS = range(5)
REPEATS, REPEATS_SHORT = 0, 1

STATS = ["rate", "may_stick", "spread", "span", "idle"]


def _bins(x: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Signed logarithmic bins; 0 is what lies below a sixteenth of the unit."""
    y = np.abs(x) * 16 / unit
    return (np.sign(x) * np.where(y < 1, 0, 1 + np.floor(FINE * np.log2(np.maximum(y, 1))))).astype(np.int64)


def _of_bin(b: np.ndarray, unit: float) -> np.ndarray:
    return np.where(b == 0, 0.0, np.sign(b) * unit / 16 * 2 ** ((np.abs(b) - 0.5) / FINE))


def _window_median(v: np.ndarray, first: int, last: int, least: int) -> np.ndarray:
    """Median of the neighbours from ``first`` to ``last`` places away; NaN doesn't count, and fewer than ``least`` give NaN."""
    k, t = max(abs(first), abs(last)), v.shape[1]
    pad = np.pad(v, ((0, 0), (k, k)), constant_values=np.nan)
    w = np.sort(np.lib.stride_tricks.sliding_window_view(pad, last - first + 1, axis=1)[:, k + first : k + first + t], axis=2)
    n = np.isfinite(w).sum(axis=2)
    at = lambda i: np.take_along_axis(w, np.clip(i, 0, w.shape[2] - 1)[..., None], axis=2)[..., 0]
    return np.where(n >= least, (at((n - 1) // 2) + at(n // 2)) / 2, np.nan)


@dataclass
class Padded:
    """Series as rows of equal length: values (NaN where none or out of range), and what runs they are in."""

    seen: np.ndarray  # there is a reading
    out: np.ndarray  # it is out of range
    value: np.ndarray
    same: np.ndarray  # it repeats the one of the snapshot before
    before: np.ndarray  # the next one repeats it
    run: np.ndarray  # number of its run
    length: np.ndarray  # readings in its run; 0 outside of runs
    level: np.ndarray


def _padded(v: np.ndarray, snap: np.ndarray, out: np.ndarray, n: np.ndarray, m: Model) -> Padded:
    """Each snapshot's first reading in range stands for it in runs; others of the same snapshot are only looked at."""
    rows, t = v.shape
    seen = np.arange(t)[None, :] < n[:, None]
    out = out & seen
    good = seen & ~out
    value = np.where(good, v, np.nan)
    lead = good.copy()
    last = np.maximum.accumulate(np.where(good, np.arange(t)[None, :], -1), axis=1)
    prior = np.concatenate([np.full((rows, 1), -1), last[:, :-1]], axis=1)
    lead &= (prior < 0) | (np.take_along_axis(snap, np.maximum(prior, 0), axis=1) != snap)
    last = np.maximum.accumulate(np.where(lead, np.arange(t)[None, :], -1), axis=1)
    prior = np.concatenate([np.full((rows, 1), -1), last[:, :-1]], axis=1)
    same = lead & (prior >= 0) & (np.take_along_axis(value, np.maximum(prior, 0), axis=1) == value)
    before = np.zeros((rows, t), bool)
    r, c = np.nonzero(same)
    before[r, prior[r, c]] = True
    run = np.maximum(np.cumsum(lead & ~same, axis=1) - 1, 0) + np.arange(rows)[:, None] * t
    length = np.where(lead, np.bincount(run[lead], minlength=rows * t)[run], 0)
    return Padded(seen, out, value, same, before, run, length, _window_median(value, -m.half_window, m.half_window, 1))


def _summary(p: Padded, own: np.ndarray, unit: np.ndarray, m: Model) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row: keys and counts of its own readings, to be added up by source."""
    rows, t = own.shape
    good = own & p.seen & ~p.out
    short = good & (p.length < m.min_stuck)
    u = np.broadcast_to(unit[:, None], good.shape)
    residual, value = _bins(np.nan_to_num(np.abs(p.value - p.level)), u), _bins(np.nan_to_num(p.value), u)
    made = [(RESIDUALS, good, residual), (RESIDUALS_SHORT, short, residual), (VALUES, good, value), (VALUES_SHORT, short, value)]
    parts = [(np.nonzero(mask)[0], kind * STRIDE + b[mask]) for kind, mask, b in made]
    parts += [(np.nonzero(mask)[0], np.full(int(mask.sum()), COUNTS * STRIDE + which)) for which, mask in ((REPEATS, good & p.same), (REPEATS_SHORT, short & p.same))]
    row, key = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    both, count = np.unique(np.stack([row, key]), axis=1, return_counts=True)
    edges = np.searchsorted(both[0], np.arange(rows + 1))
    return [(both[1, a:b], count[a:b]) for a, b in zip(edges, edges[1:])]


def _median(bins: np.ndarray, counts: np.ndarray, unit: float) -> float:
    if not len(bins):
        return 0.0
    o = np.argsort(bins)
    c = np.cumsum(counts[o])
    low, high = np.searchsorted(c, (c[-1] + 1) // 2), np.searchsorted(c, c[-1] // 2 + 1)
    return float((_of_bin(bins[o][low], unit) + _of_bin(bins[o][high], unit)) / 2)


def _usual(keys: np.ndarray, counts: np.ndarray, least: float, unit: float, usual: float, m: Model) -> tuple:
    """What is usual for a source, in the order of STATS."""
    kind = (keys + STRIDE // 2) // STRIDE
    at = lambda k: (keys[kind == k] - k * STRIDE, counts[kind == k])
    n, others = int(at(VALUES)[1].sum()), int(at(VALUES_SHORT)[1].sum())
    repeats = dict(zip(*(x.tolist() for x in at(COUNTS))))
    rate = repeats.get(REPEATS_SHORT, 0) / max(others, 1)
    may = others >= m.min_others and rate <= m.max_repeat
    spread = 1.4826 * _median(*at(RESIDUALS_SHORT if may else RESIDUALS), unit)
    centre = abs(_median(*at(VALUES_SHORT if may else VALUES), unit))
    spread = max(unit, ((n * spread**2 + m.usual_weight * (usual * centre) ** 2) / (n + m.usual_weight)) ** 0.5)
    values = _of_bin(at(VALUES)[0], unit)
    span = max(float(values.max() - values.min()) if len(values) else 0.0, 10 * spread)
    return (rate if may else repeats.get(REPEATS, 0) / max(n, 1)), may, spread, span, _median(*at(VALUES_SHORT), unit) < least


def _forward_backward(b: np.ndarray, first: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Probabilities of the states: emissions b (series, time, state), first states (series, state), transitions a (series, from, to)."""
    n, t, s = b.shape
    forward, back = np.empty_like(b), np.ones_like(b)
    x = first * b[:, 0]
    forward[:, 0] = x = x / x.sum(axis=1, keepdims=True)
    for i in range(1, t):
        x = np.matmul(x[:, None, :], a)[:, 0, :] * b[:, i]
        forward[:, i] = x = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300)
    x = np.ones((n, s))
    for i in range(t - 2, -1, -1):
        x = np.matmul(a, (x * b[:, i + 1])[:, :, None])[:, :, 0]
        back[:, i] = x = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300)
    p = forward * back
    return p / np.maximum(p.sum(axis=2, keepdims=True), 1e-300)


def state_probabilities(p: Padded, stats: dict[str, np.ndarray], m: Model) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of each reading the chance of the states spike, stuck and out, and its distance from the level."""
    off = np.nan_to_num(p.value - p.level)
    sides = np.stack([np.abs(p.value - _window_median(p.value, a, b, m.min_side)) for a, b in ((-m.half_window, -1), (1, m.half_window))])
    aside = np.where(np.isfinite(sides), sides, np.inf).min(axis=0)
    sd = m.widen * stats["spread"][:, None]
    near = -0.5 * (off / sd) ** 2
    bell = near - np.log(sd * np.sqrt(2 * np.pi))
    anywhere = np.broadcast_to(-np.log(stats["span"])[:, None], bell.shape)
    rate = np.clip(stats["rate"], 0.02, 0.98)[:, None]
    normal = np.where(p.same, np.log(rate) + near, np.log(1 - rate) + bell)
    apart = np.log1p(-0.999 * np.exp(near))
    away = np.where(p.same, np.log(m.repeated), np.log(1 - m.repeated) + anywhere) + apart
    moved = np.where(p.same, away, np.maximum(away, np.log(1 - m.repeated) + bell - near - 0.5 * (aside / sd) ** 2 + apart))
    held = np.where(p.same, 0.0, np.where(p.before, np.maximum(bell, anywhere), np.log(1e-6) + anywhere))
    idle = np.where((p.value == 0) & (stats["idle"][:, None]), held, -60.0)

    spikes, shifts = m.max_spike, m.max_spike + 1
    at_shift, stuck, idling, outside = 1 + spikes, 1 + spikes + shifts, 2 + spikes + shifts, 3 + spikes + shifts
    b = np.stack([normal, *[away] * spikes, *[moved] * shifts, held, idle, np.full_like(normal, -700.0)], axis=2)
    only = np.full(b.shape[2], -700.0)
    only[outside] = 0.0
    b = np.where(p.out[..., None], only, b)
    b = np.exp(np.where(p.seen[..., None], b - b.max(axis=2, keepdims=True), 0.0))

    rows = b.shape[0]
    may = stats["may_stick"].astype(bool)
    st = np.where(may, m.p_stuck, 1e-30)
    again = np.where(may, 0.2, 1e-30)  # a stuck value goes on behind a reading that was none of it
    a = np.zeros((rows, b.shape[2], b.shape[2]))
    a[:, 0, 1], a[:, 0, at_shift], a[:, 0, stuck], a[:, 0, idling] = m.p_spike, m.p_shift, st, m.p_idle
    for i in range(1, 1 + spikes):
        a[:, i, stuck], a[:, i, idling] = again / 10, 0.01
        if i < spikes:
            a[:, i, i + 1] = m.stay_spike
    for i in range(at_shift, stuck - 1):
        a[:, i, i + 1] = 1.0
    a[:, stuck - 1, stuck - 1], a[:, stuck - 1, 1] = m.stay_shift, m.p_spike
    for i in (stuck, idling):
        a[:, i, i], a[:, i, 1] = m.stay_stuck, m.p_spike
    a[:, idling, stuck] = st
    a[:, outside, stuck], a[:, outside, idling], a[:, outside, 1], a[:, outside, stuck - 1] = again, 0.01, m.p_spike, 0.01
    a[:, :, outside] += m.p_out
    free = [0, *range(1, 1 + spikes), stuck - 1, stuck, idling, outside]  # the first of a shift go on in it
    a[:, free, 0] = np.maximum(1 - a[:, free, 1:].sum(axis=2), 1e-6)
    a /= a.sum(axis=2, keepdims=True)
    first = np.full((rows, b.shape[2]), 1e-12)
    first[:, 0], first[:, 1:at_shift], first[:, at_shift:stuck] = 1.0, m.p_spike / spikes, m.first_shift / shifts
    first[:, stuck], first[:, idling], first[:, outside] = st, m.first_idle, m.p_out
    g = _forward_backward(b, first / first.sum(axis=1, keepdims=True), a)
    return {"spike": g[..., 1:at_shift].sum(axis=2), "stuck": g[..., stuck], "out": g[..., outside]}, off


def flags(p: Padded, stats: dict[str, np.ndarray], least: np.ndarray, m: Model, chances=state_probabilities) -> tuple[np.ndarray, np.ndarray]:
    """Spike and stuck flags of padded series: the state is likelier than not, within the limits of the task.

    All readings of a stuck run count: what is asked is the mean chance of its repetitions.
    """
    g, off = chances(p, stats, m)
    good = p.seen & ~p.out
    w = (p.same & good).astype(float)
    in_run = lambda x: np.bincount(p.run.ravel(), x.ravel(), minlength=p.run.size)
    chance = (in_run(w * g["stuck"]) / np.maximum(in_run(w), 1))[p.run]
    stuck = good & (chance >= 0.5) & (p.length >= m.min_stuck) & stats["may_stick"].astype(bool)[:, None]
    spike = good & (g["spike"] >= 0.5) & (np.abs(off) >= least[:, None]) & ~stuck
    return spike, stuck


def _batches(n: np.ndarray) -> Iterator[np.ndarray]:
    """Series of like length together, within a bound of padded cells."""
    order, i = np.argsort(n, kind="stable"), 0
    while i < len(order):
        longest = int(n[order[min(len(order) - 1, i + 511)]])
        some = order[i : i + max(1, min(512, 500_000 // max(longest, 1)))]
        i += len(some)
        yield some


def _pad(series: list[np.ndarray], n: np.ndarray, kind) -> np.ndarray:
    made = np.zeros((len(series), max(1, int(n.max()))), kind)
    for i, x in enumerate(series):
        made[i, : len(x)] = x
    return made


BLOCKS = "field string, source string, block long, snapshots array<long>, vals array<double>, outs array<boolean>, keys array<long>, counts array<long>"


def _pack(fields: dict[str, tuple[float, float, float]], m: Model):
    """Sorted readings to one row a block, with the counts of its own snapshots."""
    key = ["field", "source", "block"]

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        new = np.r_[True, (pdf[key].iloc[1:].to_numpy() != pdf[key].iloc[:-1].to_numpy()).any(axis=1)]
        start = np.flatnonzero(new)
        n = np.diff(np.r_[start, len(pdf)])
        v, snap, out = pdf["value"].to_numpy(float), pdf["snapshot"].to_numpy(np.int64), pdf["out"].to_numpy(bool)
        head = pdf.iloc[start][key].reset_index(drop=True)
        unit = np.array([fields[f][1] for f in head["field"]])
        block = head["block"].to_numpy(np.int64)
        cut = lambda x, some: [x[start[i] : start[i] + n[i]] for i in some]
        counted: list = [None] * len(start)
        for some in _batches(n):
            s = _pad(cut(snap, some), n[some], np.int64)
            p = _padded(_pad(cut(v, some), n[some], float), s, _pad(cut(out, some), n[some], bool), n[some], m)
            for i, x in zip(some, _summary(p, s // m.block == block[some][:, None], unit[some], m)):
                counted[i] = x
        every = range(len(start))
        return head.assign(snapshots=cut(snap, every), vals=cut(v, every), outs=cut(out, every), keys=[x for x, _ in counted], counts=[x for _, x in counted])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for pdf in parts:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = (pdf[key] == pdf[key].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.argmax(last)) if last.any() else len(pdf)
            rest = pdf.iloc[cut:].reset_index(drop=True)
            if cut:
                yield made(pdf.iloc[:cut].reset_index(drop=True))
        if rest is not None and len(rest):
            yield made(rest)

    return run


def _usual_pass(fields: dict[str, tuple[float, float, float]], m: Model):
    """Summed counts in the order of their source to what is usual for it; a source has a bounded number of bins."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def made(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for (f, s), g in pdf.groupby(["field", "source"], sort=False):
                rows.append((f, s, *_usual(g["key"].to_numpy(np.int64), g["n"].to_numpy(np.int64), *fields[f], m)))
            return pd.DataFrame(rows, columns=["field", "source", *STATS])

        for pdf in parts:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = ((pdf["field"] == pdf["field"].iloc[-1]) & (pdf["source"] == pdf["source"].iloc[-1])).to_numpy()
            cut = int(np.argmax(last))
            rest = pdf.iloc[cut:].reset_index(drop=True)
            if cut:
                yield made(pdf.iloc[:cut])
        if rest is not None and len(rest):
            yield made(rest)

    return run


def _judge(fields: dict[str, tuple[float, float, float]], m: Model):
    """Blocks with what is usual for their source to the flagged readings of their own snapshots."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf.reset_index(drop=True)
            n = pdf["vals"].map(len).to_numpy()
            for some in _batches(n):
                part = pdf.iloc[some]
                k = n[some]
                snap = _pad(part["snapshots"].tolist(), k, np.int64)
                p = _padded(_pad(part["vals"].tolist(), k, float), snap, _pad(part["outs"].tolist(), k, bool), k, m)
                stats = {s: part[s].to_numpy() for s in STATS}
                spike, stuck = flags(p, stats, np.array([fields[f][0] for f in part["field"]]), m)
                own = snap // m.block == part["block"].to_numpy(np.int64)[:, None]
                r, c = np.nonzero((spike | stuck) & own)
                if len(r):
                    yield pd.DataFrame({
                        "field": part["field"].to_numpy()[r], "source": part["source"].to_numpy()[r], "snapshot": snap[r, c], "value": p.value[r, c],
                        "kind": np.where(stuck[r, c], "stuck", "spike"),
                    })

    return run


def implausible_readings(df: DataFrame, key: str, snapshot: str, readings: list[Reading], model: Model = Model()) -> DataFrame:
    """One row (key, field, kind) for each implausible reading; kind: 'impossible' | 'stuck' | 'spike'.

    Null readings are none; a reading with a null source part is only held against its bounds
    and one with null bounds not against them. All rows that carry a flagged value of a
    snapshot come out, repeated rows too. Rows with a null snapshot are only held against the
    bounds. Of several values of one snapshot the one that most rows carry stands for it in runs. An empty input gives an
    empty result.
    """
    ensure_checkpoint_dir(df.sparkSession)
    fields = {r.field: (float(r.least), float(r.resolution), float(r.usual)) for r in readings}

    def one(r: Reading) -> Column:
        value = r.value.cast("double")
        out = F.lit(False)
        for bound, wrong in ((r.low, lambda b: value < b), (r.high, lambda b: value > b)):
            if bound is not None:
                out = out | F.coalesce(wrong(bound.cast("double")), F.lit(False))
        unknown = F.greatest(*[c.isNull() for c in r.source], F.lit(False))
        return F.struct(F.lit(r.field).alias("field"), value.alias("value"), out.alias("out"), F.when(~unknown, F.concat_ws("/", *[c.cast("string") for c in r.source])).alias("source"))

    each = F.explode(F.array(*[one(r) for r in readings]))
    long = df.select(F.col(key).alias("key"), F.col(snapshot).cast("long").alias("snapshot"), each.alias("r")).select("key", "snapshot", "r.*").filter(F.col("value").isNotNull())
    bad = long.filter("out").select("key", "field", F.lit("impossible").alias("kind"))
    placed = long.filter(F.col("source").isNotNull() & F.col("snapshot").isNotNull())
    distinct = placed.groupBy("field", "source", "snapshot", "value").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("n"), F.max("out").alias("out"))
    b = F.floor(F.col("snapshot") / model.block)
    offset = F.pmod("snapshot", F.lit(model.block))
    blocks = F.array_compact(F.array(b, F.when(offset < model.margin, b - 1), F.when(offset >= model.block - model.margin, b + 1)))
    by = ["field", "source", "block"]
    series = (
        distinct.withColumn("block", F.explode(blocks)).repartition(*by).sortWithinPartitions(*by, "snapshot", F.desc("n"), "first_key").select(*by, "snapshot", "value", "out")
    )
    packed = series.mapInPandas(_pack(fields, model), BLOCKS).checkpoint()
    counts = packed.select("field", "source", F.explode(F.arrays_zip("keys", "counts")).alias("x")).groupBy("field", "source", F.col("x.keys").alias("key")).agg(F.sum("x.counts").alias("n"))
    usual = counts.repartition("field", "source").sortWithinPartitions("field", "source").mapInPandas(
        _usual_pass(fields, model), "field string, source string, rate double, may_stick boolean, spread double, span double, idle boolean"
    )
    judged = packed.drop("keys", "counts").join(usual, ["field", "source"])
    found = judged.mapInPandas(_judge(fields, model), "field string, source string, snapshot long, value double, kind string")
    rows = placed.filter(~F.col("out")).select("key", "field", "source", "snapshot", "value").join(found, ["field", "source", "snapshot", "value"]).select("key", "field", "kind")
    return bad.unionByName(rows).withColumnRenamed("key", key)
