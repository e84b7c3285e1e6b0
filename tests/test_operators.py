"""The general operators against brute force, and their edge cases."""

import datetime
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from oxbow.operators import anomalies
from oxbow.operators.anomalies import Model, Reading, implausible_readings
from oxbow.operators.intervals import interval_periods
from oxbow.operators.ranks import ranged_sums, sliced_row_number
from oxbow.operators.snapshots import SnapshotIndex, snapshot_changes

T0 = datetime.datetime(2014, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_sliced_row_number(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, rng.randrange(500)) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = sliced_row_number(df, ["g"], ["v"], F.floor(F.col("v") / 50), "rn").collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append((r["rn"], r["v"]))
    for g, x in by.items():
        x.sort()
        assert [a for a, _ in x] == list(range(1, len(x) + 1))
        assert [b for _, b in x] == sorted(b for _, b in x)


def test_ranged_sums(spark):
    """Running sums of one hot group and others, with nulls and repeated rows, however the range partitions fall."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), i // 2, rng.choice([None, 1, 5, -2])) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    got = defaultdict(list)
    for r in ranged_sums(df, ["g"], ["o"], {"rn": F.lit(1).cast("long"), "s": F.col("v")}).collect():
        got[r["g"]].append((r["rn"], r["o"], r["v"], r["s"]))
    assert sum(map(len, got.values())) == len(rows)
    for x in got.values():
        total = 0
        for i, (rn, _, v, s) in enumerate(sorted(x)):
            total += v or 0
            assert rn == i + 1 and s == total
        assert [o for _, o, *_ in sorted(x)] == sorted(o for _, o, *_ in x)


def brute_periods(rows):
    out = []
    by = defaultdict(list)
    for g, a, b in rows:
        if g is not None and a is not None and b is not None and b > a:
            by[g].append((a.replace(microsecond=0), b.replace(microsecond=0)))
    for g, iv in by.items():
        iv.sort()
        merged = [list(iv[0])]
        for a, b in iv[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(g, "period", str(a), str(b)) for a, b in merged]
        out += [(g, "gap", str(x[1]), str(y[0])) for x, y in zip(merged, merged[1:])]
    return sorted(out)


def periods(spark, rows, **kw):
    df = spark.createDataFrame(rows, "g string, a timestamp_ntz, b timestamp_ntz")
    return sorted(tuple(r) for r in interval_periods(df, F.col("g"), F.col("a"), F.col("b"), **kw).collect())


def test_periods_random(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        a = rng.randrange(20_000)
        rows.append((rng.choice("xyz"), at(a), at(a + rng.choice([0, 1, 5, 40, 300, -3]))))
    rows += rows[:50]
    assert periods(spark, rows) == brute_periods(rows)
    assert periods(spark, rows, slice_seconds=600) == brute_periods(rows)


def test_periods_edges(spark):
    half = T0 + datetime.timedelta(microseconds=500_000)
    rows = [
        ("n", at(0), at(100)), ("n", at(10), at(20)),  # nested
        ("t", at(0), at(5)), ("t", at(5), at(9)),  # touching
        ("s", at(0), at(5)), ("s", half + datetime.timedelta(minutes=5), at(9)),  # touching within the second
        ("one", at(3), at(4)), ("bad", at(5), at(4)), ("bad", at(5), at(5)), ("bad", None, at(1)), ("bad", at(1), None), (None, at(1), at(2)),
    ]
    assert periods(spark, rows) == brute_periods(rows)
    assert periods(spark, []) == []


def brute_changes(rows):
    last = {}
    for g, t, k, o, v in rows:
        if g is None or t is None:
            continue
        last.setdefault((g, t), {})
        if k is not None and (k not in last[g, t] or o > last[g, t][k][0]):
            last[g, t][k] = (o, v)
    norm = lambda v: None if v is None else " ".join(v.lower().split())
    out = []
    for g in {a for a, _ in last}:
        snaps = sorted(t for a, t in last if a == g)
        for s, t in zip(snaps, snaps[1:]):
            a, b = last[g, s], last[g, t]
            out += [(g, t, k, "removed") for k in a.keys() - b.keys()] + [(g, t, k, "added") for k in b.keys() - a.keys()]
            for k in a.keys() & b.keys():
                x, y = norm(a[k][1]), norm(b[k][1])
                if x is not None and y is not None and not x.startswith(y) and not y.startswith(x):
                    out.append((g, t, k, "changed"))
    return sorted(out)


def changes(spark, rows):
    df = spark.createDataFrame(rows, "trackid long, snapshotid int, pid int, log_id long, cmd string, g string, t string, k string, v string")
    return sorted(tuple(r) for r in snapshot_changes(df, "trackid", "snapshotid", "pid", "log_id", "cmd").collect())


def test_snapshot_changes(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for g in (1, 2):
        for t in rng.sample(range(1, 30), 15):
            for k in [*rng.sample(range(8), rng.randrange(8)), *([None] if rng.random() < 0.3 else []), *([3] if rng.random() < 0.3 else [])]:
                n += 1
                rows.append((g, t, k, n, rng.choice(["server", "SERver ", "  server", "ser", "exe  mgr", "Exe mgr", None, "other"])))
    rows += [(None, 1, 1, 10_000, "x"), (1, None, 1, 10_001, "x")]
    wide = [(*r, "a", "b", "c", "d") for r in rows]  # columns with names used inside
    assert changes(spark, wide) == brute_changes(rows)
    assert changes(spark, []) == []


def test_snapshot_of_null_keys_is_present(spark):
    rows = [(1, 1, 5, 1, "a"), (1, 2, None, 2, "a"), (1, 3, 5, 3, "a")]
    assert changes(spark, [(*r, "", "", "", "") for r in rows]) == [(1, 2, 5, "removed"), (1, 3, 5, "added")]


def indexed(spark, path, deliveries, restart=False):
    """All changes of deliveries to one index, by one object or a new one for each."""
    ix, out = SnapshotIndex(spark, path, buckets=4), []
    for rows in deliveries:
        df = spark.createDataFrame(rows, "trackid long, snapshotid int, pid int, log_id long, cmd string, g string, t string, k string, v string")
        if restart:
            for x in spark.catalog.listTables():  # what another session doesn't know
                spark.sql(f"DROP TABLE IF EXISTS {x.name}")
            ix = SnapshotIndex(spark, path)
        out += [tuple(r) for r in ix.apply(df, "trackid", "snapshotid", "pid", "log_id", "cmd").collect()]
    return sorted(out), ix


def test_snapshot_index(spark, tmp_path):
    """In one delivery, in many, and by a session that starts anew, the index gives what plain joins give."""
    rng = random.Random(3)
    rows, n = [], 0
    for g in (1, 2, 3):
        for t in rng.sample(range(1, 12), 8):
            for k in [*rng.sample(range(8), rng.randrange(8)), *([None] if rng.random() < 0.3 else []), *([3] if rng.random() < 0.3 else [])]:
                n += 1
                rows.append((g, t, k, n, rng.choice(["server", "SERver ", "ser", "exe  mgr", "Exe mgr", None, "other"]), "a", "b", "c", "d"))
    rows += [(None, 1, 1, 10_000, "x", "", "", "", ""), (1, None, 1, 10_001, "x", "", "", "", "")]
    want = changes(spark, rows)
    assert want == brute_changes([r[:5] for r in rows])
    got, ix = indexed(spark, f"{tmp_path}/one", [rows])
    assert got == want
    cuts = [[r for r in rows if r[1] and a <= r[1] < b and r[0] != 3 or r[0] == 3 and (r[1] < 6) == (a == 1)] for a, b in ((1, 4), (4, 5), (5, 99))]
    assert indexed(spark, f"{tmp_path}/many", cuts)[0] == want
    got, ix = indexed(spark, f"{tmp_path}/anew", cuts, restart=True)
    assert got == want
    assert sorted(p.name for p in (tmp_path / "anew").iterdir() if p.is_dir()) == ["g2"]  # one generation stays
    again = ix.apply(spark.createDataFrame([r for r in rows if r[0] == 1], "trackid long, snapshotid int, pid int, log_id long, cmd string, g string, t string, k string, v string"), "trackid", "snapshotid", "pid", "log_id", "cmd")
    assert again.count() == 0  # known snapshots
    ix.drop()
    assert not (tmp_path / "anew").exists()
    assert indexed(spark, f"{tmp_path}/none", [[]])[0] == []


def series(values, least=5.0, resolution=0.3, usual=0.08, chances=anomalies.state_probabilities, out=(), snapshots=None):
    """Places of spikes and stuck values of one series."""
    m, n = Model(), np.array([len(values)])
    snap = np.array([snapshots or range(len(values))])
    p = anomalies._padded(np.array([values], float), snap, np.isin(np.arange(len(values)), list(out))[None, :], n, m)
    keys, counts = anomalies._summary(p, np.ones_like(snap, bool), np.array([resolution]), m)[0]
    stats = dict(zip(anomalies.STATS, (np.array([x]) for x in anomalies._usual(keys, counts, least, resolution, usual, m))))
    spike, stuck = anomalies.flags(p, stats, np.array([least]), m, chances)
    return np.flatnonzero(spike[0]).tolist(), np.flatnonzero(stuck[0]).tolist()


def noisy(n, level, sd, seed=0):
    return np.round(np.random.default_rng(seed).normal(level, sd, n), 1).tolist()


def test_spikes():
    x = noisy(60, 40, 2)
    x[10] = 120
    x[30:33] = [1.0, 1.0, 1.0]
    assert series(x) == ([10, 30, 31, 32], [])
    x = noisy(60, 40, 2)
    x[20:24] = [120.0, 121.0, 119.0, 120.5]  # four snapshots are no spike
    assert series(x) == ([], [])
    assert series(noisy(30, 40, 2) + noisy(30, 90, 2, 1)) == ([], [])  # a lasting change of level
    x = noisy(60, 4, 0.3)
    x[10] = 8.0  # below the least size
    assert series(x) == ([], [])
    assert series([50.0, 41.0, 60.0]) == ([], [])
    assert series(noisy(8, 137, 8) + noisy(60, 235, 12, 1)) == ([], [])  # a change of level near the start
    x = noisy(60, 235, 12)
    x[0] = 500.0
    assert series(x) == ([0], [])
    assert series([3.0]) == ([], [])


def test_stuck():
    x = noisy(80, 40, 2)
    x[20:32] = [41.3] * 12
    assert series(x) == ([], list(range(20, 32)))
    x = noisy(80, 40, 2)
    x[20:29] = [41.3] * 9  # nine are too few
    assert series(x)[1] == []
    assert series([0.0] * 60 + [0.3, 0.0, 0.7] + [0.0] * 30)[1] == []  # idle
    assert series([0.3, 0.7, 0.0, 0.4, 1.0, 0.3, 0.7, 0.3, 0.9, 0.4] + [0.0] * 15)[1] == []
    x = noisy(80, 500_000, 6_000)
    x[20:40] = [501_234.0] * 20
    x[60] = 3_000_000.0  # a spike doesn't hide what is stuck
    assert series(x, least=50_000.0, resolution=1_000.0, usual=0.02) == ([60], list(range(20, 40)))
    assert series([2.0] * 40)[1] == []  # there are no other readings
    x = noisy(80, 40, 2)
    x[20:34] = [41.3] * 14
    x[26] = 900.0
    assert series(x, out=[26]) == ([], [i for i in range(20, 34) if i != 26])  # an impossible reading between them
    x[26] = 70.0
    shots = list(range(80))
    shots[26:] = [i - 1 for i in shots[26:]]  # a second value in the snapshot of the one before
    assert series(x, snapshots=shots) == ([26], [i for i in range(20, 34) if i != 26])


def test_the_posterior_decides():
    """With a constant in the place of the posterior at least a tenth of what is flagged is wrong."""

    def constant(p, stats, m):
        g, off = anomalies.state_probabilities(p, stats, m)
        return {k: np.ones_like(v) for k, v in g.items()}, off

    planted = flagged = right = 0
    for seed in range(40):
        level = 20 + 5 * seed
        x = noisy(90, level, 0.06 * level, seed)
        x[40], x[70:75] = 5 * level, [2 * level + i for i in range(5)]
        planted += 1
        found = series(x)[0]
        right += found == [40]
        flagged += len(series(x, chances=constant)[0])
    assert right >= 0.95 * planted and flagged > 3 * planted


def test_blocks_make_no_difference(spark):
    """A series of 5,000 snapshots has the same flags however it is cut; the level changes, and so does how often values repeat."""
    rng = np.random.default_rng(4)
    x = np.round(np.r_[rng.normal(40, 1, 2000), rng.normal(90, 6, 3000)], 1)
    x[3000:3012], x[2040:2060], x[4090:4101] = 88.8, 91.2, 93.4
    for i in (10, 1950, 2049 - 20, 2500, 4095 + 30, 4999):
        x[i] = 300
    df = spark.createDataFrame([(i, i, float(v)) for i, v in enumerate(x)], "id long, snap int, cpu double")
    spec = [Reading("cpu", F.col("cpu"), F.lit(0), F.lit(400), 5, 0.3, 0.08, (F.lit(1),))]
    got = [sorted(tuple(r) for r in implausible_readings(df, "id", "snap", spec, Model(block=b)).collect()) for b in (2048, 300, 100_000)]
    assert got[0] == got[1] == got[2]
    assert {r[0] for r in got[0] if r[2] == "stuck"} == {*range(3000, 3012), *range(2040, 2060), *range(4090, 4101)}
    assert {10, 1950, 2029, 2500, 4125, 4999} <= {r[0] for r in got[0] if r[2] == "spike"}


def test_implausible_rows(spark):
    x = noisy(60, 40, 2)
    x[10] = 120.0
    rows = [(i, 1, i + 1, 7, v, "extra") for i, v in enumerate(x)]
    rows += [(100, 1, 11, 7, 120.0, "again"), (101, 1, 12, 7, -1.0, ""), (102, 1, 13, 7, 900.0, ""), (103, 1, 14, 7, None, ""), (104, None, None, None, -5.0, ""), (105, 1, 15, None, 120.0, "")]
    df = spark.createDataFrame(rows, "id long, track int, snap int, pid int, cpu double, value string")
    spec = [Reading("cpu", F.col("cpu"), F.lit(0), F.lit(400), 5, 0.3, 0.08, (F.col("track"), F.col("pid")))]
    for model in (Model(), Model(block=16, margin=12)):
        got = sorted((r["id"], r["kind"]) for r in implausible_readings(df, "id", "snap", spec, model).collect())
        assert got == [(10, "spike"), (100, "spike"), (101, "impossible"), (102, "impossible"), (104, "impossible")]
    assert implausible_readings(df.limit(0), "id", "snap", spec).count() == 0


def test_periods_know_no_time_zone(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    rows = [("d", datetime.datetime(2014, 3, 9, 1, 59), datetime.datetime(2014, 3, 9, 2, 30)), ("d", datetime.datetime(2014, 3, 9, 2, 45), datetime.datetime(2014, 3, 9, 3, 10)), ("e", datetime.datetime(1969, 12, 31, 23, 59, 58), datetime.datetime(1970, 1, 1))]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert periods(spark, rows) == brute_periods(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
