"""The text operators against brute force and public tokenizers, and their edge cases."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from oxbow.llm import dedup, digest, frequent, packing, plans, quality, tokenizer, truncation
from tests.compare import duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_same_rows(name, spark, sf, duck):
    assert spark_rows(plans.QUERIES[name](spark, sf)) == duck_rows(duck, plans.ORACLE[name])


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_empty_tables(name, spark, sf, tmp_path_factory):
    d = tmp_path_factory.getbasetemp() / "empty"
    if not d.exists():
        for t in ("querystats", "sqlstart", "processlog", "documents", "common_words"):
            spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    assert plans.QUERIES[name](spark, str(d)).count() == 0


# truncation
RECORDS = "table_name string, row_key long, source string, owner string, is_sql boolean, text string"


def reasons(spark, rows):
    return {(r["table_name"], r["row_key"]): r["reason"] for r in truncation.truncated_records(spark.createDataFrame(rows, RECORDS)).collect()}


def test_prefixes_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    norm = sorted({" ".join(t.split()) for t in texts} - {""})
    want = {t for t in norm if any(x != t and x.startswith(t) for x in norm)}
    df = spark.createDataFrame([("t", i, "s", None, False, t) for i, t in enumerate(texts)], RECORDS).withColumn("norm", truncation.normalised(F.col("text"))).filter("norm <> ''")
    signs = truncation.cut_signs(df.select(F.lit(truncation.COMMAND).alias("scope"), "norm"))
    h = df.select("norm", F.xxhash64("norm").alias("h1"), F.xxhash64(F.reverse("norm")).alias("h2")).distinct()
    assert {r["norm"] for r in h.join(signs.filter("prefix"), ["h1", "h2"]).collect()} == want


def test_truncated(spark):
    sql = "select a, b, sum(c) from some_fact where d = 5 and e = {} group by a, b"
    rows = [("q", i, "free", None, True, sql.format(i)) for i in range(20)]
    rows += [("q", 100 + i, "short", None, True, sql.format(i)[:60]) for i in range(8)]  # a source's limit
    rows += [("q", 200, "free", None, True, sql.format(3)[:50]), ("q", 201, "free", None, True, sql.format(3)[:40] + "..."), ("q", 202, None, None, True, "select a from"), ("q", 203, "free", None, True, None), ("q", 204, "free", None, True, "  ")]
    rows += [("q", 205, "free", None, True, sql.format(3)[:50])]  # delivered twice
    rows += [("p", i, "m1", f"1/{i % 3}", False, x) for i, x in enumerate(["worker fast", "worker", "mgr", "job 75", "job 758", "Job  758", "server one", "serv", None, ""])]
    got = reasons(spark, rows)
    assert {k for k in got if k[0] == "q"} == {("q", 100 + i) for i in range(8)} | {("q", 200), ("q", 201), ("q", 202), ("q", 205)}
    assert got["q", 201] == "marker"
    assert {k[1] for k in got if k[0] == "p"} == {1, 7}  # 'job 75' is another job than 'job 758': another owner
    own = [("p", 1, "m", "1/9", False, "job 75"), ("p", 2, "m", "1/9", False, "job 758")]
    assert reasons(spark, own) == {("p", 1): "prefix"}
    own += [("p", 3, "m", "1/9", False, "job runner all"), ("p", 4, "m", "1/90", False, "job 75"), ("p", 5, "m", None, False, "job 7")]
    assert reasons(spark, own) == {("p", 1): "prefix"}  # whatever else the owner does; another owner's job 75 is whole


def test_own_prefixes_against_brute_force(spark):
    """Numbers that go on in digits are cut only if their owner shows the longer one, however many commands it has."""
    rng = random.Random(11)
    rows = [("p", i, f"m{i % 3}", rng.choice(["1/1", "1/11", "2/1", None]), False, rng.choice(["job ", "jo", "7", ""]) + "".join(rng.choice("17") for _ in range(rng.randrange(1, 5)))) for i in range(300)]
    got = {k[1] for k, why in reasons(spark, rows).items() if why == "prefix"}
    texts = {r[5] for r in rows}

    def cut(owner, t):
        nxt = min((x for x in texts if x > t), default="")
        if not nxt.startswith(t):
            return False
        digits = t[-1].isdigit() and nxt[len(t)].isdigit()
        return not digits or any(r[3] is not None and r[3] == owner and r[5] != t and r[5].startswith(t) for r in rows)

    assert got == {r[1] for r in rows if cut(r[3], r[5])}


def test_command_limit(spark):
    rows = [("p", i, "cut", f"a/{i}", False, x[:9]) for i, x in enumerate(["controller", "printprocess", "job 77777", "server", "statistics"] * 4)]
    rows += [("p", 100 + i, "free", f"b/{i}", False, x) for i, x in enumerate(["controller", "printprocess", "server", "statistics", "job 77777"])]
    got = reasons(spark, rows)
    texts = {k[1]: rows[k[1]][5] for k in got}
    assert set(texts.values()) == {"controlle", "printproc", "statistic"}


# frequent items
def test_frequent(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "Hot", "", None, f"r{rng.randrange(500)}"]), f"u{int(rng.expovariate(0.5))}", "item") for _ in range(3000)]
    df = spark.createDataFrame(rows, "query string, user_name string, item string")
    want = {(f, v) for i, f in enumerate(("query", "user_name")) for v, n in Counter(r[i] for r in rows).items() if v is not None and n >= 0.01 * len(rows)}
    got = frequent.frequent_items(df, ["query", "user_name"], 0.01).collect()
    assert {(r["field"], r["item"]) for r in got} == want
    assert all(r["n"] == sum(x[("query", "user_name").index(r["field"])] == r["item"] for x in rows) for r in got)
    top = Counter(r[1] for r in rows)
    assert [(r["item"], r["n"]) for r in frequent.top_items(df, "user_name", 3).collect()] == sorted(top.items(), key=lambda x: (-x[1], x[0]))[:3]


# percentiles
def test_digest_merge():
    rng = np.random.default_rng(0)
    x = np.r_[np.zeros(30_000), rng.lognormal(4, 2, 70_000)]
    whole = digest.cluster(x, np.ones(len(x), np.int64))
    parts = [digest.cluster(p, np.ones(len(p), np.int64)) for p in np.array_split(rng.permutation(x), 13)]
    merged = digest.cluster(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
    s = np.sort(x)
    for m, w in (whole, merged):
        assert w.sum() == len(x) and len(m) <= digest.DELTA
        for q in (0.1, 0.5, 0.9, 0.99, 0.999):
            e = digest.quantile(m, w, s[0], s[-1], q)
            assert max(0, np.searchsorted(s, e, "left") - q * len(s), q * len(s) - np.searchsorted(s, e, "right")) / len(s) <= 0.002
    assert digest.cluster(np.array([5.0]), np.array([3]))[0].tolist() == [5.0]


def test_percentiles(spark):
    rng = np.random.default_rng(1)
    rows = [(h, d, None if rng.random() < 0.05 else float(round(rng.lognormal(2, 2))), 1.0) for h in ("a", "b", None) for d in range(3) for _ in range(400 if h != "b" else 1)]
    df = spark.createDataFrame([(h, f"2014-01-0{d + 1}", x, n) for h, d, x, n in rows], "host string, day string, phyio double, n double")
    for delta in (digest.DELTA, 8):  # the coarse digest misses its error: exact ranks step in
        got = digest.group_percentiles(df, F.col("host"), F.to_date("day"), ["phyio", "n"], (0.5, 0.9, 0.999), delta=delta).collect()
        by = defaultdict(list)
        for h, _, x, n in rows:
            if x is not None:
                by[h, "phyio"].append(x)
            by[h, "n"].append(n)
        assert len(got) == 3 * len(by)
        for r in got:
            s = np.sort(by[r["grp"], r["field"]])
            assert r["n"] == len(s)
            off = max(0, np.searchsorted(s, r["estimate"], "left") - r["q"] * len(s), r["q"] * len(s) - np.searchsorted(s, r["estimate"], "right")) / len(s)
            assert off <= 0.002 + 1e-12 and abs(off - r["rank_error"]) < 1e-9


def test_percentiles_of_the_tails(spark):
    """A coarse digest misses the tails; what it misses is repaired by the share of the tail, not of all values."""
    values = np.random.default_rng(7).pareto(1.0, 20_000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = digest.group_percentiles(df, F.lit("a"), F.lit("2024-01-01").cast("date"), ["v"], (0.001, 0.5, 0.99, 0.999), delta=20).collect()
    s, n = np.sort(values), len(values)
    assert len(got) == 4
    for r in got:
        off = max(0, np.searchsorted(s, r["estimate"], "left") - r["q"] * n, r["q"] * n - np.searchsorted(s, r["estimate"], "right"))
        assert off <= max(0.002 * min(r["q"], 1 - r["q"]) * n, 1) + 1e-6, r


# duplicates
def test_hidden_duplicates(spark):
    writings = ["select a, b from t where x = {0} and y = 1", "SELECT b,a FROM `t` WHERE y=1 AND (x={0});", "select a,b\nfrom t where (x = {0}) and y = 1", "select a from t where x = {0}"]
    rng = random.Random(8)
    rows = [(rng.choice("pq"), i, writings[rng.randrange(4)].format(rng.randrange(12)), "x", 1) for i in range(300)]
    rows += [("p", 1000 + i, "hot", "x", 1) for i in range(200)] + [("p", 2000, None, "x", 1), ("p", 2001, "", "x", 1), ("p", 2002, "", "x", 1)]
    df = spark.createDataFrame(rows, "scope string, key long, text string, h1 string, first int")
    groups = defaultdict(list)
    for s, k, t, *_ in rows:
        if t:
            groups[s, dedup.sqltext.canonical(t)].append(k)
    want = sorted((s, min(v), k) for (s, _), v in groups.items() for k in v if k != min(v))
    assert sorted(tuple(r) for r in dedup.hidden_duplicates(df).collect()) == want
    poor = lambda c: [F.length(c) % 3, F.lit(0)]  # noqa: E731  texts that share hashes are told apart all the same
    assert sorted(tuple(r) for r in dedup.hidden_duplicates(df, hashed=poor).collect()) == want
    assert sorted((r["scope"], r["first_key"], r["copies"]) for r in dedup.collapsed(df).collect()) == sorted((s, min(v), len(v)) for (s, _), v in groups.items())


# tokenizer
@pytest.fixture(scope="module")
def ranks():
    try:
        return tokenizer.load_ranks()
    except OSError:
        pytest.skip("no public vocabulary here")


def test_tokenizer(spark, ranks):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    texts = ["", " ", "  \n\t x", "it's they'll I'VE", "<|endoftext|> is text", "naïve 東京 🚀🧪 ½ x²", "a" * 3000, "ab" * 2000 + "​" * 50, "0x1f+3,000.50", "\r\n\r\n  end  "]
    texts += ["".join(chr(rng.randrange(0, 128)) for _ in range(rng.randrange(40))) for _ in range(500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), 0x1F600 + rng.randrange(50)])) for _ in range(rng.randrange(60))) for _ in range(300)]
    enc = tokenizer.Encoder(ranks)
    by_id = {v: k for k, v in ranks.items()}
    for t in texts:
        ids = enc(t)
        assert ids == ref.encode_ordinary(t)
        assert b"".join(by_id[i] for i in ids).decode() == t
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None])], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokenizer.encode(df, "doc_id", "text").collect()}
    assert got == {i: ref.encode_ordinary(t or "") for i, t in enumerate([*texts, None])}


# packing
def test_plan():
    rng = random.Random(9)
    for _ in range(60):
        cap = rng.choice([10, 50, 200])
        counts = {s: rng.choice([1, 2, 7, 100]) for s in rng.sample(range(1, cap + 1), rng.randrange(1, cap))}
        p = packing.plan(counts, cap)
        used = Counter()
        for x in p:
            assert sum(s * k for s, k in x.sizes) <= cap and x.times > 0
            for s, k in x.sizes:
                used[s] += k * x.times
        assert used == Counter(counts)
        bins: list[int] = []  # first fit, largest first
        for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
            i = next((i for i, g in enumerate(bins) if g >= s), None)
            if i is None:
                bins.append(cap - s)
            else:
                bins[i] -= s
        assert sum(x.times for x in p) <= 1.03 * len(bins) + 1


def test_sums():
    """The index of pair sums follows the sizes that are left; what it finds adds up and is there."""
    rng = random.Random(13)
    for _ in range(40):
        cap = rng.choice([9, 30, 64])
        left = Counter({s: rng.choice([1, 1, 2, 5]) for s in rng.sample(range(1, cap + 1), rng.randrange(1, cap))})
        sums = packing.Sums(dict(left), cap)
        while left:
            there = sorted(left)
            for g in range(1, cap + 1):
                pairs = {(b, g - b) for b in there if g - b in left and b >= g - b and (b != g - b or left[b] > 1)}
                assert sums.pairs[g] == len(pairs)
                assert (tuple(sums.pair(g) or ()) in pairs) == bool(pairs)
                got = sums.triple(g)
                some = any((Counter((a, b, g - a - b)) - left).total() == 0 for a in there for b in there if g - a - b > 0)
                assert (got is not None) == some
                assert got is None or (sum(got) == g and not Counter(got) - left)
            used = Counter(rng.choices(there, k=rng.choice([1, 2])))
            if not used - left:
                sums.use(dict(used), 1)
                left -= used


def test_plan_of_a_large_capacity():
    rng = np.random.default_rng(5)
    counts = Counter(np.minimum(131_072, rng.lognormal(7, 1.5, 20_000).astype(int) + 1).tolist())
    began = time.time()
    p = packing.plan(counts, 131_072)
    assert time.time() - began < 6
    used = Counter()
    for x in p:
        for s, k in x.sizes:
            used[s] += k * x.times
    assert used == counts
    assert sum(x.times for x in p) <= np.ceil(sum(s * n for s, n in counts.items()) / 131_072) + 1


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([rng.randrange(1, 60), 100, 230, 0, None, -4, 7]), 5) for i in range(500)] + [(3, 7, 5), (3, 7, 5)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n int, rank int"), "doc_id", "n", capacity=100).collect()
    fill, by = Counter(), defaultdict(list)
    for r in got:
        fill[r["container"]] += r["size"]
        by[r["doc_id"]].append((r["piece"], r["from_unit"], r["size"]))
    assert max(fill.values()) <= 100 and set(fill) == set(range(len(fill)))
    assert sum(fill.values()) == sum(n for _, n, _ in rows if n and n > 0)
    for i, n, _ in rows[:500]:
        if not n or n < 0:
            assert i not in by or i == 3
        elif n <= 100 and i != 3:
            assert by[i] == [(0, 0, n)]
        elif i != 3:
            x = sorted(by[i])
            assert [a for a, *_ in x] == list(range(len(x))) and sum(s for *_, s in x) == n and all(f == 100 * a for a, f, _ in x)
    assert len(fill) <= sum(fill.values()) / 100 * 1.02 + 1


# quality
def test_exact_ranks(spark):
    rng = random.Random(1)
    rows = [("s", rng.choice(["en", "de"]), float(rng.randrange(30)), rng.random() < 0.6) for _ in range(500)]
    df = spark.createDataFrame(rows, "stat string, lang string, value double, inside boolean")
    for counted in (None, "inside"):
        got = quality.exact_ranks(df, everyone=True, counted=counted).collect()
        for r in got:
            every = [x for _, g, x, _ in rows if r["lang"] in (g, "*")]
            v = [x for _, g, x, k in rows if r["lang"] in (g, "*") and (k or counted is None)]
            assert r["rows"] == every.count(r["value"]) and r["n"] == v.count(r["value"])
            assert r["below"] == sum(x <= r["value"] for x in v) and r["total"] == len(v)
        assert len(got) == len({(g, x) for _, g, x, _ in rows}) + len({x for _, _, x, _ in rows})


def test_stats():
    common = {"en": frozenset(("the", "a", "is")), "fr": frozenset(("l", "le"))}
    s = dict(zip(quality.STATS, quality.TextStats(common)("The cat is here.\n> A dog\n\n- 5 x_y")))
    assert s["n_words"] == 8 and s["end_share"] == 1 / 3 and s["marked_share"] == 1 / 3
    assert s["common_share"] == 3 / 8 and s["plain_share"] == 6 / 10
    assert s["variety"] == 1 and s["repeat_share"] == 0
    assert dict(zip(quality.STATS, quality.TextStats(common)("l’import")))["common_share"] == 0.5
    again = dict(zip(quality.STATS, quality.TextStats(common)("buy it now, Buy it now! buy it now")))
    assert again["repeat_share"] == 4 / 7 and again["variety"] == pytest.approx(np.log(3) / np.log(9))
    for t in ("x", "​", "….", "- ", "a" * 100_000):
        assert len(quality.TextStats(common)(t)) == len(quality.STATS)


def brute_scores(rows, min_reference):
    """Scores of (lang, statistics) rows by sorting each statistic anew."""
    langs, v = np.array([r[0] for r in rows], object), {s: np.array([r[1 + i] for r in rows], float) for i, s in enumerate(quality.STATS)}

    def score(inside):
        out = np.zeros(len(rows))
        for g in set(langs):
            own = langs == g
            ref = inside & own if g != "und" and (inside & own).sum() >= min_reference else inside
            for s, side in quality.TAILS.items():
                x, y = np.sort(v[s][ref]), v[s][own]
                low, high = (np.searchsorted(x, y, "right") + 1) / (len(x) + 1), (len(x) - np.searchsorted(x, y, "left") + 1) / (len(x) + 1)
                p = {"low": low, "high": high, "both": 2 * np.minimum(low, high)}[side]
                out[own] -= np.log(np.maximum(quality.LEAST_TAIL, np.minimum(1, p)))
        return np.round(out, 6)

    s = score(np.ones(len(rows), bool))
    bins = np.floor(s * 100).astype(int)
    bound = (np.sort(bins)[int(np.ceil(quality.CORE * len(rows))) - 1] + 1) / 100
    for _ in range(quality.ROUNDS):
        s = score(s < bound)
        bound = quality.chance_level(quality.TRIM)
    return s


def test_scores_against_brute_force(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["en", "en", "de", "und", "xx"]), rng.randrange(1, 90), *[rng.choice([0.0, round(rng.random(), 2)]) for _ in quality.STATS[1:]]) for _ in range(400)]
    rows += rows[:5]
    df = spark.createDataFrame([(i % 300, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, n_words long, " + ", ".join(f"{s} double" for s in quality.STATS[1:]) + ", value string")
    got = quality.outlier_scores(df, min_reference=60).collect()
    want = sorted((r[0], r[1], float(x)) for r, x in zip(rows, brute_scores(rows, 60)))
    for a, b in zip(sorted((r["lang"], r["n_words"], r["score"]) for r in got), want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-5)
    assert {r["level"] for r in got} == {quality.chance_level(1 / len(rows))}


def test_chance_level():
    x = np.random.default_rng(0).exponential(size=(200_000, len(quality.STATS))).sum(axis=1)
    for alpha in (0.5, 0.05, 0.001):
        assert abs((x > quality.chance_level(alpha)).mean() - alpha) < 5 * (alpha / len(x)) ** 0.5 + 1e-4


@pytest.fixture(scope="module")
def some_documents(spark):
    d = "/root/testdata/sf0.01"  # tails need some hundred documents
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{d}/common_words.parquet")


def test_no_prose(spark, some_documents):
    docs, words = some_documents
    table_ = "\n".join(f"k_{i} = {i * 7} {i + 91}" for i in range(12))
    extra = [(-1, "- a\n- b c\n- d\n- e", "en"), (-2, None, "en"), (-3, "  \n", None), (-4, "buy now cheap / " * 40, "en"), (-5, table_, None), (-6, "The plan is right and we know that it will hold for the rest of the day.", "xx"), (-1, "- a\n- b c\n- d\n- e", "en"), (-7, table_, "sv")]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("score", F.lit(1)).withColumn("key", F.lit(2))
    stats = quality.document_stats(df, words).checkpoint()
    found = [r["doc_id"] for r in quality.no_prose(stats).select("doc_id").collect()]
    assert sorted(x for x in found if x < 0) == [-7, -5, -4, -1, -1]
    # The score decides: without the ranks of some statistics a good part is lost, without any all is.
    some = stats.withColumns({s: F.lit(0.5) for s in ("common_share", "plain_share", "marked_share", "end_share")})
    assert quality.no_prose(some).count() < 0.9 * len(found)
    assert quality.no_prose(stats.withColumns({s: F.lit(1) if s == "n_words" else F.lit(0.5) for s in quality.STATS})).count() == 0


def test_no_prose_of_prose(some_documents):
    """Where nothing but prose is left, hardly any comes out."""
    docs, words = some_documents
    stats = quality.document_stats(docs, words).checkpoint()
    bad = quality.no_prose(stats).select("doc_id")
    prose = stats.join(bad, "doc_id", "left_anti").checkpoint()
    assert quality.no_prose(prose).count() <= 0.02 * prose.count()
