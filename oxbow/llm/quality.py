"""Text quality statistics of documents, and the documents that are no prose.

One Arrow pass computes the statistics. Their exact ranks per language come from a
range-partitioned sort: distinct values with their counts are sorted over the partitions, each
partition sums its own counts, and the totals of the partitions before it are its offset. From
the ranks follow the empirical tail probabilities of every value; a document's outlier
score is the sum of -ln of the tails in which lists, tables and junk lie.

The tails are those of a reference: at first all documents, then the half with the lowest scores,
then all whose score is no surprise, so that what is to be found doesn't hide itself by its number.
If a document were like the reference, its tails would be even and the sum a gamma variable with
one unit of shape a statistic (Fisher's way to combine tail probabilities). A document is none of
prose if its score is one that chance gives to less than one document of the whole corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oxbow.session import ensure_checkpoint_dir, spread, table

#: Statistic and the tail in which lists, tables and junk lie.
TAILS = {
    "n_words": "low", "mean_word_length": "both", "symbol_share": "high", "end_share": "low", "common_share": "low",
    "marked_share": "high", "plain_share": "low", "variety": "low", "repeat_share": "high",
}
STATS = list(TAILS)
#: Ranks over all languages; a document of unknown language is held against them.
EVERYONE = "*"
#: The most words the list of common words may have: it goes to every executor.
MAX_COMMON = 100_000
#: A value that stands in this share of a statistic's rows is joined by broadcast (there are at most 1 / share of them).
HOT = 0.01
#: A language with fewer documents in the reference is held against all languages.
MIN_REFERENCE = 1000
#: Tails below this aren't told apart.
LEAST_TAIL = 1e-4
#: Share of the documents in the first reference, chance of a score that leaves it later, and how often it is made.
CORE, TRIM, ROUNDS = 0.5, 1e-3, 3

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
PLAIN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
APOSTROPHE = re.compile("['\u2019]")
SYMBOL = re.compile(r"[^\w\s]|_")
#: Tokens whose reading a Python worker keeps; emptied when full.
MAX_KNOWN = 200_000
LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
QUOTE = re.compile(r"^(?:\s*>)+\s?")
CLOSERS = "\"'\u00bb\u201d\u2019)]"
ENDS = (".", "!", "?", "\u2026", ":", "\u3002")
MARK = re.compile(
    r"^\s*(?:(?:[-*+\u2022\u2013\u00b7\u2023\u25e6]|\d+[.)]|\[[ xX]?\]|#\d+|\(?\d+\)|[a-z][.)])\s"  # bullets, numbers, boxes
    r"|[\w./-]*[_./\d][\w./-]*\s*[:=](?:\s|$)"  # an identifier and its value
    r"|[\w./\\-]*[_/\\\d][\w./\\-]*[\w/\\]\s*$)"  # an identifier or a path alone
)
EDGES = "\"'\u2019\u2018\u201c\u201d\u00ab\u00bb()[]{}<>.,;:!?\u00bf\u00a1\u2026*_~`|/\\-\u2013\u2014\u2022\u200b\ufeff\u00a0"


class TextStats:
    """The statistics of texts in the order of STATS, by common words per language.

    n_words: runs of letters (with inner apostrophes); mean_word_length in letters; symbol_share: of the
    characters that aren't white space, those neither letter nor digit; end_share: non-blank lines ending in
    . ! ? : \u2026 or \u3002; common_share: of the blank-separated tokens (cut at apostrophes), those among the common words of
    the best-fitting language; marked_share: lines that begin with a bullet, number or box, or
    are an identifier, alone or with its value; plain_share: tokens that
    are words of letters alone; variety: the logarithm of the number of distinct tokens over that of their number (1 for one token);
    repeat_share: of the runs of three tokens, those that occurred before. Quote marks before lines don't count.
    """

    def __init__(self, common: dict[str, frozenset[str]]):
        self.languages = len(common)
        self.of: dict[str, tuple[int, ...]] = {}
        for i, words in enumerate(common.values()):
            for w in words:
                self.of[w] = (*self.of.get(w, ()), i)
        self.known: dict[str, tuple[str, int, int, tuple[int, ...]] | None] = {}

    def token(self, raw: str) -> tuple[str, int, int, tuple[int, ...]] | None:
        """Of a blank-separated token: without the marks around it, its parts, 1 if plain, the languages that have its parts."""
        x = raw.strip(EDGES)
        if not x:
            made = None
        elif PLAIN.fullmatch(x):
            parts = APOSTROPHE.split(x)
            made = (x, len(parts), 1, tuple(i for p in parts for i in self.of.get(p, ())))
        else:
            made = (x, 1, 0, ())
        if len(raw) <= 40:
            if len(self.known) >= MAX_KNOWN:
                self.known.clear()
            self.known[raw] = made
        return made

    def __call__(self, text: str) -> tuple:
        n_lines = ends = marked = 0
        for x in LINES.split(text):
            if ">" in x:
                x = QUOTE.sub("", x)
            if x and not x.isspace():
                n_lines += 1
                ends += x.rstrip().rstrip(CLOSERS).endswith(ENDS)
                marked += MARK.match(x) is not None
        words = WORD.findall(text)
        raw = text.lower().split()
        known = self.known
        hits = [0] * self.languages
        bare = {}
        n_tokens = n_parts = plain = 0
        for t, times in Counter(raw).items():
            made = known[t] if t in known else self.token(t)
            if made is not None:
                x, k, p, langs = made
                bare[t] = x
                n_tokens += times
                n_parts += k * times
                plain += p * times
                for i in langs:
                    hits[i] += times
        tokens = [bare[t] for t in raw if t in bare]
        runs = max(1, len(tokens) - 2)
        solid = sum(map(len, text.split()))
        return (
            len(words), sum(map(len, words)) / max(1, len(words)), len(SYMBOL.findall(text)) / max(1, solid), ends / max(1, n_lines),
            max(hits, default=0) / max(1, n_parts), marked / max(1, n_lines), plain / max(1, len(raw)),
            math.log(len(set(tokens))) / math.log(n_tokens) if n_tokens > 1 else 1.0, 1 - len(set(zip(tokens, tokens[1:], tokens[2:]))) / runs if len(tokens) > 2 else 0.0,
        )


def _stats_pass(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = TextStats(common)
        for b in batches:
            rows = [stats(t) for t in b.column(2).to_pylist()]
            cols = [pa.array([int(r[0]) for r in rows], pa.int64())]
            cols += [pa.array([float(r[i]) for r in rows], pa.float64()) for i in range(1, len(STATS))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["key", "lang", *STATS])

    return run


def document_stats(docs: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang and the statistics of every text that isn't null, empty or blank.

    lang in lower case, null and blank as 'und'. An empty input gives an empty result. The list of
    common words is small by its nature; more than MAX_COMMON rows are an error.
    """
    rows = common_words.filter(F.col("word").isNotNull()).limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError("the list of common words is too long")
    common: dict[str, set[str]] = {}
    for r in rows:
        common.setdefault(r["lang"], set()).add(r["word"].lower())
    frozen = {k: frozenset(v) for k, v in common.items()}
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.nullif(F.lower(F.trim(lang)), F.lit("")), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter(
        F.col("text").rlike(r"[^\s\u00a0\u2007\u202f\u200b\ufeff\u3000\u2000-\u200a\u2028\u2029\u0085]")
    )
    kind = src.schema["key"].dataType.simpleString()
    made = spread(src).mapInArrow(_stats_pass(frozen), f"key {kind}, lang string, n_words long, " + ", ".join(f"{s} double" for s in STATS[1:]))
    return made.withColumnRenamed("key", key)


def _running(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of the counts so far in this partition, by (stat, lang); rows come sorted."""
    from pyspark import TaskContext

    part, last, held = TaskContext.get().partitionId(), None, 0
    for b in parts:
        if not len(b):
            continue
        stat, lang, n = b["stat"].to_numpy(object), b["lang"].to_numpy(object), b["n"].to_numpy(np.int64)
        new = np.r_[(stat[0], lang[0]) != last, (stat[1:] != stat[:-1]) | (lang[1:] != lang[:-1])]
        sums = np.cumsum(n)
        base = np.where(new, sums - n, 0)
        if not new[0]:
            base[0] = -held
        at = np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
        upto = sums - base[at]
        last, held = (stat[-1], lang[-1]), int(upto[-1])
        yield b.assign(upto=upto, part=part)


def exact_ranks(values: DataFrame, everyone: bool = False, counted: str | None = None) -> DataFrame:
    """stat, lang, value, rows, n, below, total for rows (stat, lang, value): the rows with the value, those of them that
    are counted, the counted ones at or below it, and all counted ones of the group.

    ``counted`` names a boolean column (default: every row counts). ``everyone`` adds the ranks over all languages, as language '*'.
    """
    spark = values.sparkSession
    ensure_checkpoint_dir(spark)
    counts = F.count(F.lit(1)) if counted is None else F.coalesce(F.sum(F.col(counted).cast("long")), F.lit(0))
    own = values.groupBy("stat", "lang", "value").agg(F.count(F.lit(1)).alias("rows"), counts.alias("n"))
    if everyone:
        own = own.unionByName(own.groupBy("stat", "value").agg(F.sum("rows").alias("rows"), F.sum("n").alias("n")).withColumn("lang", F.lit(EVERYONE)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = own.repartitionByRange(parts, "stat", "lang", "value").sortWithinPartitions("stat", "lang", "value")
    local = ordered.mapInPandas(_running, "stat string, lang string, value double, rows long, n long, upto long, part int").checkpoint()
    totals = local.groupBy("stat", "lang", "part").agg(F.max("upto").alias("held"))
    before = Window.partitionBy("stat", "lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stat", "lang")
    offsets = totals.select("stat", "lang", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"), F.sum("held").over(whole).alias("total"))
    r = local.join(offsets, ["stat", "lang", "part"])
    return r.select("stat", "lang", "value", "rows", "n", (F.col("upto") + F.col("offset")).alias("below"), "total")


def _scores(rows: DataFrame, n_rows: int, min_reference: int) -> DataFrame:
    """__row and its score against the rows with ``inside``; the rows have __row, lang, inside and the statistics."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in STATS]))
    long = rows.select("__row", "lang", "inside", each.alias("x")).select("__row", "lang", "inside", "x.stat", "x.value")
    ranks = exact_ranks(long, everyone=True, counted="inside").checkpoint()
    low = (F.col("below") + 1) / (F.col("total") + 1)
    high = (F.col("total") - F.col("below") + F.col("n") + 1) / (F.col("total") + 1)
    tail = F.lit(1.0)
    for s, side in TAILS.items():
        tail = F.when(F.col("stat") == s, {"low": low, "high": high, "both": 2 * F.least(low, high)}[side]).otherwise(tail)
    usable = (F.col("lang") == EVERYONE) | ((F.col("lang") != "und") & (F.col("total") >= min_reference))
    scored = ranks.filter(usable).select("stat", F.col("lang").alias("held"), "value", "rows", (-F.log(F.greatest(F.lit(LEAST_TAIL), F.least(F.lit(1.0), tail)))).alias("part_score"))
    known = ranks.filter(usable).select("lang").distinct().withColumn("held", F.col("lang"))
    long = long.join(known, "lang", "left").select("__row", "stat", F.coalesce("held", F.lit(EVERYONE)).alias("held"), "value")
    # Values that very many documents have go to the rows; all others meet them by a shuffle.
    hot = F.col("rows") >= max(1.0, HOT * n_rows)
    on = ["stat", "held", "value"]
    met = long.join(F.broadcast(scored.filter(hot).drop("rows")), on, "left")
    rest = met.filter(F.col("part_score").isNull()).drop("part_score").join(scored.filter(~hot).drop("rows"), on)
    both = met.filter(F.col("part_score").isNotNull()).select("__row", "part_score").unionByName(rest.select("__row", "part_score"))
    return both.groupBy("__row").agg(F.round(F.sum("part_score"), 6).alias("score")).checkpoint()


def chance_level(alpha: float, shape: int = len(STATS)) -> float:
    """The score that chance exceeds with probability ``alpha``: a gamma variable of this shape."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        t = (low + high) / 2
        above = sum(math.exp(i * math.log(t) - t - math.lgamma(i + 1)) for i in range(shape))
        low, high = (t, high) if above > alpha else (low, t)
    return high


def outlier_scores(stats: DataFrame, key: str = "doc_id", min_reference: int = MIN_REFERENCE) -> DataFrame:
    """The rows of ``stats`` with their outlier score and the level from which chance explains none of them.

    Each is held against the reference of its language, or of all languages where its own is unknown or has too few. The
    reference is made ROUNDS times; only a histogram of scores (at most 100 a unit, and a score is at most
    -ln(LEAST_TAIL) a statistic) goes to the driver. An empty input gives an empty result.
    """
    ensure_checkpoint_dir(stats.sparkSession)
    rows = stats.withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    n = rows.count()
    made = _scores(rows.withColumn("inside", F.lit(True)), n, min_reference)
    bins = sorted((r["bin"], r["count"]) for r in made.groupBy(F.floor(F.col("score") * 100).alias("bin")).count().collect())
    seen, bound = 0, 0.0
    for at, k in bins:
        if seen < CORE * n:
            seen, bound = seen + k, (at + 1) / 100
    for _ in range(ROUNDS):
        inside = made.select("__row", (F.col("score") < bound).alias("inside"))
        made = _scores(rows.join(inside, "__row"), n, min_reference)
        bound = chance_level(TRIM)
    return rows.join(made, "__row").withColumn("level", F.lit(chance_level(1 / max(n, 2)))).drop("__row")


def no_prose(stats: DataFrame, key: str = "doc_id", min_reference: int = MIN_REFERENCE) -> DataFrame:
    """Of documents with their statistics, those that are lists, tables or junk: their score is above the level of chance.

    The reference must be prose: where lists, tables and junk are half of the documents or more, or where there are
    fewer than some hundred documents, tails can't show what is unusual, and few or none come out.
    """
    return outlier_scores(stats, key, min_reference).filter(F.col("score") >= F.col("level"))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return document_stats(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return no_prose(_stats(spark, d)).select("doc_id")


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics and the outlier score of every text."""
    scored = outlier_scores(_stats(spark, d))
    return scored.select("doc_id", "lang", "n_words", *[F.round(s, 6).alias(s) for s in STATS[1:]], "score", F.round("level", 6).alias("level"))
