"""Duplicates hidden by formatting.

Method: byte-identical texts collapse first, with their counts and smallest key; only the
distinct survivors are brought into canonical form; a second grouping on the canonical text
sums the counts. Both groupings compare whole texts. Only to find the rows of a group again 128-bit
hashes stand for the texts, after a count has shown that no two of the texts share one; if two
did, the texts themselves would be joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.llm import sqltext
from oxbow.session import ensure_checkpoint_dir, table

CANON = "scope string, text string, first_key long, copies long, canon string"


def _canonicaliser(canonical: Callable[[str], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([canonical(t) for t in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=["scope", "text", "first_key", "copies", "canon"])

    return run


def _hash128(c: str) -> list[Column]:
    """128 bits of a text from two independent passes."""
    return [F.xxhash64(c), F.xxhash64(F.reverse(c))]


def _named(columns: list[Column], *names: str) -> list[Column]:
    return [c.alias(n) for c, n in zip(columns, names)]


def _texts(records: DataFrame) -> DataFrame:
    return records.filter(F.col("text").isNotNull() & (F.trim("text") != ""))


def distinct_texts(records: DataFrame, canonical: Callable[[str], str]) -> DataFrame:
    """One row per distinct text: scope, text, first_key, copies, canon."""
    raw = _texts(records).groupBy("scope", "text").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("copies"))
    return raw.mapInArrow(_canonicaliser(canonical), CANON)


def _shared(df: DataFrame, *hashes: str) -> bool:
    """Whether two rows, which stand for different texts, share a hash."""
    return not df.groupBy("scope", *hashes).count().filter("count > 1").isEmpty()


def hidden_duplicates(records: DataFrame, canonical: Callable[[str], str] = sqltext.canonical, hashed: Callable[[str], list[Column]] = _hash128) -> DataFrame:
    """Every record that has an equal one with a smaller key: scope, first_key, copy_key.

    ``records``: scope, key (unique in its scope), text. Texts are equal if their canonical
    forms are. Null, empty and blank texts are no records. A text that holds a third of all
    rows is one row of the second grouping; its copies are listed by a join in which that row
    meets them wherever they are (adaptive execution splits the hot key). An empty input gives
    an empty result. ``hashed`` gives two hashes of a text column; what they are changes the work, never the result.
    """
    ensure_checkpoint_dir(records.sparkSession)
    made = distinct_texts(records, canonical)
    survivors = made.select("scope", "first_key", "copies", "canon", *_named(hashed("text"), "h1", "h2"), *_named(hashed("canon"), "c1", "c2")).checkpoint()
    groups = survivors.groupBy("scope", "canon").agg(F.min("first_key").alias("first"), F.sum("copies").alias("total"))
    by_hash = groups.select("scope", "first", "total", *_named(hashed("canon"), "c1", "c2")).checkpoint()
    if _shared(by_hash, "c1", "c2"):
        found = survivors.join(groups.filter("total > 1"), ["scope", "canon"])
    else:
        found = survivors.drop("canon").join(by_hash.filter("total > 1"), ["scope", "c1", "c2"])
    # Texts that stand once and under one key answer for themselves; the others are met with their rows.
    found = found.select("scope", "h1", "h2", "first_key", "copies", "first")
    single = found.filter((F.col("copies") == 1) & (F.col("first_key") != F.col("first"))).select("scope", F.col("first").alias("first_key"), F.col("first_key").alias("copy_key"))
    many = found.filter("copies > 1")
    rows = _texts(records).select("scope", "key", "text")
    if _shared(survivors, "h1", "h2"):
        texts = _texts(records).groupBy("text", "scope").agg(F.min("key").alias("first_key"))
        listed = rows.join(texts.join(many.select("scope", "first_key", "first"), ["scope", "first_key"]).drop("first_key"), ["scope", "text"])
    else:
        listed = rows.select("scope", "key", *_named(hashed("text"), "h1", "h2")).join(many.select("scope", "h1", "h2", "first"), ["scope", "h1", "h2"])
    return single.unionByName(listed.filter(F.col("key") != F.col("first")).select("scope", F.col("first").alias("first_key"), F.col("key").alias("copy_key")))


def collapsed(records: DataFrame, canonical: Callable[[str], str] = sqltext.canonical) -> DataFrame:
    """Each different text once: scope, first_key, copies (rows), writings (distinct texts)."""
    return (
        distinct_texts(records, canonical)
        .groupBy("scope", "canon")
        .agg(F.min("first_key").alias("first_key"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("writings"))
        .select("scope", "first_key", "copies", "writings")
    )


def statements(spark: SparkSession, d: str) -> DataFrame:
    """The statements of both tables."""
    a = table(spark, d, "querystats").select(F.lit("querystats").alias("scope"), F.col("queryid").alias("key"), F.col("query").alias("text"))
    b = table(spark, d, "sqlstart").select(F.lit("sqlstart").alias("scope"), F.col("id").alias("key"), F.col("statement").alias("text"))
    return a.unionByName(b)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return hidden_duplicates(statements(spark, d)).withColumnRenamed("scope", "table_name")


def p7_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapsed(statements(spark, d)).withColumnRenamed("scope", "table_name")
