"""Bulk load of delimited text, with a column specification and rejected rows."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.session import ensure_checkpoint_dir
from oxbow.sources import storage

RAW = "__raw"


@dataclass(frozen=True)
class LoadColumn:
    """A column of the input: its type, whether it is read but not kept, its default for empty fields, its rules.

    ``length``: the most characters of a text; a longer one is cut, or rejected with ``strict`` loads.
    """

    name: str
    type: str = "string"
    ignore: bool = False
    default: str | None = None
    not_null: bool = False
    length: int | None = None


class TooManyErrors(ValueError):
    """More rows were rejected than the load allows."""


def parse_delimited(
    spark: SparkSession, path: str, columns: list[LoadColumn], extra: dict[str, str] | None = None, delimiter: str = "|", enclosed_by: str = '"', escape: str = "\\",
    null_text: str = "\\N", strict: bool = False,
) -> DataFrame:
    """All lines of text files: the kept columns, ``extra`` columns with their constant, __reason (null: a good row) and __line (of a rejected one).

    A row is rejected if it has the wrong number of fields, a field that isn't of its type, null where
    a rule forbids it, or (strict) too long a text.
    """
    schema = ", ".join(f"`{c.name}` string" for c in columns) + f", `{RAW}` string"
    # a line's field count shows only if all its fields are parsed
    raw = spark.read.option("columnPruning", False).csv(path, schema=schema, sep=delimiter, quote=enclosed_by, escape=escape, mode="PERMISSIVE", columnNameOfCorruptRecord=RAW, nullValue=null_text, ignoreLeadingWhiteSpace=False, enforceSchema=True)
    reason: Column = F.when(F.col(RAW).isNotNull(), F.lit("fields"))
    made: list[Column] = []
    for c in columns:
        text = F.col(c.name)
        if c.default is not None:
            text = F.coalesce(F.nullif(text, F.lit("")), F.lit(c.default))
        value = text if c.type == "string" else F.nullif(F.trim(text), F.lit("")).try_cast(c.type)
        if c.type != "string":
            reason = reason.when(F.nullif(F.trim(text), F.lit("")).isNotNull() & value.isNull(), F.lit(f"type of {c.name}"))
        if c.length is not None:
            if strict:
                reason = reason.when(F.length(text) > c.length, F.lit(f"length of {c.name}"))
            value = F.left(value, F.lit(c.length))
        if c.not_null:
            reason = reason.when(value.isNull(), F.lit(f"null in {c.name}"))
        if not c.ignore:
            made.append(value.alias(c.name))
    line = F.coalesce(RAW, F.concat_ws(delimiter, *[F.col(c.name) for c in columns]))
    return raw.select(*made, *[F.lit(v).alias(k) for k, v in (extra or {}).items()], reason.alias("__reason"), F.when(reason.isNotNull(), line).alias("__line"))


def _split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = parsed.filter(F.col("__reason").isNull()).drop("__reason", "__line")
    return rows, parsed.filter(F.col("__reason").isNotNull()).select(F.col("__reason").alias("reason"), F.col("__line").alias("line"))


def read_delimited(spark: SparkSession, path: str, columns: list[LoadColumn], **options) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of text files, see ``parse_delimited``; rejects carry the reason and the line. Both are lazy."""
    return _split(parse_delimited(spark, path, columns, **options))


def bulk_load(spark: SparkSession, path: str, columns: list[LoadColumn], target: str, rejects_to: str, max_errors: int = 10, **options) -> tuple[int, int]:
    """Load into the Parquet folder ``target``; (rows loaded by this call, rows rejected). Too many rejects load nothing.

    The text is parsed once, to a checkpoint that both outputs are read from. Rejects go to ``rejects_to``, a folder
    for each reason, also if nothing is loaded.
    """
    ensure_checkpoint_dir(spark)
    parsed = parse_delimited(spark, path, columns, **options).checkpoint()
    counts = parsed.agg(F.count("__reason").alias("bad"), F.count(F.lit(1)).alias("n")).first()
    rows, rejects = _split(parsed)
    rejects.write.mode("overwrite").partitionBy("reason").parquet(rejects_to)
    if counts["bad"] > max_errors:
        raise TooManyErrors(f"{counts['bad']} rows rejected, {max_errors} allowed; see {rejects_to}")
    rows.write.mode("append").parquet(target)
    return counts["n"] - counts["bad"], counts["bad"]


def load_job(spark: SparkSession, job: dict | str, folder: str) -> dict[str, tuple[int, int]]:
    """Run a job: {table: (loaded, rejected)}. ``job`` is a mapping, or the path of a JSON file that holds one.

    ``{"delimiter": ..., "enclosed_by": ..., "escape": ..., "tables": [{"name", "path", "max_errors", "columns": [{"name", "type",
    "ignore", "default", "not_null", "length"}], "extra": {...}}]}``; each table goes to ``folder/name``, its rejects to ``folder/name.bad``.
    """
    if isinstance(job, str):
        text = storage.read_text(spark, job)
        if text is None:
            raise FileNotFoundError(job)
        job = json.loads(text)
    shared = {k: job[k] for k in ("delimiter", "enclosed_by", "escape", "null_text", "strict") if k in job}
    out = {}
    for t in job["tables"]:
        columns = [LoadColumn(**c) for c in t["columns"]]
        out[t["name"]] = bulk_load(spark, t["path"], columns, f"{folder}/{t['name']}", f"{folder}/{t['name']}.bad", t.get("max_errors", 10), extra=t.get("extra"), **shared)
    return out


def write_delimited(df: DataFrame, path: str, delimiter: str = "|", enclosed_by: str = '"', escape: str = "\\", null_text: str = "\\N") -> None:
    """Text files that ``read_delimited`` reads back, one per partition."""
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.csv(path, sep=delimiter, quote=enclosed_by, escape=escape, nullValue=null_text, emptyValue="", mode="overwrite")
