"""Where rows lie: file, block, partition, and the min/max of row groups."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.session import parallelism


def with_location(df: DataFrame) -> DataFrame:
    """Columns for the place of each row of a file scan: loc_file, loc_block, loc_size, loc_partition."""
    m = F.col("_metadata")
    return df.select("*", m["file_name"].alias("loc_file"), m["file_block_start"].alias("loc_block"), m["file_size"].alias("loc_size"), F.spark_partition_id().alias("loc_partition"))


def extent_map(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """file, row_group, n_rows, column, low, high, n_nulls, compressed_bytes: from the Parquet footers only.

    One task per few files; the executors read the footers. The values are shown as text.
    """
    names = sorted(unquote(f) for f in spark.read.parquet(path).inputFiles())  # from the listing: no row is read
    files = spark.createDataFrame([(f,) for f in names], "file string").repartition(max(1, min(len(names), parallelism(spark))))

    def footers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.parse import urlparse

        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for b in parts:
            rows = []
            for f in b["file"]:
                u = urlparse(f)
                if u.scheme in ("", "file"):
                    meta = pq.read_metadata(unquote(u.path))
                else:
                    fs, p = pafs.FileSystem.from_uri(f)
                    meta = pq.read_metadata(p, filesystem=fs)
                for g in range(meta.num_row_groups):
                    rg = meta.row_group(g)
                    for i in range(rg.num_columns):
                        c = rg.column(i)
                        if columns and c.path_in_schema not in columns:
                            continue
                        s = c.statistics
                        has = s is not None and s.has_min_max
                        rows.append((f, g, rg.num_rows, c.path_in_schema, str(s.min) if has else None, str(s.max) if has else None, s.null_count if s is not None else None, c.total_compressed_size))
            yield pd.DataFrame(rows, columns=["file", "row_group", "n_rows", "column", "low", "high", "n_nulls", "compressed_bytes"])

    return files.mapInPandas(footers, "file string, row_group int, n_rows long, column string, low string, high string, n_nulls long, compressed_bytes long")


def foreign_scan(spark: SparkSession, fmt: str, options: dict[str, str], columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A table of another engine or format; the filter and the columns are pushed down as far as the source can."""
    d = spark.read.format(fmt).options(**options).load()
    d = d.filter(where) if where else d
    return d.select(*columns) if columns else d


def with_extents(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The rows of a Parquet folder with the file they are in and the least and greatest value of ``column`` in it, from the footers."""
    x = extent_map(spark, path, [column])
    kind = spark.read.parquet(path).schema[column].dataType.simpleString()
    low, high = F.min(F.col("low").try_cast(kind)), F.max(F.col("high").try_cast(kind))
    files = x.groupBy(F.substring_index("file", "/", -1).alias("loc_file")).agg(low.alias("extent_min"), high.alias("extent_max"))
    return spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("loc_file")).join(files, "loc_file")


def explain_text(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
