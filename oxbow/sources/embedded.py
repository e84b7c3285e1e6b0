"""A database that runs inside a JVM, laid out so that every executor can open it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.sources import storage

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"
#: Types that the database names in another way.
KINDS = {"string": "CLOB", "tinyint": "SMALLINT", "float": "REAL"}


def _connect(spark: SparkSession, url: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.derby.jdbc.EmbeddedDriver().connect(url, jvm.java.util.Properties())


def _field(name: str, kind: str) -> Column:
    """A field of an import file: texts are enclosed, so an empty one isn't a null."""
    text = F.col(f"`{name}`").cast("string")
    return F.coalesce(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')) if kind == "string" else text, F.lit(""))


def publish(df: DataFrame, name: str) -> str:
    """The JDBC address of a new database with the rows of ``df`` (numbers, texts, dates) as table ``name``.

    An in-memory database is one JVM's, and one on disk is locked by the first JVM that opens it. So the
    executors write the rows as text, the driver's JVM loads the files, closes the database and packs it into
    one file beside the checkpoints: a packed database is read-only, and any number of JVMs may open it.
    That folder must be mounted, since the database opens files and no other file system.
    """
    spark = df.sparkSession
    at = storage.scratch(spark, "embedded")
    place = urlparse(at)
    if place.scheme not in ("", "file"):
        raise ValueError(f"an embedded database needs a mounted folder that all executors share, not {at}")
    local = unquote(place.path) if place.scheme else at
    df.select(F.concat_ws(",", *[_field(c, kind) for c, kind in df.dtypes])).write.text(f"{at}/rows")
    with tempfile.TemporaryDirectory(prefix="oxbow-db-") as tmp:
        con = _connect(spark, f"jdbc:derby:{tmp}/db;create=true")
        try:
            run = con.createStatement()
            run.execute(f"CREATE TABLE {name} ({', '.join(f'"{c}" {KINDS.get(kind, kind.upper())}' for c, kind in df.dtypes)})")
            load = con.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
            load.setString(1, name.upper())
            for f in storage.files_below(spark, f"{at}/rows", "part-"):
                load.setString(2, f"{local}/rows/{f}")
                load.execute()
        finally:
            con.close()
            try:
                _connect(spark, f"jdbc:derby:{tmp}/db;shutdown=true")
            except Py4JJavaError as e:
                if e.java_exception.getSQLState() != "08006":  # the state of a shutdown that went well
                    raise
        with zipfile.ZipFile(f"{local}/db.jar", "w", zipfile.ZIP_STORED) as z:
            for folder, _, names in os.walk(f"{tmp}/db"):
                for n in names:
                    f = os.path.join(folder, n)
                    z.write(f, os.path.relpath(f, tmp))
    storage.delete(spark, f"{at}/rows")
    return f"jdbc:derby:jar:({local}/db.jar)db"
