"""A scratch folder that all executors share, and file-system calls that work on any Hadoop file system."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from oxbow.session import ensure_checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/oxbow-{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def move(spark: SparkSession, a: str, b: str) -> None:
    pa, fs = _path(spark, a)
    pb, _ = _path(spark, b)
    if not fs.rename(pa, pb):
        raise OSError(f"can't move {a} to {b}")


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile())


def files_below(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Paths, relative to the folder, of all data files below it whose name begins with the prefix."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    root, out = fs.makeQualified(p).toUri().getPath(), []
    it = fs.listFiles(p, True)
    while it.hasNext():
        at = it.next().getPath()
        name = at.getName()
        if name.startswith(prefix) and name[0] not in "._":
            out.append(at.toUri().getPath()[len(root) :].lstrip("/"))
    return sorted(out)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file; what was there is replaced by one rename, so readers find the old text or the new one."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    p, fs = _path(spark, tmp)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    options = jvm.org.apache.hadoop.fs.Options.Rename
    kinds = gateway.new_array(options, 1)
    kinds[0] = options.OVERWRITE
    target, _ = _path(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(p), fs.makeQualified(target), kinds)


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that must not be there yet; false if it is, or if another writer was first.

    Written aside and put in place by a rename that doesn't overwrite: whoever sees the file sees all of it.
    """
    tmp = f"{path}.{uuid.uuid4().hex}.new"
    p, fs = _path(spark, tmp)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    options = jvm.org.apache.hadoop.fs.Options.Rename
    kinds = gateway.new_array(options, 1)
    kinds[0] = options.NONE
    target, _ = _path(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(p), fs.makeQualified(target), kinds)
    except Py4JJavaError as e:
        fs.delete(p, False)
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    reader = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(fs.open(p)))
    lines = []
    while (line := reader.readLine()) is not None:
        lines.append(line)
    reader.close()
    return "\n".join(lines)
