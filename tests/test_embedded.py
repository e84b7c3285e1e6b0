"""An embedded database that the executors read, each in a JVM of its own."""

import os
import subprocess
import sys

import pytest

from oxbow.plans import registry
from oxbow.sources.embedded import DRIVER, publish
from oxbow.sources.location import foreign_scan

SCAN = """
import sys
from oxbow.plans import registry
from oxbow.session import build_session
spark = build_session("local-cluster[2,1,1024]", 2, **{"spark.checkpoint.dir": sys.argv[2], "spark.executor.memory": "600m", "spark.driver.memory": "1g"})
registry.queries()["io_jdbc_scan"](spark, sys.argv[1]).repartition(4).write.parquet(sys.argv[3])
"""


def test_scan_by_other_jvms(spark, sf, duck, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": repo}
    for name in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET"):
        env.pop(name, None)
    run = subprocess.run([sys.executable, "-c", SCAN, sf, f"file://{tmp_path}/shared folder", f"{tmp_path}/out"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, [x for x in run.stderr.splitlines() if "Caused by" in x]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(duck.execute(registry.oracle_sql()["io_jdbc_scan"]).fetchall())


def test_values_survive(spark):
    rows = [(1, "", None, 0.1 + 0.2), (2, None, 3, 1e-300), (None, 'a"b,\'c\nd\r\ne\\', 5, 1.7976931348623157e308), (1 << 62, " ö\U0001f600 ", -(1 << 31), None), (1, "", None, 0.1 + 0.2)]
    df = spark.createDataFrame(rows, "k bigint, name string, n int, v double").repartition(3)
    for t in (df, df.limit(0)):
        got = foreign_scan(spark, "jdbc", {"url": publish(t, "t"), "dbtable": "t", "driver": DRIVER})
        assert got.schema.simpleString() == df.schema.simpleString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, t.collect()))


def test_folder_must_be_mounted(spark, monkeypatch):
    monkeypatch.setattr("oxbow.sources.storage.ensure_checkpoint_dir", lambda s: "hdfs://host/shared")
    with pytest.raises(ValueError, match="mounted"):
        publish(spark.range(1), "t")
