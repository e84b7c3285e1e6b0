"""Every core query with an SQL twin gives the twin's rows; the others run."""

import pytest

from oxbow.plans import registry
from tests.compare import duck_rows, spark_rows

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def test_twins_have_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    want = duck_rows(duck, ORACLE[name])
    assert sorted(df.columns) == sorted(d[0] for d in duck.execute(ORACLE[name]).description)
    assert spark_rows(df) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    rows = df.count()
    assert df.columns and rows > 0, "no rows: nothing was tested"


def test_outliers_of_empty_tables(spark, tmp_path, sf):
    """All ten problems' core queries on tables without rows."""
    for t in ("processlog", "stackslog", "sysmodules"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for q in ("p2_found", "p3_found", "p5_found"):
        assert QUERIES[q](spark, str(tmp_path)).count() == 0


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
