"""Loads with errors, table rules, generations."""

import pytest

from oxbow.plans.relational import checked_broadcast
from oxbow.sources.delimited import LoadColumn, TooManyErrors, bulk_load, read_delimited
from oxbow.sources.location import explain_text
from oxbow.sources.tables import ColumnSpec, ConflictError, ConstraintError, Table


def test_delimited_rules(spark, tmp_path):
    (tmp_path / "in.tbl").write_text('1|"a|b"|2.5\n2|\\N|x\n|c|1\n4|long text|1\n5|d\n6|e||\n7||\n')
    spec = [LoadColumn("k", "int", not_null=True), LoadColumn("s", length=4), LoadColumn("v", "double", default="0")]
    rows, bad = read_delimited(spark, str(tmp_path / "in.tbl"), spec)
    assert sorted((r["k"], r["s"] or "", r["v"]) for r in rows.collect()) == [(1, "a|b", 2.5), (4, "long", 1.0), (7, "", 0.0)]
    assert sorted(r["reason"] for r in bad.collect()) == ["fields", "fields", "null in k", "type of v"]
    strict = read_delimited(spark, str(tmp_path / "in.tbl"), spec, strict=True)[1]
    assert "length of s" in {r["reason"] for r in strict.collect()}
    with pytest.raises(TooManyErrors):
        bulk_load(spark, str(tmp_path / "in.tbl"), spec, str(tmp_path / "out"), str(tmp_path / "bad"), max_errors=3)
    assert not (tmp_path / "out").exists()
    for stored in (3, 6):  # what this call loaded, not what is there
        assert bulk_load(spark, str(tmp_path / "in.tbl"), spec, str(tmp_path / "out"), str(tmp_path / "bad"), max_errors=4) == (3, 4)
        assert spark.read.parquet(str(tmp_path / "out")).count() == stored
    assert sorted(p.name for p in (tmp_path / "bad").iterdir() if p.is_dir()) == ["reason=fields", "reason=null in k", "reason=type of v"]


def test_empty_input(spark, tmp_path):
    (tmp_path / "none.tbl").write_text("")
    rows, bad = read_delimited(spark, str(tmp_path / "none.tbl"), [LoadColumn("k", "int")])
    assert rows.count() == 0 and bad.count() == 0


def make(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), [ColumnSpec("k", "int", not_null=True), ColumnSpec("v", "int", default="7"), ColumnSpec("p", "string")], ["p"], checks=["v < 100"], unique=[["k"]])
    t.insert(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, p string"))
    return t


def test_table_rules(spark, tmp_path):
    t = make(spark, tmp_path)
    before = t.meta.generation
    for bad in ([(None, 1, "a")], [(9, 100, "a")], [(1, 1, "a")]):
        with pytest.raises(ConstraintError):
            t.insert(spark.createDataFrame(bad, "k int, v int, p string"))
    assert t.meta.generation == before and t.df().count() == 3
    assert {r["v"] for r in t.df().collect()} == {7}
    again = Table(spark, str(tmp_path / "t"))
    again.update({"v": "v + 1"}, "k > 1")
    again.delete("v = 7")
    assert sorted(r["k"] for r in again.df().collect()) == [2, 3]
    again.rollback()
    assert again.df().count() == 3
    again.vacuum()
    with pytest.raises(ValueError):
        again.rollback()
    again.truncate()
    assert again.df().count() == 0
    with pytest.raises(FileExistsError):
        Table.create(spark, str(tmp_path / "t"), [])
    again.drop()
    with pytest.raises(FileNotFoundError):
        Table(spark, str(tmp_path / "t"))


def test_generations(spark, tmp_path):
    """Changes write what changed; a rollback is whole; of two writers one fails."""
    t = make(spark, tmp_path)
    first = t.meta.generation
    data = lambda: {str(p) for p in (tmp_path / "t" / "data").rglob("*.parquet")}
    had = data()
    t.insert(spark.createDataFrame([(4, "a")], "k int, p string").coalesce(1))
    assert len(data() - had) == 1 and had <= data()
    had = data()
    t.drop_partitions("p=a")
    t.disable_partitions("p=null")
    t.add_column(ColumnSpec("note", "string"))
    t.drop_column("v")
    assert data() == had and t.df().columns == ["k", "p", "note"]
    assert [r["k"] for r in t.df().collect()] == [2]
    for _ in range(4):
        t.rollback()
    assert t.df().columns == ["k", "v", "p"] and sorted(r["k"] for r in t.df().collect()) == [1, 2, 3, 4]
    t.delete("k = 4")
    assert data() == had  # the file with nothing left has no successor
    old = Table(spark, t.path, generation=first)
    assert sorted(r["k"] for r in old.df().collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        old.truncate()
    other = Table(spark, t.path)
    t.set_default("v", "8")
    with pytest.raises(ConflictError):
        other.insert(spark.createDataFrame([(9, "z")], "k int, p string"))
    assert Table(spark, t.path).df().filter("k = 9").count() == 0
    t.add_column(ColumnSpec("w", "int", default="5"))
    t.drop_column("w")
    t.add_column(ColumnSpec("w", "int"))  # no value of the dropped column comes back
    assert {r["w"] for r in t.df().collect()} == {None}
    t.vacuum()
    assert Table(spark, t.path).df().count() == 3


def test_transactions(spark, tmp_path):
    t = make(spark, tmp_path)
    g = t.meta.generation
    with t.transaction():
        t.insert(spark.createDataFrame([(7, "c")], "k int, p string"))
        t.update({"v": "v + 1"}, "k = 7")
        assert Table(spark, t.path).df().count() == 3  # nobody else sees it yet
    assert t.meta.generation == g + 1 and {r["v"] for r in t.df().filter("k = 7").collect()} == {8}
    with pytest.raises(ConstraintError), t.transaction():
        t.delete("k = 1")
        t.insert(spark.createDataFrame([(7, "c")], "k int, p string"))
    assert Table(spark, t.path).df().count() == t.df().count() == 4


def test_foreign_key_and_rename(spark, tmp_path):
    t = make(spark, tmp_path)
    u = Table.create(spark, str(tmp_path / "u"), [ColumnSpec("id", "int"), ColumnSpec("k", "int")])
    u.insert(spark.createDataFrame([(1, 1), (2, None)], "id int, k int"))
    u.add_foreign_key(["k"], t.path, ["k"])
    with pytest.raises(ConstraintError):
        u.insert(spark.createDataFrame([(3, 99)], "id int, k int"))
    u.insert(spark.createDataFrame([(3, 3)], "id int, k int"))
    u.rename_to(str(tmp_path / "w"))
    assert Table(spark, str(tmp_path / "w")).df().count() == 3


def test_partitions(spark, tmp_path):
    t = make(spark, tmp_path)
    t.disable_partitions("p=a")
    assert sorted(r["k"] for r in t.df().collect()) == [2, 3]
    assert {r["part"]: r["enabled"] for r in t.partitions().collect()} == {"p=a": False, "p=b": True, "p=null": True}
    t.enable_partitions("p=a")
    assert t.drop_by_value("k", 2, 2) == ["p=b"]
    assert sorted(r["k"] for r in t.df().collect()) == [1, 3]


def test_pushdown_and_checked_broadcast(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    plan = explain_text(df.filter("o_totalprice > 400000").select("o_orderkey"))
    assert "GreaterThan(o_totalprice,400000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
    assert checked_broadcast(df, bound=1) is df
    assert checked_broadcast(df) is not df
