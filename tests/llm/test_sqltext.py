"""Canonical forms and missing ends of statements."""

import pytest

from oxbow.llm.sqltext import canonical, end_missing, strip_marker

SAME = [
    ("select a, b from t where x = 1 and y = 'u v'", "SELECT b,a\nFROM `t`  WHERE (Y=\"U V\") AND (x=1);"),
    ("insert into t (a, b) values (1, 'x')", "INSERT INTO t(b,a) VALUES('x',1)"),
    ("insert into t (a, b) values (1, 2), (3, 4)", "insert into t (b, a) values (2, 1), (4, 3)"),
    ("update t set a = 1, b = 2 where c between 1 and 2 and d = 3", "update t set b=2,a=1 where d=3 and (c between 1 and 2)"),
    ("select count(*) from t where a <> 1 -- run x", "select count( * ) from t where a < > 1  --  RUN\nX"),
    ("delete from t where (a = 1 and b = 2)", "delete from t where b = 2 and a = 1"),
    ("select a from t where x in (select k, j from s where p = 1 and q = 2)", "select a from t where x in (select j, k from s where q = 2 and p = 1)"),
]
OTHER = [
    ("select a from t where x < 1", "select a from t where x <= 1"),
    ("select a from t where x = 1 and y = 2", "select a from t where x = 2 and y = 1"),
    ("select a, b from t group by a, b", "select a, b from t group by b, a"),
    ("select a from t where x in (1, 2)", "select a from t where x in (2, 1)"),
    ("select a from t order by a, b", "select a from t order by b, a"),
    ("insert into t (a, b) values (1, 2)", "insert into t (a, b) values (2, 1)"),
    ("select a from t where (x = 1 or y = 2) and z = 3", "select a from t where x = 1 or y = 2 and z = 3"),
    ("select a from t where x between 1 and 5", "select a from t where x between 5 and 1"),
    ("select a from t, s", "select a from s, t"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert canonical(a) != canonical(b)


WHOLE = [
    "commit", "select 1", "select now()", "select current_date", "select a, count(*) from t where x = 'it''s' group by a order by a desc limit 5", "select * from t", "set autocommit=0",
    "select a from t x, s y where x.a = y.b and y.c in (1, 2);", "insert into t (a, b) values (1, 'x')", "insert into t (a) values (1), (2)", "update t set a = 1, b = b + 1 where c is not null",
    "delete from t where a between 1 and 2", "load data infile '/x' into table t fields terminated by '|'", "select max(a) from t", "select sum(a) from t where b = c * 2", "show tables from mart", "select a from t -- run x",
    "select a, sum(b) from t group by a order by sum(b)", "select distinct a from t where b like 'x%'", "",
]
CUT = [
    "select a from t where", "select a from t where x =", "select a from t where x = 'ab", "select a from t where x in (1, 2", "select a, count(*) from t where x = 1", "select a, count(*) from t where x = 1 grou",
    "select a, b, count(*) from t group by a", "select a from t where x = 1 and", "select a from t where x = 1 and colum", "select a from t order by a de", "select a from t where x betw", "select a from t where x between 1 and",
    "select a from t where x is not nu", "insert into t (a, b) values (1, 2", "insert into t (a, b) values (1)", "insert into t (a, b)", "update t", "update t se", "delete from t where a", "load data infile '/x' into tab",
    "select a from t f, s d where f.a = d", "select a, b from t order by", "select a from t x where x.a = 1 o", "select fee", "select a from `t", "select a,", "select a from t where x.a = y.b an",
]


@pytest.mark.parametrize("t", WHOLE)
def test_whole(t):
    assert not end_missing(t)


@pytest.mark.parametrize("t", CUT)
def test_cut(t):
    assert end_missing(t)


def test_markers():
    for t in ("select a...", "select a…", "select a ... ", "select a [truncated]", "select a �"):
        assert strip_marker(t) == ("select a" + (" " if "a " in t else ""), True) or strip_marker(t)[1]
    assert strip_marker("select a.b") == ("select a.b", False)


def test_never_raises():
    import random

    rng = random.Random(0)
    bits = ["select", "from", "where", "(", ")", "and", "'", '"', "`", ",", ".", "between", "in", "or", "insert", "values", "set", "order", "by", "--", "x", "1", "=", "...", "é", "\n", "union"]
    for _ in range(4000):
        t = " ".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        canonical(t), end_missing(t), strip_marker(t)
