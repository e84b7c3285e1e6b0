"""Scalar functions on literals: week modes, formats, reading of dates, nulls and ranges."""

import datetime

import pytest
from pyspark.sql import functions as F

from oxbow.functions import formats
from oxbow.functions.sqlfuncs import register


@pytest.fixture(scope="module")
def one(spark):
    register(spark)
    return lambda expr: spark.sql(f"SELECT {expr} AS v").first()["v"]


def week(d, mode):
    """The week number by counting days, for comparison."""
    monday, four, own = mode in (1, 3, 5, 7), mode in (1, 3, 4, 6), mode in (2, 3, 6, 7)
    start = lambda x: x - datetime.timedelta(days=x.weekday() if monday else (x.weekday() + 1) % 7)

    def first(y):
        s = start(datetime.date(y, 1, 1))
        in_year = sum((s + datetime.timedelta(days=i)).year == y for i in range(7))
        return s if in_year == 7 or (four and in_year >= 4) else s + datetime.timedelta(days=7)

    y = d.year
    if own:
        y = y - 1 if d < first(y) else y + 1 if d >= first(y + 1) else y
    elif d < first(y):
        return y, 0
    return y, (d - first(y)).days // 7 + 1


def test_weeks(spark):
    register(spark)
    days = [datetime.date(y, 1, 1) + datetime.timedelta(days=o) for y in range(1999, 2014) for o in (*range(0, 12), 100, *range(355, 366))]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", *[F.expr(f"ox_week(d, {m})").alias(f"w{m}") for m in range(8)], *[F.expr(f"ox_yearweek(d, {m})").alias(f"y{m}") for m in (2, 3)]).collect()
    for r in got:
        for m in range(8):
            assert r[f"w{m}"] == week(r["d"], m)[1], (r["d"], m)
        for m in (2, 3):
            y, w = week(r["d"], m)
            assert r[f"y{m}"] == y * 100 + w


#: Input, format and (year, month, day, hour, minute, second, microsecond); None: no match.
READ = [
    ("2009", "%Y", (2009, 0, 0, 0, 0, 0, 0)), ("     2009", "  %Y", (2009, 0, 0, 0, 0, 0, 0)), ("jan", "%b", (0, 1, 0, 0, 0, 0, 0)), ("2009feb", "%Y%b", (2009, 2, 0, 0, 0, 0, 0)),
    ("  2009    ApR", " %Y %b", (2009, 4, 0, 0, 0, 0, 0)), ("200910", "%Y%m", (2009, 10, 0, 0, 0, 0, 0)), ("  2009    10", " %Y %c", (2009, 10, 0, 0, 0, 0, 0)),
    ("01,5,2013", "%d,%m,%Y", (2013, 5, 1, 0, 0, 0, 0)), ("7,5th,2012", "%m,%D,%Y", (2012, 7, 5, 0, 0, 0, 0)), ("a09:30:17", "a%h:%i", (0, 0, 0, 9, 30, 0, 0)), ("a09:30:17", "%h:%i", None),
    ("9:30.170", "%h:%i.%f", (0, 0, 0, 9, 30, 0, 170000)), ("178546 17", "%f  %H", (0, 0, 0, 17, 0, 0, 178546)), ("2009march415", "%Y%b", (2009, 3, 0, 0, 0, 0, 0)), ("09  pm", "%h %p", (0, 0, 0, 21, 0, 0, 0)),
    ("09:13:14pm", "%r", (0, 0, 0, 21, 13, 14, 0)), ("12:13:14am", "%r", (0, 0, 0, 0, 13, 14, 0)), ("92", "    %Y", (1992, 0, 0, 0, 0, 0, 0)), ("9", "    %Y", (2009, 0, 0, 0, 0, 0, 0)),
    ("2013 31", "%Y %j", (2013, 1, 31, 0, 0, 0, 0)), ("2013 1 3", "%Y %U %w", (2013, 1, 9, 0, 0, 0, 0)), ("2007 1 3", "%Y %U %w", (2007, 1, 10, 0, 0, 0, 0)), ("2007 1 3", "%Y %u %w", (2007, 1, 3, 0, 0, 0, 0)),
    ("2013 1 3", "%X %V %w", (2013, 1, 9, 0, 0, 0, 0)), ("2007 1 3", "%X %v %w", (2007, 1, 3, 0, 0, 0, 0)), ("33:30.170", "%h:%i.%f", None), ("01,25,2013", "%d,%m,%Y", None),
    ("%09:30:17", "%%%h:%i:%s", (0, 0, 0, 9, 30, 17, 0)), ("2009 foobar", "%Y", (2009, 0, 0, 0, 0, 0, 0)), ("2009-12-31", "%h:%i:%s %p", None), ("12:00:01 AM", "%h:%i:%s %p", (0, 0, 0, 0, 0, 1, 0)),
    ("11:00:01 PM", "%h:%i:%s %p", (0, 0, 0, 23, 0, 1, 0)), ("10000-01-02", "%Y:%m:%d", None), (None, "%Y", None),
]


@pytest.mark.parametrize("text,fmt,want", READ)
def test_str_to_date(spark, text, fmt, want):
    register(spark)
    df = spark.createDataFrame([(text,)], "s string")
    got = df.select(formats.str_to_date_parts(F.col("s"), fmt).alias("v")).first()["v"]
    assert (tuple(got) if got is not None else None) == want


CASES = [
    ("ox_ascii('')", 0), ("ox_ascii('é')", 195), ("ox_char(-1)", None), ("ox_char(65)", "A"), ("ox_char(16706)", "AB"),
    ("ox_concat_ws(',', array(NULL, NULL))", None), ("ox_concat_ws(NULL, array('a'))", None), ("ox_concat_ws(',', array('', 'a', '', 'b'))", "a,,b"),
    ("ox_conv('ff', 16, 10)", "255"), ("ox_conv('ff', 1, 10)", None), ("ox_conv('', 16, 10)", None), ("ox_elt(1.5, array('a', 'b'))", "b"), ("ox_elt(9, array('a'))", None),
    ("ox_find_in_set('b,c', 'a,b')", 0), ("ox_find_in_set('b', 'a,,b')", 2), ("ox_find_in_set(NULL, 'a')", None), ("ox_insert('abc', 0, 1, 'X')", "abc"), ("ox_insert('abc', 2, -1, 'X')", "aX"),
    ("ox_left('abc', -1)", ""), ("ox_lpad('abc', 0, 'x')", ""), ("ox_lpad('abc', 2, 'x')", "ab"), ("ox_trim('ababxab', 'ab')", "x"), ("ox_trim('a.b', '.')", "a.b"), ("ox_ltrim('..a', '.')", "a"),
    ("ox_strcmp('a', NULL)", None), ("ox_substr('abc', 0, 2)", ""), ("ox_substr('abc', -5, 4)", ""), ("ox_substr('abc', -2, 1)", "b"), ("ox_unhex('4g')", None), ("ox_unhex('414')", "\x04\x14"),
    ("ox_inet_aton('10.0.5.9')", 167773449), ("ox_inet_aton('127.1')", 2130706433), ("ox_inet_aton('1.2.3.')", None), ("ox_inet_aton('256.1.1.1')", None), ("ox_inet_ntoa(167773449)", "10.0.5.9"), ("ox_inet_ntoa(NULL)", None),
    ("ox_div(7.5, 2)", 4), ("ox_div(7, 0.4)", None), ("ox_div(-7, 2)", -3), ("ox_mod(7.5, 0.9)", None), ("ox_mod(7.5, 2.9)", 1.5), ("ox_exp(1000)", None), ("ox_pow(-8, 0.5)", None),
    ("ox_truncate(1.155, 2)", 1.15), ("ox_truncate(-1.999, 1)", -1.9), ("ox_truncate(1999, -2)", 1900.0), ("ox_greatest(1, NULL)", None), ("ox_least(2, 1)", 1.0),
    ("ox_makedate(999, 1)", None), ("CAST(ox_makedate(2012, 60) AS STRING)", "2012-02-29"), ("ox_makedate(2012, 0)", None), ("ox_maketime(900, 1, 1)", "838:59:59"), ("ox_maketime(-3, 4, 5)", "-03:04:05"), ("ox_maketime(3, 60, 5)", None),
    ("ox_sec_to_time(-3661)", "-01:01:01"), ("ox_sec_to_time(9999999)", "838:59:59"), ("ox_time_to_sec('01:61:00')", None), ("ox_time_to_sec('-01:01:01')", -3661),
    ("ox_period_add(200801, -1)", 200712), ("ox_period_add(9912, 1)", 200001), ("ox_period_diff(200802, 200703)", 11), ("ox_to_days(DATE '1970-01-01')", 719528), ("ox_regexp('ab1', '[[:digit:]]$')", True),
    ("ox_year_diff(TIMESTAMP_NTZ '2020-12-31 00:00:00', TIMESTAMP_NTZ '2021-12-01 00:00:00')", 1), ("ox_month_diff(TIMESTAMP_NTZ '2020-01-31 00:00:00', TIMESTAMP_NTZ '2020-02-28 00:00:00')", 0),
]


@pytest.mark.parametrize("expr,want", CASES)
def test_function(one, expr, want):
    assert one(expr) == want


def test_date_format(spark):
    register(spark)
    df = spark.createDataFrame([(datetime.datetime(2009, 1, 3, 14, 5, 6, 7),), (None,)], "t timestamp_ntz")
    got = [r["v"] for r in df.select(formats.date_format(F.col("t"), "%a %b %c %D %e %f %j %k %l %r %T %U %u %V %v %X %x %w %y %% q").alias("v")).collect()]
    assert got == ["Sat Jan 1 3rd 3 000007 003 14 2 02:05:06 PM 14:05:06 00 01 52 01 2008 2009 6 09 % q", None]


def test_every_interval_unit(spark):
    df = spark.createDataFrame([(datetime.datetime(2020, 1, 31, 1, 2, 3),)], "t timestamp_ntz")
    units = {**{u: 2 for u in formats.UNITS}, **{u: " ".join("1" for _ in formats.COMPOUND[u]) for u in formats.COMPOUND}}
    there = df.select(*[formats.date_add(F.col("t"), v, u).alias(u) for u, v in units.items()]).first()
    assert there["MONTH"] == datetime.datetime(2020, 3, 31, 1, 2, 3) and there["DAY_SECOND"] == datetime.datetime(2020, 2, 1, 2, 3, 4)
    assert there["SECOND_MICROSECOND"] == datetime.datetime(2020, 1, 31, 1, 2, 4, 100000)
    assert all(x is not None for x in there)


DIALECT = [
    ("SELECT a FROM t LIMIT 5, 10", "SELECT a FROM t LIMIT 10 OFFSET 5"),
    ("SELECT INET_ATON(ip), 'WEEK(d)' FROM t -- WEEK(d)", "SELECT ox_inet_aton(ip), 'WEEK(d)' FROM t -- WEEK(d)"),
    ("SELECT CONCAT_WS(',', ELT(2, 'a', 'b'), x)", "SELECT ox_concat_ws(',', array(ox_elt(2, array('a', 'b')), x))"),
    ("SELECT DATE_SUB(d, INTERVAL 1 MONTH)", "SELECT (d - INTERVAL 1 MONTH)"),
    ("SELECT GREATEST(a, b, c)", "SELECT CASE WHEN (a) IS NULL OR (b) IS NULL OR (c) IS NULL THEN NULL ELSE greatest(a, b, c) END"),
    ("SELECT `left` FROM t WHERE a = 1", "SELECT `left` FROM t WHERE a = 1"),
    ("SELECT a FROM t LEFT JOIN s ON t.a = s.a", "SELECT a FROM t LEFT JOIN s ON t.a = s.a"),
    ("INSERT INTO t (a) VALUES (1)", "INSERT INTO t (a) VALUES (1)"),
]


@pytest.mark.parametrize("text,want", DIALECT)
def test_dialect(text, want):
    from oxbow.functions.dialect import translate

    assert translate(text) == want


def test_dialect_format(one):
    from oxbow.functions.dialect import translate

    assert one(translate("DATE_FORMAT(TIMESTAMP_NTZ '2009-01-03 14:05:06', '%a %D %M %Y, %k:%i %% it''s %u/%x')")) == "Sat 3rd January 2009, 14:05 % it''s 01/2009"
