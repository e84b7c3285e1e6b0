"""Scalar functions that Spark lacks or defines otherwise, as SQL functions.

Each is an expression: ``register`` makes temporary SQL functions of them, which Catalyst
inlines, so they run inside whole-stage code generation. In SQL they are called by name
(``ox_inet_aton(ip)``), in the DataFrame API through ``call``. None raises on bad input:
where the warehouse gives NULL, so do these.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: name: (parameters, result type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    # strings
    "ascii": ("s STRING", "INT", "CASE WHEN s = '' THEN 0 ELSE CAST(conv(substring(hex(s), 1, 2), 16, 10) AS INT) END"),
    "char": ("n BIGINT", "STRING", "CASE WHEN n < 0 THEN NULL ELSE decode(unhex(lpad(hex(n), CAST(2 * ceil(length(hex(n)) / 2) AS INT), '0')), 'UTF-8') END"),
    "concat_ws": ("d STRING, a ARRAY<STRING>", "STRING",
                  "CASE WHEN d IS NULL THEN NULL ELSE nullif(aggregate(a, '', (acc, x) -> CASE WHEN x IS NULL THEN acc WHEN acc = '' THEN x ELSE concat(acc, d, x) END), '') END"),
    "conv": ("s STRING, f INT, t INT", "STRING", "CASE WHEN s = '' OR abs(f) NOT BETWEEN 2 AND 36 OR abs(t) NOT BETWEEN 2 AND 36 THEN NULL ELSE conv(s, abs(f), t) END"),
    "elt": ("n DOUBLE, a ARRAY<STRING>", "STRING", "get(a, CAST(round(n) AS INT) - 1)"),
    "find_in_set": ("s STRING, csv STRING", "INT",
                    "CASE WHEN s IS NULL OR csv IS NULL THEN NULL WHEN instr(s, ',') > 0 THEN 0 ELSE CAST(array_position(filter(split(csv, ','), x -> x <> ''), s) AS INT) END"),
    "hex_number": ("x DOUBLE", "STRING", "hex(CAST(round(x) AS BIGINT))"),
    "insert": ("s STRING, pos INT, n INT, r STRING", "STRING",
               "CASE WHEN pos < 1 OR pos > length(s) + 1 THEN s WHEN n < 0 OR n > length(s) THEN concat(left(s, pos - 1), r) ELSE overlay(s PLACING r FROM pos FOR n) END"),
    "left": ("s STRING, n INT", "STRING", "CASE WHEN n < 1 THEN '' ELSE left(s, n) END"),
    "right": ("s STRING, n INT", "STRING", "CASE WHEN n < 1 THEN '' ELSE right(s, n) END"),
    "lpad": ("s STRING, n DOUBLE, p STRING", "STRING", "CASE WHEN n < 1 THEN '' ELSE lpad(s, CAST(round(n) AS INT), p) END"),
    "rpad": ("s STRING, n DOUBLE, p STRING", "STRING", "CASE WHEN n < 1 THEN '' ELSE rpad(s, CAST(round(n) AS INT), p) END"),
    "quote_regex": ("p STRING", "STRING", r"concat('\\Q', replace(p, '\\E', '\\E\\\\E\\Q'), '\\E')"),
    "ltrim": ("s STRING, p STRING", "STRING", "CASE WHEN p = '' THEN s ELSE regexp_replace(s, concat('^(?:', ox_quote_regex(p), ')+'), '') END"),
    "rtrim": ("s STRING, p STRING", "STRING", "CASE WHEN p = '' THEN s ELSE regexp_replace(s, concat('(?:', ox_quote_regex(p), ')+$'), '') END"),
    "trim": ("s STRING, p STRING", "STRING", "ox_rtrim(ox_ltrim(s, p), p)"),
    "regexp": ("s STRING, p STRING", "BOOLEAN",
               r"s RLIKE replace(replace(replace(replace(replace(replace(replace(replace(p, '[:alpha:]', '\\p{Alpha}'), '[:digit:]', '\\p{Digit}'), '[:alnum:]', '\\p{Alnum}'), '[:upper:]', '\\p{Upper}'), '[:lower:]', '\\p{Lower}'), '[:space:]', '\\p{Space}'), '[:punct:]', '\\p{Punct}'), '[:xdigit:]', '\\p{XDigit}')"),
    "strcmp": ("a STRING, b STRING", "INT", "CASE WHEN a < b THEN -1 WHEN a > b THEN 1 WHEN a = b THEN 0 END"),
    "substr": ("s STRING, pos INT, n INT", "STRING", "CASE WHEN pos = 0 OR abs(pos) > length(s) OR n < 1 THEN '' ELSE substring(s, pos, n) END"),
    "unhex": ("s STRING", "STRING", "CASE WHEN s RLIKE '^[0-9A-Fa-f]*$' THEN decode(unhex(s), 'UTF-8') END"),
    "inet_aton": ("ip STRING", "BIGINT", "ox_inet_parts(split(ip, '[.]'))"),
    "inet_parts": ("p ARRAY<STRING>", "BIGINT", """CASE WHEN size(p) NOT BETWEEN 1 AND 4 OR exists(p, x -> NOT x RLIKE '^[0-9]{1,9}$') THEN NULL
  WHEN exists(p, x -> try_cast(x AS BIGINT) > 255) THEN NULL
  ELSE CASE WHEN size(p) > 1 THEN shiftleft(try_cast(get(p, 0) AS BIGINT), 24) ELSE 0 END + CASE WHEN size(p) > 2 THEN shiftleft(try_cast(get(p, 1) AS BIGINT), 16) ELSE 0 END
     + CASE WHEN size(p) > 3 THEN shiftleft(try_cast(get(p, 2) AS BIGINT), 8) ELSE 0 END + try_cast(get(p, size(p) - 1) AS BIGINT) END"""),
    "inet_ntoa": ("n BIGINT", "STRING",
                  "CASE WHEN n IS NULL THEN NULL ELSE concat_ws('.', shiftright(n, 24) & 255, shiftright(n, 16) & 255, shiftright(n, 8) & 255, n & 255) END"),
    # numbers
    "div": ("a DECIMAL(38,10), b DECIMAL(38,10)", "BIGINT", "CASE WHEN round(b) = 0 THEN NULL ELSE CAST(round(a) AS BIGINT) DIV CAST(round(b) AS BIGINT) END"),
    "mod": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN CAST(b AS BIGINT) = 0 THEN NULL ELSE a % CAST(b AS BIGINT) END"),
    "exp": ("x DOUBLE", "DOUBLE", "CASE WHEN exp(x) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE exp(x) END"),
    "pow": ("x DOUBLE, y DOUBLE", "DOUBLE", "CASE WHEN isnan(pow(x, y)) OR abs(pow(x, y)) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE pow(x, y) END"),
    "truncate": ("x DOUBLE, d INT", "DOUBLE", """CASE WHEN d >= 18 OR (d >= 0 AND abs(x) >= 1e15) THEN x WHEN d < -18 THEN 0
  ELSE sign(x) * CAST(CAST(abs(x) AS DECIMAL(38,18)) - CAST(abs(x) AS DECIMAL(38,18)) % CAST(pow(10, -d) AS DECIMAL(38,18)) AS DOUBLE) END"""),
    "sign": ("x DOUBLE", "BIGINT", "CAST(sign(x) AS BIGINT)"),
    "greatest": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE greatest(a, b) END"),
    "least": ("a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE least(a, b) END"),
    # dates and times
    "dayname": ("d DATE", "STRING", "date_format(d, 'EEEE')"),
    "monthname": ("d DATE", "STRING", "date_format(d, 'MMMM')"),
    "to_days": ("d DATE", "BIGINT", "CAST(datediff(d, DATE '1970-01-01') AS BIGINT) + 719528"),
    "from_days": ("n INT", "DATE", "date_add(DATE '1970-01-01', n - 719528)"),
    "makedate": ("y DOUBLE, n DOUBLE", "DATE", "CASE WHEN round(y) BETWEEN 1000 AND 9999 AND round(n) >= 1 THEN date_add(make_date(CAST(round(y) AS INT), 1, 1), CAST(round(n) AS INT) - 1) END"),
    "maketime": ("h INT, m INT, s INT", "STRING", """CASE WHEN m NOT BETWEEN 0 AND 59 OR s NOT BETWEEN 0 AND 59 THEN NULL WHEN abs(h) > 838 THEN CASE WHEN h < 0 THEN '-838:59:59' ELSE '838:59:59' END
  ELSE concat(CASE WHEN h < 0 THEN '-' ELSE '' END, lpad(abs(h), greatest(2, length(abs(h))), '0'), ':', lpad(m, 2, '0'), ':', lpad(s, 2, '0')) END"""),
    "microsecond": ("t TIMESTAMP_NTZ", "INT", "CAST(date_format(t, 'SSSSSS') AS INT)"),
    "sec_to_time": ("x DOUBLE", "STRING", """CASE WHEN abs(round(x)) > 3020399 THEN CASE WHEN x < 0 THEN '-838:59:59' ELSE '838:59:59' END
  ELSE concat(CASE WHEN round(x) < 0 THEN '-' ELSE '' END, ox_hms(abs(CAST(round(x) AS BIGINT)))) END"""),
    "hms": ("n BIGINT", "STRING", "concat(lpad(n DIV 3600, greatest(2, length(n DIV 3600)), '0'), ':', lpad(n DIV 60 % 60, 2, '0'), ':', lpad(n % 60, 2, '0'))"),
    "time_to_sec": ("s STRING", "BIGINT", """CASE WHEN s RLIKE '^-?[0-9]{1,3}:[0-5]?[0-9]:[0-5]?[0-9]$' THEN
  CASE WHEN s LIKE '-%' THEN -1 ELSE 1 END * (try_cast(replace(get(split(s, ':'), 0), '-', '') AS BIGINT) * 3600 + try_cast(get(split(s, ':'), 1) AS BIGINT) * 60 + try_cast(get(split(s, ':'), 2) AS BIGINT)) END"""),
    "timediff": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "STRING", "ox_sec_to_time(CAST(timestampdiff(SECOND, b, a) AS DOUBLE))"),
    "addtime": ("t TIMESTAMP_NTZ, s STRING, direction INT", "TIMESTAMP_NTZ", "t + make_dt_interval(0, 0, 0, CAST(direction * ox_time_to_sec(s) AS DECIMAL(18,6)))"),
    "period_year": ("p INT", "INT", "CASE WHEN p DIV 100 < 70 THEN p DIV 100 + 2000 WHEN p DIV 100 < 100 THEN p DIV 100 + 1900 ELSE p DIV 100 END"),
    "period_months": ("p INT", "INT", "ox_period_year(p) * 12 + p % 100 - 1"),
    "period_add": ("p INT, n INT", "INT", "(ox_period_months(p) + n) DIV 12 * 100 + (ox_period_months(p) + n) % 12 + 1"),
    "period_diff": ("a INT, b INT", "INT", "ox_period_months(a) - ox_period_months(b)"),
    # weeks: a year's week 1 begins on the week start at or before 4 January (modes 1 3 4 6) or on the first week start of the year (0 2 5 7)
    "week_start": ("d DATE, m INT", "DATE", "date_sub(d, CASE WHEN m % 2 = 1 THEN weekday(d) ELSE (weekday(d) + 1) % 7 END)"),
    "week_one": ("y INT, m INT", "DATE", "ox_week_start(make_date(y, 1, CASE WHEN m IN (1, 3, 4, 6) THEN 4 ELSE 7 END), m)"),
    "week_year": ("d DATE, m INT", "INT", "CASE WHEN d < ox_week_one(year(d), m) THEN year(d) - 1 WHEN d >= ox_week_one(year(d) + 1, m) THEN year(d) + 1 ELSE year(d) END"),
    "week_of_own_year": ("d DATE, m INT", "INT", "datediff(d, ox_week_one(ox_week_year(d, m), m)) DIV 7 + 1"),
    "week": ("d DATE, m INT", "INT", "CASE WHEN m IN (2, 3, 6, 7) THEN ox_week_of_own_year(d, m) WHEN d < ox_week_one(year(d), m) THEN 0 ELSE datediff(d, ox_week_one(year(d), m)) DIV 7 + 1 END"),
    "yearweek": ("d DATE, m INT", "INT", "ox_week_year(d, m) * 100 + ox_week_of_own_year(d, m)"),
    # whole months or years between, by the calendar
    "year_diff": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", "CAST(((year(b) * 12 + month(b)) - (year(a) * 12 + month(a))) DIV 12 AS BIGINT)"),
    "month_diff": ("a TIMESTAMP_NTZ, b TIMESTAMP_NTZ", "BIGINT", """CAST((year(b) * 12 + month(b)) - (year(a) * 12 + month(a))
  - CASE WHEN b >= a AND day(b) < day(a) THEN 1 WHEN b < a AND day(b) > day(a) THEN -1 ELSE 0 END AS BIGINT)"""),
}

DONE = "oxbow.functions.registered"


def register(spark: SparkSession) -> None:
    """Create the temporary functions ``ox_<name>`` in the session; once is enough."""
    if spark.conf.get(DONE, "") == "yes":
        return
    todo = dict(FUNCTIONS)
    while todo:  # those that others call first
        for name in [n for n, (_, _, body) in todo.items() if not any(f"ox_{o}(" in body for o in todo)]:
            params, result, body = todo.pop(name)
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ox_{name}({params}) RETURNS {result} RETURN {body}")
    spark.conf.set(DONE, "yes")


def call(name: str, *args: Column | str) -> Column:
    """The registered function ``name`` applied to columns."""
    return F.call_function(f"ox_{name}", *[F.col(a) if isinstance(a, str) else a for a in args])
