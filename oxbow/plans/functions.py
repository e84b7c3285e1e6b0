"""One query per scalar function, over whole tables, with its SQL twin where the oracle has the means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.functions import formats
from oxbow.functions.sqlfuncs import register
from oxbow.plans.sqlrun import from_sql
from oxbow.session import table

P, O, E, C = "FROM part", "FROM orders", "FROM events", "FROM customer"
D = "CAST(o_orderdate AS DATE)"
IP = "concat_ws('.', o_orderkey % 256, o_custkey % 256, o_orderkey % 7, o_custkey % 11)"
Y, M, DD = f"CAST(year({D}) AS BIGINT)", f"CAST(month({D}) AS BIGINT)", f"CAST(day({D}) AS BIGINT)"
PER = f"CAST(year({D}) * 100 + month({D}) AS INT)"

#: name: (expression in Spark, in the oracle's SQL or None for the same, FROM part of both); key columns come with it
FN: dict[str, tuple[str, str | None, str]] = {
    "ascii": ("ox_ascii(p_name)", "ascii(p_name)", P),
    "char": ("ox_char(p_size + 64)", "chr(p_size + 64)", P),
    "char_length": ("char_length(p_name)", "CAST(length(p_name) AS INT)", P),
    "concat": ("concat(p_name, '-', nullif(p_type, 'PROMO'))", "p_name || '-' || nullif(p_type, 'PROMO')", P),
    "concat_ws": ("ox_concat_ws(', ', array('', p_name, nullif(p_type, 'PROMO'), p_brand))", "concat_ws(', ', p_name, nullif(p_type, 'PROMO'), p_brand)", P),
    "conv": ("ox_conv(CAST(p_partkey AS STRING), 10, 2)", "to_base(p_partkey, 2)", P),
    "crc32": ("crc32(CAST(p_name AS BINARY))", None, P),
    "elt": ("ox_elt(CAST(p_size % 5 AS DOUBLE), array('a', 'b', 'c'))", "CASE p_size % 5 WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' END", P),
    "find_in_set": ("ox_find_in_set(p_type, 'SMALL,,LARGE,PROMO')", "CASE p_type WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'PROMO' THEN 3 ELSE 0 END", P),
    "hex_string": ("hex(p_name)", "hex(p_name)", P),
    "hex_number": ("ox_hex_number(p_retailprice)", "hex(CAST(round(p_retailprice) AS BIGINT))", P),
    "insert": ("ox_insert(p_name, 3, 2, 'XYZ')", "left(p_name, 2) || 'XYZ' || substring(p_name, 5)", P),
    "instr": ("instr(p_name, 'e')", "CAST(instr(p_name, 'e') AS INT)", P),
    "locate": ("locate('e', p_name, 4)", "CAST(CASE WHEN instr(substring(p_name, 4), 'e') > 0 THEN instr(substring(p_name, 4), 'e') + 3 ELSE 0 END AS INT)", P),
    "lcase": ("lcase(p_type)", "lower(p_type)", P),
    "left": ("ox_left(p_name, p_size % 6)", "left(p_name, p_size % 6)", P),
    "length": ("octet_length(p_name)", "CAST(strlen(p_name) AS INT)", P),
    "lpad": ("ox_lpad(p_name, 11.6, '*')", "lpad(p_name, 12, '*')", P),
    "ltrim": ("ox_ltrim(concat('abab', p_name), 'ab')", "regexp_replace('abab' || p_name, '^(ab)+', '')", P),
    "regexp": ("ox_regexp(p_brand, '#[[:digit:]]{2}$')", "regexp_matches(p_brand, '#[[:digit:]]{2}$')", P),
    "repeat": ("repeat(p_type, p_size % 4)", None, P),
    "replace": ("replace(p_name, 'e', '3')", None, P),
    "reverse": ("reverse(p_name)", None, P),
    "right": ("ox_right(p_name, p_size % 6)", "right(p_name, p_size % 6)", P),
    "rpad": ("ox_rpad(p_name, 11.6, '*')", "rpad(p_name, 12, '*')", P),
    "rtrim": ("ox_rtrim(concat(p_name, 'abab'), 'ab')", "regexp_replace(p_name || 'abab', '(ab)+$', '')", P),
    "strcmp": ("ox_strcmp(p_name, p_type)", "CASE WHEN p_name < p_type THEN -1 WHEN p_name > p_type THEN 1 ELSE 0 END", P),
    "substr": ("ox_substr(p_name, p_size % 9 - 4, 3)",
               "CASE WHEN p_size % 9 - 4 = 0 OR abs(p_size % 9 - 4) > length(p_name) THEN '' ELSE substring(p_name, CASE WHEN p_size % 9 - 4 < 0 THEN length(p_name) + (p_size % 9 - 4) + 1 ELSE p_size % 9 - 4 END, 3) END", P),
    "substring_index": ("substring_index(c_name, '#', -1)", "split_part(c_name, '#', -1)", C),
    "trim": ("ox_trim(concat('xy', p_name, 'xyxy'), 'xy')", "regexp_replace(regexp_replace('xy' || p_name || 'xyxy', '^(xy)+', ''), '(xy)+$', '')", P),
    "ucase": ("ucase(p_name)", "upper(p_name)", P),
    "unhex": ("ox_unhex(hex(p_name))", "decode(unhex(hex(p_name)))", P),
    "inet_aton": (f"ox_inet_aton({IP})", "CAST((o_orderkey % 256) * 16777216 + (o_custkey % 256) * 65536 + (o_orderkey % 7) * 256 + o_custkey % 11 AS BIGINT)", O),
    "inet_ntoa": ("ox_inet_ntoa(o_orderkey * 7919)", "concat_ws('.', (o_orderkey * 7919) >> 24 & 255, (o_orderkey * 7919) >> 16 & 255, (o_orderkey * 7919) >> 8 & 255, (o_orderkey * 7919) & 255)", O),
    "abs": ("abs(c_acctbal)", None, C),
    "bitand": ("o_orderkey & o_custkey", None, O),
    "bitor": ("o_orderkey | o_custkey", None, O),
    "bitxor": ("o_orderkey ^ o_custkey", "xor(o_orderkey, o_custkey)", O),
    "leftshift": ("shiftleft(o_custkey, 3)", "o_custkey << 3", O),
    "rightshift": ("shiftrightunsigned(o_orderkey, 2)", "o_orderkey >> 2", O),
    "ceil": ("ceil(c_acctbal)", "CAST(ceil(c_acctbal) AS BIGINT)", C),
    "floor": ("floor(c_acctbal)", "CAST(floor(c_acctbal) AS BIGINT)", C),
    "div": ("ox_div(c_acctbal, c_nationkey)", "CASE WHEN c_nationkey = 0 THEN NULL ELSE CAST(trunc(round(c_acctbal) / c_nationkey) AS BIGINT) END", C),
    "mod": ("round(ox_mod(c_acctbal, c_nationkey), 6)", "CASE WHEN c_nationkey = 0 THEN NULL ELSE round(c_acctbal % c_nationkey, 6) END", C),
    "exp": ("round(ox_exp(p_size / 10), 8)", "round(exp(p_size / 10), 8)", P),
    "pow": ("ox_pow(p_size, 3)", "CAST(p_size * p_size * p_size AS DOUBLE)", P),
    "round": ("round(c_acctbal, 1)", "CAST(round(CAST(c_acctbal AS DECIMAL(12,2)), 1) AS DOUBLE)", C),
    "round_negative": ("round(c_acctbal, -2)", "CAST(round(CAST(c_acctbal AS DECIMAL(12,2)), -2) AS DOUBLE)", C),
    "truncate": ("ox_truncate(CAST(c_acctbal AS DECIMAL(28,10)), 1)", "CAST(trunc(CAST(c_acctbal AS DECIMAL(12,2)) * 10) AS DOUBLE) / 10", C),
    "truncate_negative": ("ox_truncate(CAST(c_acctbal AS DECIMAL(28,10)), -2)", "CAST(trunc(CAST(c_acctbal AS DECIMAL(12,2)) / 100) AS DOUBLE) * 100", C),
    "sign": ("ox_sign(c_acctbal)", "CAST(sign(c_acctbal) AS BIGINT)", C),
    "trigonometry": ("round(sin(p_size), 8) AS a, round(cos(p_size), 8) AS b, round(tan(p_size), 6) AS c, round(atan(p_size), 8) AS d, round(atan2(p_size, 2), 8) AS e, round(cot(p_size), 6)", None, P),
    "arc_functions": ("round(asin(p_size / 100), 8) AS a, round(acos(p_size / 100), 8) AS b, round(radians(p_size), 8) AS c, round(degrees(p_size / 100), 8)", None, P),
    "logarithms": ("round(ln(p_size), 8) AS a, round(log2(p_size), 8) AS b, round(log10(p_size), 8) AS c, round(sqrt(p_size), 8) AS d, round(pi(), 8)", None, P),
    "between": ("p_size BETWEEN 5 AND 20", None, P),
    "notbetween": ("p_size NOT BETWEEN 5 AND 20", None, P),
    "in": ("p_type IN ('SMALL', 'PROMO')", None, P),
    "notin": ("p_type NOT IN ('SMALL', 'PROMO')", None, P),
    "coalesce": ("coalesce(nullif(p_type, 'SMALL'), nullif(p_brand, 'Brand#1'), 'none')", None, P),
    "greatest": ("ox_greatest(p_retailprice, nullif(p_size, 7))", "CASE WHEN p_size = 7 THEN NULL ELSE greatest(p_retailprice, CAST(p_size AS DOUBLE)) END", P),
    "least": ("ox_least(p_retailprice, nullif(p_size, 7))", "CASE WHEN p_size = 7 THEN NULL ELSE least(p_retailprice, CAST(p_size AS DOUBLE)) END", P),
    "if": ("if(nullif(p_size, 7) > 20, 'big', 'small')", "CASE WHEN nullif(p_size, 7) > 20 THEN 'big' ELSE 'small' END", P),
    "ifnull": ("ifnull(nullif(p_size, 7), -1)", None, P),
    "isnull": ("isnull(nullif(p_size, 7))", "nullif(p_size, 7) IS NULL", P),
    "isnotnull": ("isnotnull(nullif(p_size, 7))", "nullif(p_size, 7) IS NOT NULL", P),
    "nullif": ("nullif(p_type, 'SMALL')", None, P),
    "case_simple": ("CASE p_type WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 3 ELSE 2 END", None, P),
    "case_searched": ("CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' END", None, P),
    "cast_int": ("try_cast(c_acctbal AS BIGINT)", "CAST(trunc(c_acctbal) AS BIGINT)", C),
    "cast_char": ("CAST(p_size AS STRING)", "CAST(p_size AS VARCHAR)", P),
    "cast_date": ("try_cast(concat('2020-', p_size, '-30') AS DATE)", "try_cast('2020-' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-30' AS DATE)", P),
    "cast_decimal": ("CAST(CAST(c_acctbal AS DECIMAL(12,1)) AS DOUBLE)", "CAST(CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DECIMAL(12,1)) AS DOUBLE)", C),
    "md5": ("md5(p_name)", None, P),
    "sha1": ("sha1(p_name)", None, P),
    "date": ("to_date(ts)", "CAST(ts AS DATE)", E),
    "day": (f"CAST(day({D}) AS BIGINT)", None, O),
    "dayname": (f"ox_dayname({D})", f"dayname({D})", O),
    "dayofweek": (f"CAST(dayofweek({D}) AS BIGINT)", f"dayofweek({D}) + 1", O),
    "dayofyear": (f"CAST(dayofyear({D}) AS BIGINT)", None, O),
    "from_days": (f"ox_from_days(CAST(ox_to_days({D}) + 30 AS INT))", f"CAST({D} + 30 AS DATE)", O),
    "from_unixtime": ("CAST(timestamp_seconds(round(o_orderkey * 1000.5)) AS TIMESTAMP_NTZ)", "make_timestamp(CAST(round(CAST(o_orderkey AS DECIMAL(18,1)) * 1000.5) AS BIGINT) * 1000000)", O),
    "hour": ("CAST(hour(ts) AS BIGINT)", None, E),
    "last_day": (f"last_day({D})", None, O),
    "makedate": ("ox_makedate(CAST(2000 + p_size AS DOUBLE), CAST(p_partkey % 400 AS DOUBLE))", "CASE WHEN p_partkey % 400 >= 1 THEN CAST(make_date(2000 + p_size, 1, 1) + CAST(p_partkey % 400 - 1 AS INT) AS DATE) END", P),
    "maketime": ("ox_maketime(CAST(p_partkey % 1000 AS INT), p_size, 30)",
                 "CASE WHEN p_partkey % 1000 > 838 THEN '838:59:59' ELSE lpad(CAST(p_partkey % 1000 AS VARCHAR), CAST(greatest(2, length(CAST(p_partkey % 1000 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ':30' END", P),
    "microsecond": ("CAST(ox_microsecond(ts) AS BIGINT)", "CAST(microsecond(ts) % 1000000 AS BIGINT)", E),
    "minute": ("CAST(minute(ts) AS BIGINT)", None, E),
    "month": (f"CAST(month({D}) AS BIGINT)", None, O),
    "monthname": (f"ox_monthname({D})", f"monthname({D})", O),
    "period_add": (f"ox_period_add({PER}, 14)", f"CAST(year({D} + INTERVAL 14 MONTH) * 100 + month({D} + INTERVAL 14 MONTH) AS INT)", O),
    "period_diff": (f"ox_period_diff({PER}, 199701)", f"CAST((year({D}) - 1997) * 12 + month({D}) - 1 AS INT)", O),
    "quarter": (f"CAST(quarter({D}) AS BIGINT)", None, O),
    "sec_to_time": ("ox_sec_to_time(CAST(o_orderkey * 250 AS DOUBLE))",
                    "CASE WHEN o_orderkey * 250 > 3020399 THEN '838:59:59' ELSE lpad(CAST(o_orderkey * 250 // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(o_orderkey * 250 // 3600 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(o_orderkey * 250 // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey * 250 % 60 AS VARCHAR), 2, '0') END", O),
    "second": ("CAST(second(ts) AS BIGINT)", None, E),
    "time": ("date_format(ts, 'HH:mm:ss')", "strftime(ts, '%H:%M:%S')", E),
    "time_to_sec": ("ox_time_to_sec(date_format(ts, 'HH:mm:ss'))", "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT)", E),
    "timediff": ("ox_timediff(ts, CAST('2023-12-31 00:00:00' AS TIMESTAMP_NTZ))",
                 "CASE WHEN date_diff('second', TIMESTAMP '2023-12-31 00:00:00', date_trunc('second', ts)) > 3020399 THEN '838:59:59' ELSE (SELECT lpad(CAST(x // 3600 AS VARCHAR), CAST(greatest(2, length(CAST(x // 3600 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(x // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(x % 60 AS VARCHAR), 2, '0') FROM (SELECT date_diff('second', TIMESTAMP '2023-12-31 00:00:00', date_trunc('second', ts)) AS x) q) END", E),
    "addtime": ("ox_addtime(ts, '26:10:05', 1)", "ts + INTERVAL '26 hours 10 minutes 5 seconds'", E),
    "subtime": ("ox_addtime(ts, '26:10:05', -1)", "ts - INTERVAL '26 hours 10 minutes 5 seconds'", E),
    "timestampdiff_year": (f"ox_year_diff(CAST(o_orderdate AS TIMESTAMP_NTZ), CAST('2002-06-15 00:00:00' AS TIMESTAMP_NTZ))", f"((2002 * 12 + 6) - ({Y} * 12 + {M})) // 12", O),
    "timestampdiff_month": (f"ox_month_diff(CAST(o_orderdate AS TIMESTAMP_NTZ), CAST('2002-06-15 00:00:00' AS TIMESTAMP_NTZ))", f"((2002 * 12 + 6) - ({Y} * 12 + {M})) - CASE WHEN {DD} > 15 THEN 1 ELSE 0 END", O),
    "timestampdiff_second": ("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)", "date_diff('second', TIMESTAMP '2024-01-01 00:00:00', date_trunc('second', ts))", E),
    "to_days": (f"ox_to_days({D})", f"CAST({D} - DATE '1970-01-01' AS BIGINT) + 719528", O),
    "unix_timestamp": ("unix_timestamp(CAST(ts AS TIMESTAMP))", "CAST(floor(epoch(ts)) AS BIGINT)", E),
    "week_mode0": (f"ox_week({D}, 0)", f"CAST(strftime({D}, '%U') AS INT)", O),
    "week_mode3": (f"ox_week({D}, 3)", f"CAST(week({D}) AS INT)", O),
    "week_mode5": (f"ox_week({D}, 5)", f"CAST(strftime({D}, '%W') AS INT)", O),
    "weekday": (f"CAST(weekday({D}) AS BIGINT)", f"isodow({D}) - 1", O),
    "year": (f"CAST(year({D}) AS BIGINT)", None, O),
    "yearweek": (f"ox_yearweek({D}, 3)", f"CAST(isoyear({D}) * 100 + week({D}) AS INT)", O),
}
KEYS = {P: "p_partkey", O: "o_orderkey", E: "event_id", C: "c_custkey"}


def _query(expr: str, source: str):
    run = from_sql(f"SELECT {KEYS[source]}, {expr} AS v {source}")

    def query(spark: SparkSession, d: str) -> DataFrame:
        register(spark)
        return run(spark, d)

    return query


#: Dates are shown as text, so that both sides compare alike.
DATES = {"cast_date", "date", "from_days", "last_day", "makedate"}
QUERIES = {f"fn_{n}": _query(f"CAST({x} AS STRING)" if n in DATES else x, src) for n, (x, _, src) in FN.items()}
ORACLE = {f"fn_{n}": f"SELECT {KEYS[src]}, " + (f"CAST({y or x} AS VARCHAR)" if n in DATES else y or x) + f" AS v {src}" for n, (x, y, src) in FN.items() if n != "crc32"}


def _made(tab: str, key: str, **cols):
    def query(spark: SparkSession, d: str) -> DataFrame:
        register(spark)
        return table(spark, d, tab).select(key, *[c.alias(n) for n, c in ((n, f()) for n, f in cols.items())])

    return query


TS, OD = (lambda: F.col("ts")), (lambda: F.col("o_orderdate"))
QUERIES |= {
    "fn_date_format": _made("events", "event_id", a=lambda: formats.date_format(TS(), "%Y-%m-%d %H:%i:%s.%f"), b=lambda: formats.date_format(TS(), "%W %d %M %y, %h %p"), c=lambda: formats.date_format(TS(), "day %j week %U/%u of %%")),
    "fn_date_format_suffix": _made("orders", "o_orderkey", a=lambda: formats.date_format(OD(), "%D"), b=lambda: formats.date_format(OD(), "%x-%v"), c=lambda: formats.date_format(OD(), "%c/%e %w")),
    "fn_time_format": _made("events", "event_id", a=lambda: formats.date_format(TS(), "%T|%H|%k|%i|%s")),
    "fn_get_format": _made("orders", "o_orderkey", a=lambda: formats.date_format(OD(), formats.get_format("DATE", "EUR")), b=lambda: formats.date_format(OD(), formats.get_format("DATE", "INTERNAL"))),
    "fn_str_to_date": _made("orders", "o_orderkey", a=lambda: formats.str_to_date(F.date_format(OD(), "dd,MM,yyyy HH:mm"), "%d,%m,%Y %H:%i"), b=lambda: formats.str_to_date(F.date_format(OD(), "yyyy D"), "%Y %j")),
    "fn_date_add": _made("events", "event_id", a=lambda: formats.date_add(TS(), 31, "DAY"), b=lambda: formats.date_add(TS(), 5, "MONTH", -1), c=lambda: formats.date_add(TS(), "1-2", "YEAR_MONTH"), d=lambda: formats.date_add(TS(), "3 4:05:06", "DAY_SECOND"), e=lambda: formats.date_add(TS(), 90, "MINUTE")),
    "fn_extract": _made("events", "event_id", a=lambda: formats.extract("YEAR_MONTH", TS()), b=lambda: formats.extract("DAY_MINUTE", TS()), c=lambda: formats.extract("HOUR_SECOND", TS()), d=lambda: formats.extract("QUARTER", TS())),
    "fn_sysdate": _made("region", "r_regionkey", a=lambda: F.current_timestamp()),
    "fn_rand": _made("part", "p_partkey", a=lambda: F.rand(7)),
}
ORACLE |= {
    "fn_date_format": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS a, strftime(ts, '%A %d %B %y, %I %p') AS b, 'day ' || strftime(ts, '%j') || ' week ' || strftime(ts, '%U') || '/' || strftime(ts, '%V') || ' of %' AS c FROM events",
    "fn_date_format_suffix": """SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || CASE WHEN day(o_orderdate) IN (1, 21, 31) THEN 'st' WHEN day(o_orderdate) IN (2, 22) THEN 'nd' WHEN day(o_orderdate) IN (3, 23) THEN 'rd' ELSE 'th' END AS a,
  strftime(o_orderdate, '%G-%V') AS b, CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(day(o_orderdate) AS VARCHAR) || ' ' || strftime(o_orderdate, '%w') AS c FROM orders""",
    "fn_time_format": "SELECT event_id, strftime(ts, '%H:%M:%S|%H|') || CAST(hour(ts) AS VARCHAR) || strftime(ts, '|%M|%S') AS a FROM events",
    "fn_get_format": "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS a, strftime(o_orderdate, '%Y%m%d') AS b FROM orders",
    "fn_str_to_date": "SELECT o_orderkey, CAST(date_trunc('minute', o_orderdate) AS TIMESTAMP) AS a, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS b FROM orders",
    "fn_date_add": "SELECT event_id, ts + INTERVAL 31 DAY AS a, ts - INTERVAL 5 MONTH AS b, ts + INTERVAL 14 MONTH AS c, ts + INTERVAL '3 days 4 hours 5 minutes 6 seconds' AS d, ts + INTERVAL 90 MINUTE AS e FROM events",
    "fn_extract": "SELECT event_id, year(ts) * 100 + month(ts) AS a, (day(ts) * 100 + hour(ts)) * 100 + minute(ts) AS b, (hour(ts) * 100 + minute(ts)) * 100 + second(ts) AS c, quarter(ts) AS d FROM events",
}
