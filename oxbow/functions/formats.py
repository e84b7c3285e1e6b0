"""Date formats with percent signs: writing (``date_format``) and reading (``str_to_date``)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from oxbow.functions.sqlfuncs import call

#: Specifiers that are one pattern of Spark's own formatter.
DIRECT = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h",
    "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "p": "a", "r": "hh:mm:ss a", "T": "HH:mm:ss", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE",
}
#: get_format: date styles by kind and place (fixed values of the dialect).
STYLES = {
    ("DATE", "USA"): "%m.%d.%Y", ("DATE", "JIS"): "%Y-%m-%d", ("DATE", "ISO"): "%Y-%m-%d", ("DATE", "EUR"): "%d.%m.%Y", ("DATE", "INTERNAL"): "%Y%m%d",
    ("DATETIME", "USA"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "JIS"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "ISO"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "EUR"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "INTERNAL"): "%Y%m%d%H%i%s",
    ("TIME", "USA"): "%h:%i:%s %p", ("TIME", "JIS"): "%H:%i:%s", ("TIME", "ISO"): "%H:%i:%s", ("TIME", "EUR"): "%H.%i.%s", ("TIME", "INTERNAL"): "%H%i%s",
}


def get_format(kind: str, place: str) -> str | None:
    """The format of a kind (DATE, DATETIME, TIME) and place, or None."""
    return STYLES.get((kind.upper(), place.upper()))


def date_format(c: Column, fmt: str) -> Column:
    """A date or timestamp written by a percent format; null if it is null."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day = c.cast("date")
    parts: list[Column] = []
    plain = ""
    i = 0
    while i < len(fmt):
        if fmt[i] != "%" or i + 1 == len(fmt):
            plain += fmt[i]
            i += 1
            continue
        s = fmt[i + 1]
        i += 2
        if s in "UuVv":
            made = two(call("week", day, F.lit("UuVv".index(s))))
        elif s in "Xx":
            made = F.lpad(call("week_year", day, F.lit(2 if s == "X" else 3)).cast("string"), 4, "0")
        elif s == "j":
            made = F.lpad(F.dayofyear(day).cast("string"), 3, "0")
        elif s == "w":
            made = (F.dayofweek(day) - 1).cast("string")
        elif s == "D":
            d = F.dayofmonth(day)
            end = F.when(d.between(11, 13), "th").when(d % 10 == 1, "st").when(d % 10 == 2, "nd").when(d % 10 == 3, "rd").otherwise("th")
            made = F.concat(d.cast("string"), end)
        elif s in DIRECT:
            made = F.date_format(c, DIRECT[s])
        else:
            plain += s
            continue
        if plain:
            parts.append(F.lit(plain))
            plain = ""
        parts.append(made)
    if plain:
        parts.append(F.lit(plain))
    return F.when(c.isNotNull(), F.concat(*parts) if parts else F.lit(""))


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_RE = "(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)"
DAYS_RE = "(monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|wed|thu|fri|sat|sun)"
READ = {
    "Y": r"(\d{1,4})", "y": r"(\d{1,2})", "m": r"(\d{1,2})", "c": r"(\d{1,2})", "d": r"(\d{1,2})", "e": r"(\d{1,2})", "D": r"(\d{1,2})(?:st|nd|rd|th)",
    "H": r"(\d{1,2})", "k": r"(\d{1,2})", "h": r"(\d{1,2})", "I": r"(\d{1,2})", "l": r"(\d{1,2})", "i": r"(\d{1,2})", "s": r"(\d{1,2})", "S": r"(\d{1,2})",
    "f": r"(\d{1,6})", "p": r"(am|pm)", "j": r"(\d{1,3})", "U": r"(\d{1,2})", "u": r"(\d{1,2})", "V": r"(\d{1,2})", "v": r"(\d{1,2})", "X": r"(\d{1,4})", "x": r"(\d{1,4})",
    "w": r"(\d)", "M": MONTH_RE, "b": MONTH_RE, "W": DAYS_RE, "a": DAYS_RE,
}


def str_to_date_parts(c: Column, fmt: str) -> Column:
    """A struct (year, month, day, hour, minute, second, micro) read by a percent format; zeros are parts
    that the format lacks. Null if the text doesn't match, a part is out of range, or the text is null.
    Text after the match is ignored.
    """
    fmt = fmt.replace("%r", "%h:%i:%s %p").replace("%T", "%H:%i:%s")
    pattern, order, i = r"^\s*", [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            s = fmt[i + 1]
            i += 2
            if s in READ:
                pattern += r"\s*" + READ[s]
                order.append(s)
            else:
                pattern += r"\s*" + re.escape(s)
        elif fmt[i].isspace():
            pattern += r"\s*"
            i += 1
        else:
            pattern += r"\s*" + re.escape(fmt[i])
            i += 1
    text = F.lower(c)
    group = {s: F.regexp_extract(text, pattern, k + 1) for k, s in enumerate(order)}
    num = lambda s: group[s].try_cast("int")
    pick = lambda *names: next((num(s) for s in names if s in group), None)
    zero = F.lit(0)
    ok = text.rlike(pattern)

    def checked(x: Column | None, low: int, high: int) -> Column:
        nonlocal ok
        if x is None:
            return zero
        ok = ok & x.between(low, high)
        return x

    year = zero
    full = next((s for s in "YXxy" if s in group), None)
    if full:
        y = num(full)
        year = F.when(F.length(group[full]) <= 2, F.when(y < 70, y + 2000).otherwise(y + 1900)).otherwise(y)
    name = next((s for s in "Mb" if s in group), None)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(group[name], 1, 3)).cast("int") if name else checked(pick("m", "c"), 0, 12)
    day = checked(pick("d", "e", "D"), 0, 31)
    if "j" in group:
        at = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), checked(num("j"), 1, 366) - 1)
        month, day = F.month(at), F.dayofmonth(at)
    weeks = next((s for s in "UuVv" if s in group), None)
    if weeks and ("w" in group or "W" in group or "a" in group) and full:
        sunday = weeks in "UV"
        if "w" in group:
            wd = checked(num("w"), 0, 6)  # 0 = Sunday
        else:
            t = group["W"] if "W" in group else group["a"]
            wd = F.array_position(F.array(*[F.lit(x) for x in ("sun", "mon", "tue", "wed", "thu", "fri", "sat")]), F.substring(t, 1, 3)).cast("int") - 1
        mode = {"U": 0, "u": 1, "V": 2, "v": 3}[weeks]
        into = wd if sunday else F.pmod(wd + 6, F.lit(7))
        at = F.date_add(call("week_one", year, F.lit(mode)), ((checked(num(weeks), 0, 53) - 1) * 7 + into).cast("int"))
        year, month, day = F.year(at), F.month(at), F.dayofmonth(at)
    if "h" in group or "I" in group or "l" in group:
        h = checked(pick("h", "I", "l"), 1, 12)
        hour = F.when(group["p"] == "pm", h % 12 + 12).otherwise(h % 12) if "p" in group else h
    else:
        hour = checked(pick("H", "k"), 0, 23)
    minute, second = checked(pick("i"), 0, 59), checked(pick("s", "S"), 0, 59)
    micro = F.rpad(group["f"], 6, "0").try_cast("int") if "f" in group else zero
    names = ("year", "month", "day", "hour", "minute", "second", "micro")
    return F.when(ok, F.struct(*[x.cast("int").alias(n) for n, x in zip(names, (year, month, day, hour, minute, second, micro))]))


def str_to_date(c: Column, fmt: str) -> Column:
    """A timestamp without zone read by a percent format; null where that isn't a whole, valid date."""
    p = str_to_date_parts(c, fmt)
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d.%06d", *[p[n] for n in ("year", "month", "day", "hour", "minute", "second", "micro")])
    return F.when(p.isNotNull(), text.try_cast("timestamp_ntz"))


UNITS = {
    "MICROSECOND": lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (n / 1_000_000).cast("decimal(18,6)")),
    "SECOND": lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n.cast("decimal(18,6)")),
    "MINUTE": lambda n: F.make_dt_interval(F.lit(0), F.lit(0), n),
    "HOUR": lambda n: F.make_dt_interval(F.lit(0), n),
    "DAY": lambda n: F.make_dt_interval(n),
    "WEEK": lambda n: F.make_dt_interval(n * 7),
    "MONTH": lambda n: F.make_ym_interval(F.lit(0), n),
    "QUARTER": lambda n: F.make_ym_interval(F.lit(0), n * 3),
    "YEAR": lambda n: F.make_ym_interval(n),
}
#: Units of several fields: the unit of each number in the text, in order.
COMPOUND = {
    "YEAR_MONTH": ("YEAR", "MONTH"), "DAY_HOUR": ("DAY", "HOUR"), "DAY_MINUTE": ("DAY", "HOUR", "MINUTE"), "DAY_SECOND": ("DAY", "HOUR", "MINUTE", "SECOND"),
    "HOUR_MINUTE": ("HOUR", "MINUTE"), "HOUR_SECOND": ("HOUR", "MINUTE", "SECOND"), "MINUTE_SECOND": ("MINUTE", "SECOND"),
    "DAY_MICROSECOND": ("DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"), "HOUR_MICROSECOND": ("HOUR", "MINUTE", "SECOND", "MICROSECOND"),
    "MINUTE_MICROSECOND": ("MINUTE", "SECOND", "MICROSECOND"), "SECOND_MICROSECOND": ("SECOND", "MICROSECOND"),
}


def date_add(c: Column, amount: int | str | Column, unit: str, sign: int = 1) -> Column:
    """``c`` plus (sign 1) or minus (sign -1) an interval of one of the twenty units; compound units take a text such as '1-2' or '3 4:05'."""
    unit = unit.upper()
    x = c.cast("timestamp_ntz")
    if unit in UNITS:
        n = amount if isinstance(amount, Column) else F.lit(int(amount))
        return x + UNITS[unit]((n * sign).cast("int"))
    text = str(amount).strip()
    minus = -1 if text.startswith("-") else 1
    numbers = re.findall(r"\d+", text)
    for n, u in zip(numbers[::-1], COMPOUND[unit][::-1]):
        value = int(n.ljust(6, "0")) if u == "MICROSECOND" else int(n)
        x = x + UNITS[u](F.lit(value * sign * minus))
    return x


def extract(unit: str, c: Column) -> Column:
    """EXTRACT of single and compound units, as a number."""
    one = {
        "YEAR": F.year, "QUARTER": F.quarter, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second,
        "WEEK": lambda x: call("week", x.cast("date"), F.lit(0)), "MICROSECOND": lambda x: F.date_format(x, "SSSSSS").cast("int"),
    }
    unit = unit.upper()
    if unit in one:
        return one[unit](c).cast("bigint")
    total = F.lit(0).cast("bigint")
    for u in COMPOUND[unit]:
        total = total * (1_000_000 if u == "MICROSECOND" else 100) + one[u](c)
    return total
