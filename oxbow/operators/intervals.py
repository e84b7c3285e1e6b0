"""Merging of overlapping intervals into periods, and the gaps between them.

Starts and ends of an entity are ranked independently of each other. With starts
s(1) <= s(2) <= ... and ends e(1) <= e(2) <= ..., no interval covers the time right
after e(i) exactly when s(i+1) > e(i): then i intervals have begun and i have ended.
Those places are the gaps; the boundaries beside them, ranked again and paired by
rank, are the periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oxbow.operators.ranks import sliced_row_number
from oxbow.session import ensure_checkpoint_dir

DAY = 86_400


def interval_periods(df: DataFrame, entity: Column, start: Column, end: Column, slice_seconds: int = DAY) -> DataFrame:
    """Periods and gaps: columns entity, span_kind ('period' | 'gap'), from_time, to_time.

    ``start`` and ``end`` are timestamps without zone, compared by the second: intervals that
    touch in one second are joined. Rows with a null entity or time, and rows whose end
    isn't later than their start, are no intervals. Repeated intervals change nothing.
    The intervals and the boundaries of periods, both narrow, are written once to the checkpoint folder.
    An entity's rows are cut by day (``slice_seconds``) for ranking, so that an entity with
    a third of all rows is spread over many tasks. An empty input gives an empty result.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # by calendar day and time of day: no time zone has a say
    epoch = F.lit("1970-01-01").cast("date")
    second = lambda c: F.datediff(c.cast("date"), epoch).cast("long") * DAY + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    iv = (
        df.select(entity.alias("entity"), start.alias("__a"), end.alias("__b"))
        .filter(F.col("entity").isNotNull() & (F.col("__b") > F.col("__a")))
        .select("entity", second(F.col("__a")).alias("s"), second(F.col("__b")).alias("e"))
        .distinct()
        .checkpoint()
    )

    def ranked(x: DataFrame, c: str, rank: str) -> DataFrame:
        return sliced_row_number(x, ["entity"], [c], F.floor(F.col(c) / slice_seconds), rank)

    starts = ranked(iv.select("entity", "s"), "s", "i").select("entity", "s", (F.col("i") - 1).alias("k"))
    ends = ranked(iv.select("entity", "e"), "e", "k").select("entity", "e", "k")
    # k = number of intervals ended by e; the start of rank k + 1 lies beside it. The first start has no
    # end before it and the last end no start behind it: the outer join keeps them.
    edge = starts.join(ends, ["entity", "k"], "full_outer").filter(F.col("e").isNull() | F.col("s").isNull() | (F.col("s") > F.col("e"))).checkpoint()
    opens = ranked(edge.filter(F.col("s").isNotNull()).select("entity", "s"), "s", "n")
    closes = ranked(edge.filter(F.col("e").isNotNull()).select("entity", "e"), "e", "n")
    kind = lambda k, a, b: F.struct(F.lit(k).alias("span_kind"), a.alias("from_s"), b.alias("to_s"))
    periods = opens.join(closes, ["entity", "n"]).select("entity", kind("period", F.col("s"), F.col("e")).alias("x"))
    gaps = edge.filter(F.col("s").isNotNull() & F.col("e").isNotNull()).select("entity", kind("gap", F.col("e"), F.col("s")).alias("x"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    of_day = lambda c: F.pmod(c, F.lit(DAY))
    text = lambda c: F.concat(
        F.date_add(epoch, F.floor(c / DAY).cast("int")).cast("string"), F.lit(" "), two(F.floor(of_day(c) / 3600)), F.lit(":"), two(F.floor(of_day(c) / 60) % 60), F.lit(":"), two(of_day(c) % 60)
    )
    return periods.unionByName(gaps).select(
        "entity", F.col("x.span_kind").alias("span_kind"), text(F.col("x.from_s")).alias("from_time"), text(F.col("x.to_s")).alias("to_time")
    )
