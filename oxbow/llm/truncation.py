"""Texts that lost their end.

Method: a prefix self-join by sorting. The distinct texts of the whole corpus are range
partitioned and sorted; a text is a strict prefix of a longer one exactly when its next
neighbour begins with it, and the first text of the next partition serves the last of
each. Nothing is compared pairwise and no text is cut for the purpose.

Most cut statements have no longer copy anywhere, so the same pass over the distinct
texts also asks whether a marker stands in the place of the end and whether the SQL
grammar is left open (``sqltext.end_missing``). A length limit of a source is a pile of
rows at its greatest length, most of which are cut by those signs; the others of the pile
are then cut as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oxbow.llm import sqltext
from oxbow.session import ensure_checkpoint_dir, table

#: A pile at a source's greatest length: at least so many rows, so large a share of them cut by other signs.
PILE_ROWS, PILE_SHARE = 5, 0.3

#: What a text is compared with: other commands, other statements, other commands of its owner.
COMMAND, STATEMENT, OWN_COMMAND = 0, 1, 2

NARROW = "scope int, h1 long, h2 long, marker boolean, broken boolean, prefix boolean, digits boolean, inside boolean, edge string, part int, text string"


def _edge(a: str, b: str) -> tuple[bool, bool, bool]:
    """For neighbours: whether a is a strict prefix of b, cut between digits, cut inside a word."""
    if len(b) <= len(a) or not b.startswith(a) or not a:
        return False, False, False
    return True, a[-1].isdigit() and b[len(a)].isdigit(), a[-1].isalnum() and b[len(a)].isalnum()


def _sorted_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted distinct (scope, text): the rows with a sign, and the first and last row for the edges."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [x.split(" ")[0] for x in NARROW.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.bool_()] * 5, pa.string(), pa.int32(), pa.string()]
    out: list[tuple] = []
    held: tuple | None = None
    first = True

    def emit(row: tuple, nxt: tuple | None) -> None:
        scope, text, h1, h2 = row
        marker = scope != OWN_COMMAND and sqltext.strip_marker(text)[1]
        broken = not marker and scope == STATEMENT and sqltext.end_missing(text)
        prefix = digits = inside = False
        if nxt is not None and nxt[0] == scope:
            prefix, digits, inside = _edge(text, nxt[1])
        if marker or broken or prefix:
            out.append((scope, h1, h2, marker, broken, prefix, digits, inside, "", part, None))
        if nxt is None:
            out.append((scope, h1, h2, marker, broken, prefix, digits, inside, "last", part, text))

    def batch() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        out.clear()
        return b

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(4))):
            if first:
                out.append((row[0], row[2], row[3], False, False, False, False, False, "first", part, row[1]))
                first = False
            if held is not None:
                emit(held, row)
            held = row
        if len(out) > 5000:
            yield batch()
    if held is not None:
        emit(held, None)
    if out:
        yield batch()


def normalised(text: Column) -> Column:
    """Lower case, blanks trimmed and collapsed."""
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def _hashes(c: str, first: str = "h1", second: str = "h2") -> list[Column]:
    """128 bits of a text from two independent passes."""
    return [F.xxhash64(c).alias(first), F.xxhash64(F.reverse(c)).alias(second)]


def cut_signs(texts: DataFrame) -> DataFrame:
    """Of rows (scope, norm) the distinct texts with a sign of a lost end: scope, h1, h2 (hashes of norm), marker, broken, prefix, digits, inside."""
    ensure_checkpoint_dir(texts.sparkSession)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.distinct().repartitionByRange(n, "scope", "norm").sortWithinPartitions("scope", "norm")
    rows = ordered.select("scope", "norm", *_hashes("norm")).mapInArrow(_sorted_pass, NARROW).checkpoint()
    # Two rows a partition: the last text of each against the first of the next.
    w = Window.orderBy("part", F.when(F.col("edge") == "first", 0).otherwise(1))
    edges = rows.filter("edge <> ''").withColumn("next_text", F.lead("text").over(w)).withColumn("next_scope", F.lead("scope").over(w))
    n_text = F.length("text")
    strict = F.coalesce(
        (F.col("edge") == "last") & (F.col("scope") == F.col("next_scope")) & F.startswith("next_text", "text") & (F.length("next_text") > n_text), F.lit(False)
    )
    a, b = F.substring("text", -1, 1), F.expr("substring(next_text, length(text) + 1, 1)")
    late = edges.filter(strict).select(
        "scope", "h1", "h2", "marker", "broken", F.lit(True).alias("prefix"),
        (a.rlike("[0-9]") & b.rlike("[0-9]")).alias("digits"), (a.rlike(r"\w") & b.rlike(r"\w")).alias("inside"),
    )
    signs = rows.filter("edge = ''").select(*late.columns).unionByName(late)
    return signs.groupBy("scope", "h1", "h2").agg(*[F.bool_or(c).alias(c) for c in ("marker", "broken", "prefix", "digits", "inside")])


def truncated_records(records: DataFrame) -> DataFrame:
    """The records that lost their end: table_name, row_key, source, reason.

    ``records``: table_name, row_key, source, owner (what had this text at other times, or
    null), is_sql, text. Null, empty and blank texts are no records; a record delivered twice
    is two. A null source is a source like any other. Reason is 'marker' (something stands in
    the place of the end), 'limit', 'grammar' or 'prefix' (of a longer copy). A command that
    another continues by digits alone ('job 75', 'job 758') is only cut if its owner shows the
    longer one or it stands at its source's limit. An empty input gives an empty result.
    """
    ensure_checkpoint_dir(records.sparkSession)
    scope = F.when(F.col("is_sql"), STATEMENT).otherwise(COMMAND).alias("scope")
    r = records.withColumn("norm", normalised(F.col("text"))).filter(F.col("norm") != "")
    # A command with its owner before it: one is the beginning of the other only if they have the same owner.
    r = r.withColumn("owned", F.when(~F.col("is_sql") & F.col("owner").isNotNull(), F.concat_ws("\x01", "owner", "norm")))
    mine = F.filter(F.array(F.struct(scope, F.col("norm")), F.struct(F.lit(OWN_COMMAND).alias("scope"), F.col("owned").alias("norm"))), lambda x: x["norm"].isNotNull())
    signs = cut_signs(r.select(F.explode(mine).alias("x")).select("x.scope", "x.norm")).checkpoint()
    # From here on hashes stand for the texts; of commands the text itself isn't needed either.
    h = r.select(
        "table_name", "row_key", "source", "is_sql", scope, F.length("text").alias("len"), F.rtrim("text").endswith(";").alias("closed"), *_hashes("norm"), *_hashes("owned", "o1", "o2")
    ).checkpoint()
    at = ["table_name", "source"]
    lens = h.groupBy(*at, "len").agg(F.count(F.lit(1)).alias("n"))
    tops = lens.groupBy(*at).agg(F.max("len").alias("top"), F.max_by("n", "len").alias("at_top"))
    piles = (
        tops.filter(F.col("at_top") >= PILE_ROWS)
        .select(F.col("table_name").alias("pile_table"), F.col("source").alias("pile_source"), "top")
    )
    c = (
        h.join(signs.filter(F.col("scope") != OWN_COMMAND), ["scope", "h1", "h2"], "left")
        .join(piles, F.col("table_name").eqNullSafe(F.col("pile_table")) & F.col("source").eqNullSafe(F.col("pile_source")) & (F.col("len") == F.col("top")), "left")
        .withColumn("piled", F.col("top").isNotNull())
        .filter(F.col("piled") | F.col("marker").isNotNull())
        .drop("top", "pile_table", "pile_source")
        .fillna(False, ["marker", "broken", "prefix", "digits", "inside"])
        .checkpoint()
    )
    sure = F.col("marker") | F.col("broken") | F.col("prefix")
    limits = (
        c.filter("piled").groupBy(*at).agg(F.avg(sure.cast("int")).alias("share")).filter(F.col("share") >= PILE_SHARE)
        .select(F.col("table_name").alias("l_table"), F.col("source").alias("l_source"), F.lit(True).alias("limited"))
    )
    limited = F.col("table_name").eqNullSafe(F.col("l_table")) & F.col("source").eqNullSafe(F.col("l_source"))
    # Commands: those that their owner continues at another time, and those that stand whole in sources without a limit.
    own = signs.filter((F.col("scope") == OWN_COMMAND) & F.col("prefix")).select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.lit(True).alias("own"))
    whole = h.filter(~F.col("is_sql")).join(limits, limited, "left_anti").select(F.col("h1").alias("w1"), F.col("h2").alias("w2")).distinct().withColumn("elsewhere", F.lit(True))
    sql = c.filter("is_sql").join(limits, limited, "left")
    sql_reason = (
        F.when(F.col("marker"), "marker")
        .when(F.col("piled") & F.col("limited").isNotNull() & ~F.col("closed"), "limit")
        .when(F.col("broken"), "grammar")
        .when(F.col("prefix") & F.col("inside"), "prefix")
    )
    other = (
        c.filter(~F.col("is_sql"))
        .join(limits, limited, "left")
        .join(own, (F.col("o1") == F.col("p1")) & (F.col("o2") == F.col("p2")), "left")
        .join(whole, (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")), "left")
    )
    other_reason = (
        F.when(F.col("marker"), "marker")
        .when(F.col("piled") & F.col("limited").isNotNull() & (F.col("prefix") | F.col("elsewhere").isNull()), "limit")
        .when(F.col("prefix") & (~F.col("digits") | F.col("own").isNotNull()), "prefix")
    )
    out = lambda d, why: d.withColumn("reason", why).filter(F.col("reason").isNotNull()).select("table_name", "row_key", "source", "reason")
    return out(sql, sql_reason).unionByName(out(other, other_reason))


def warehouse_records(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the three tables, with their sources."""
    none = F.lit(None).cast("string")
    host = F.lower(F.element_at(F.split("host", ":"), 1))
    a = table(spark, d, "querystats").select(
        F.lit("querystats").alias("table_name"), F.col("queryid").alias("row_key"), host.alias("source"), none.alias("owner"), F.lit(True).alias("is_sql"), F.col("query").alias("text")
    )
    b = table(spark, d, "sqlstart").select(
        F.lit("sqlstart").alias("table_name"), F.col("id").alias("row_key"), F.col("modulename").alias("source"), none.alias("owner"), F.lit(True).alias("is_sql"), F.col("statement").alias("text")
    )
    owner = F.when(F.col("processpid").isNotNull(), F.concat_ws("/", F.col("trackid").cast("string"), F.col("processpid").cast("string")))
    c = table(spark, d, "processlog").select(
        F.lit("processlog").alias("table_name"), F.col("log_id").alias("row_key"), F.col("modulename").alias("source"), owner.alias("owner"), F.lit(False).alias("is_sql"), F.col("processcommand").alias("text")
    )
    return a.unionByName(b).unionByName(c)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated_records(warehouse_records(spark, d)).select("table_name", "row_key")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts: records with a text, cut ones, share."""
    r = warehouse_records(spark, d)
    all_rows = r.filter(normalised(F.col("text")) != "").groupBy("table_name", "source").agg(F.count(F.lit(1)).alias("n_records"))
    cut = truncated_records(r).groupBy(F.col("table_name").alias("t"), F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("n_cut"))
    n = F.coalesce("n_cut", F.lit(0))
    return all_rows.join(cut, F.col("table_name").eqNullSafe(F.col("t")) & F.col("source").eqNullSafe(F.col("s")), "left").select(
        "table_name", "source", "n_records", n.alias("n_cut"), F.round(n / F.col("n_records"), 6).alias("cut_share")
    )
