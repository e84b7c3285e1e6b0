"""Queries of the general (core) data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.operators.anomalies import Reading, implausible_readings
from oxbow.operators.intervals import interval_periods
from oxbow.operators.snapshots import SnapshotIndex
from oxbow.session import table
from oxbow.sources import storage


def p2_readings(spark: SparkSession, d: str) -> DataFrame:
    """Flagged readings with their kind."""
    modules = table(spark, d, "sysmodules").select("modulename", "cpucores", "swaptotalk")
    p = table(spark, d, "processlog").select(
        "log_id", "trackid", "modulename", "snapshotid", "processpid", "processcpupct", "processmempct", "moduleswapusedk"
    ).join(modules, "modulename", "left")
    zero, track, pid = F.lit(0), F.col("trackid"), F.col("processpid")
    return implausible_readings(p, "log_id", "snapshotid", [
        Reading("processcpupct", F.col("processcpupct"), zero, 100 * F.col("cpucores"), 5, 0.3, 0.08, (track, pid)),
        Reading("processmempct", F.col("processmempct"), zero, F.lit(100), 5, 0.1, 0.03, (track, pid)),
        Reading("moduleswapusedk", F.col("moduleswapusedk"), zero, F.col("swaptotalk"), 50_000, 1_000, 0.02, (track,)),
    ])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_readings(spark, d).select("log_id", "field")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """All snapshots as one delivery to an index that ends with the query."""
    index = SnapshotIndex(spark, storage.scratch(spark, "snapshots"))
    found = index.apply(table(spark, d, "processlog"), "trackid", "snapshotid", "processpid", "log_id", "processcommand")
    index.drop()
    return found


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "stackslog")
    return interval_periods(t, F.lower(F.trim("stack")), F.col("checkedout"), F.col("checkedin")).withColumnRenamed("entity", "stack")


QUERIES = {"p2_found": p2_found, "p2_readings": p2_readings, "p3_found": p3_found, "p5_found": p5_found}

ORACLE = {
    "p3_found": r"""
WITH b AS (SELECT trackid, snapshotid, processpid, log_id, processcommand FROM processlog),
present AS (SELECT trackid, snapshotid, lag(snapshotid) OVER w AS before_id, lead(snapshotid) OVER w AS after_id
            FROM (SELECT DISTINCT trackid, snapshotid FROM b WHERE trackid IS NOT NULL AND snapshotid IS NOT NULL) WINDOW w AS (PARTITION BY trackid ORDER BY snapshotid)),
r AS (SELECT b.trackid, b.snapshotid, b.processpid, before_id, after_id,
             lower(trim(regexp_replace(processcommand, '\s+', ' ', 'g'))) AS v
      FROM (SELECT *, row_number() OVER (PARTITION BY trackid, snapshotid, processpid ORDER BY log_id DESC) AS rn FROM b WHERE processpid IS NOT NULL) b
      JOIN present p ON p.trackid = b.trackid AND p.snapshotid = b.snapshotid WHERE rn = 1)
SELECT trackid, snapshotid, processpid, change_kind FROM (
  SELECT coalesce(o.trackid, n.trackid) AS trackid, coalesce(o.after_id, n.snapshotid) AS snapshotid,
         coalesce(o.processpid, n.processpid) AS processpid,
         CASE WHEN o.trackid IS NULL THEN 'added' WHEN n.trackid IS NULL THEN 'removed'
              WHEN o.v IS NULL OR n.v IS NULL OR starts_with(o.v, n.v) OR starts_with(n.v, o.v) THEN NULL ELSE 'changed' END AS change_kind
  FROM (SELECT * FROM r WHERE after_id IS NOT NULL) o
  FULL JOIN (SELECT * FROM r WHERE before_id IS NOT NULL) n
  ON o.trackid = n.trackid AND o.after_id = n.snapshotid AND o.processpid = n.processpid)
WHERE change_kind IS NOT NULL""",
    "p5_found": r"""
WITH iv AS (SELECT DISTINCT lower(trim(stack)) AS stack, date_trunc('second', checkedout) AS s, date_trunc('second', checkedin) AS e
            FROM stackslog WHERE stack IS NOT NULL AND checkedin > checkedout),
m AS (SELECT *, max(e) OVER (PARTITION BY stack ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY stack ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM m),
p AS (SELECT stack, n, min(s) AS a, max(e) AS b FROM g GROUP BY stack, n),
x AS (SELECT stack, 'period' AS span_kind, a, b FROM p UNION ALL
      SELECT stack, 'gap', a, b FROM (SELECT stack, b AS a, lead(a) OVER (PARTITION BY stack ORDER BY n) AS b FROM p) WHERE b IS NOT NULL)
SELECT stack, span_kind, strftime(a, '%Y-%m-%d %H:%M:%S') AS from_time, strftime(b, '%Y-%m-%d %H:%M:%S') AS to_time FROM x""",
}
