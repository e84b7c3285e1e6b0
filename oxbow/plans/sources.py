"""Queries over sources and sinks: bulk load, row DML, schema changes, partitions, location."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oxbow.sources import storage
from oxbow.sources.delimited import LoadColumn, bulk_load, load_job, read_delimited, write_delimited
from oxbow.sources.embedded import DRIVER, publish
from oxbow.sources.location import extent_map, foreign_scan, with_extents, with_location
from oxbow.sources.statements import Warehouse
from oxbow.sources.tables import ColumnSpec, Table
from oxbow.session import register_views, table

CUSTOMER = [
    LoadColumn("c_custkey", "bigint", not_null=True), LoadColumn("c_name"), LoadColumn("c_nationkey", "int"), LoadColumn("c_acctbal", "double"), LoadColumn("c_mktsegment"),
]


def io_csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    at = storage.scratch(spark, "csv")
    write_delimited(table(spark, d, "customer"), at)
    return read_delimited(spark, at, CUSTOMER)[0]


def _dirty(spark: SparkSession, d: str) -> str:
    """Customers as text, every 100th with a word for a number, every 150th without a key, every 70th with a field too few."""
    at = storage.scratch(spark, "dirty")
    k = F.col("c_custkey")
    line = F.concat_ws("|", F.when(k % 150 != 1, k.cast("string")).otherwise(""), F.col("c_name"), F.when(k % 100 == 0, "many").otherwise(F.col("c_nationkey").cast("string")), F.col("c_mktsegment"))
    table(spark, d, "customer").select(F.when(k % 70 == 3, F.concat_ws("|", k.cast("string"), F.col("c_name"))).otherwise(line)).write.text(at)
    return at


DIRTY = [LoadColumn("c_custkey", "bigint", not_null=True), LoadColumn("c_name"), LoadColumn("c_nationkey", "int"), LoadColumn("c_mktsegment", length=4)]


def io_bulk_load(spark: SparkSession, d: str) -> DataFrame:
    to, bad = storage.scratch(spark, "loaded"), storage.scratch(spark, "rejects")
    bulk_load(spark, _dirty(spark, d), DIRTY, to, bad, max_errors=1 << 40)
    return spark.read.parquet(to)


def io_bulk_rejects(spark: SparkSession, d: str) -> DataFrame:
    return read_delimited(spark, _dirty(spark, d), DIRTY)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def io_job_spec(spark: SparkSession, d: str) -> DataFrame:
    """Ignored columns, defaults and a column that the input lacks."""
    at = storage.scratch(spark, "spec")
    t = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_size")).alias("p_size"), "p_type")
    write_delimited(t, at, null_text="")
    spec = [LoadColumn("p_partkey", "bigint"), LoadColumn("p_name", ignore=True), LoadColumn("p_size", "int", default="-1"), LoadColumn("p_type")]
    return read_delimited(spark, at, spec, extra={"batch": "b1"}, null_text="")[0]


def io_formats(spark: SparkSession, d: str) -> DataFrame:
    """Through ORC and JSON, partitioned."""
    a, b = storage.scratch(spark, "orc"), storage.scratch(spark, "json")
    table(spark, d, "part").write.partitionBy("p_type").orc(a)
    spark.read.orc(a).write.json(b)
    return spark.read.schema("p_partkey bigint, p_size int, p_type string").json(b).select("p_partkey", "p_size", "p_type")


def io_foreign_scan(spark: SparkSession, d: str) -> DataFrame:
    return foreign_scan(spark, "parquet", {"path": f"{d}/orders.parquet"}, ["o_orderkey", "o_totalprice"], "o_totalprice > 450000")


def io_jdbc_scan(spark: SparkSession, d: str) -> DataFrame:
    """A table of another engine, here an embedded database: the filter runs there, and only the columns asked for come over."""
    url = publish(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "suppliers")
    return foreign_scan(spark, "jdbc", {"url": url, "dbtable": "suppliers", "driver": DRIVER}, ["s_suppkey", "s_acctbal"], "s_acctbal > 5000 AND s_nationkey < 20")


def location_row_extents(spark: SparkSession, d: str) -> DataFrame:
    return with_extents(spark, f"{d}/orders.parquet", "o_orderkey").select("o_orderkey", "extent_min", "extent_max")


def _orders(spark: SparkSession, d: str, partition: bool = False) -> Table:
    cols = [ColumnSpec("o_orderkey", "bigint", not_null=True), ColumnSpec("o_custkey", "bigint"), ColumnSpec("o_orderstatus", "string", default="'N'"), ColumnSpec("o_totalprice", "double")]
    t = Table.create(spark, storage.scratch(spark, "table"), cols, ["o_orderstatus"] if partition else [], checks=["o_totalprice IS NULL OR o_totalprice > -1000000"], unique=[["o_orderkey"]])
    t.insert(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))
    return t


def dml_insert(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.insert(table(spark, d, "orders").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_custkey"))
    return t.df()


def dml_update(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.update({"o_totalprice": "o_totalprice * 2", "o_orderstatus": "'X'"}, "o_orderkey % 3 = 0 AND o_orderstatus = 'F'")
    return t.df()


def dml_delete(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.delete("o_totalprice > 250000 OR o_orderstatus = 'P'")
    return t.df()


def dml_delete_exists(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.delete_in(table(spark, d, "customer").filter("c_acctbal < 5000").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])
    return t.df()


def dml_rollback(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.delete("o_orderkey >= 0")
    t.rollback()
    return t.df()


def dml_rollback_schema(spark: SparkSession, d: str) -> DataFrame:
    """A rollback brings back a table's columns too."""
    t = _orders(spark, d)
    t.rename_column("o_totalprice", "price")
    t.drop_column("o_custkey")
    t.rollback()
    t.rollback()
    return t.df()


def dml_insert_append(spark: SparkSession, d: str) -> DataFrame:
    """Single rows added to a large table: each insert writes a file of its own, the others stay."""
    t = _orders(spark, d)
    before = set(t.meta.files)
    for k in (-1, -2):
        t.insert(spark.createDataFrame([(k, 7)], "o_orderkey bigint, o_custkey bigint").coalesce(1))
    files = set(t.meta.files)
    return t.df().withColumns({"kept": F.lit(before <= files), "new_files": F.lit(len(files - before))})


def dml_transaction(spark: SparkSession, d: str) -> DataFrame:
    """Two changes that count as one, one that is given up, and the table as it was before."""
    t = _orders(spark, d)
    first = t.meta.generation
    with t.transaction():
        t.delete("o_orderstatus = 'P'")
        t.update({"o_totalprice": "0"}, "o_orderstatus = 'F'")
    try:
        with t.transaction():
            t.truncate()
            raise KeyboardInterrupt
    except KeyboardInterrupt:
        pass
    now = Table(spark, t.path).df().withColumn("version", F.lit("new"))
    return now.unionByName(Table(spark, t.path, generation=first).df().withColumn("version", F.lit("old")))


def io_load_job(spark: SparkSession, d: str) -> DataFrame:
    """Two tables by one job file, the second loaded twice: rows loaded and rejected by the last call, and what stands in the table."""
    at = storage.scratch(spark, "job")
    columns = [{"name": "c_custkey", "type": "bigint", "not_null": True}, {"name": "c_name"}, {"name": "c_nationkey", "type": "int"}, {"name": "c_mktsegment", "length": 4}]
    job = {"delimiter": "|", "tables": [{"name": "dirty", "path": _dirty(spark, d), "max_errors": 1 << 40, "columns": columns}]}
    storage.write_text(spark, f"{at}/job.json", json.dumps(job))
    load_job(spark, f"{at}/job.json", f"{at}/out")
    loaded, rejected = load_job(spark, f"{at}/job.json", f"{at}/out")["dirty"]
    return spark.read.parquet(f"{at}/out/dirty").agg(F.count(F.lit(1)).alias("stored")).select("stored", F.lit(loaded).cast("bigint").alias("loaded"), F.lit(rejected).cast("bigint").alias("rejected"))


def ddl_alter(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.add_column(ColumnSpec("note", "string", default="'none'"))
    t.rename_column("o_custkey", "customer")
    t.drop_column("o_orderstatus")
    t.modify_type("o_totalprice", "bigint")
    return t.df()


def ddl_auto_increment(spark: SparkSession, d: str) -> DataFrame:
    cols = [ColumnSpec("id", "bigint", auto_increment=True), ColumnSpec("n_name", "string")]
    t = Table.create(spark, storage.scratch(spark, "auto"), cols)
    t.insert(table(spark, d, "nation").select("n_name"))
    t.insert(table(spark, d, "region").select(F.col("r_name").alias("n_name")))
    return t.df().agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi"))


def partition_show(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d, partition=True)
    t.disable_partitions("o_orderstatus=F")
    return t.partitions(value_column="o_orderkey")


def partition_disable(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d, partition=True)
    t.disable_partitions("o_orderstatus=F", "o_orderstatus=P")
    t.enable_partitions("o_orderstatus=P")
    return t.df()


def partition_drop(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d, partition=True)
    t.drop_partitions("o_orderstatus=O")
    return t.df()


def partition_drop_by_value(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d, partition=True)
    t.drop_by_value("o_orderstatus", "G", "O")
    return t.df()


def table_redistribute(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    t.redistribute(4, cluster_by=["o_orderkey"])
    return t.df()


def location_columns(spark: SparkSession, d: str) -> DataFrame:
    x = with_location(table(spark, d, "orders").select("o_orderkey"))
    return x.select("o_orderkey", F.substring_index(F.regexp_replace("loc_file", "%2F", "/"), "/", -1).isNotNull().alias("has_file"))


def location_extents(spark: SparkSession, d: str) -> DataFrame:
    e = extent_map(spark, f"{d}/orders.parquet", ["o_orderkey"])
    return e.groupBy("column").agg(F.min(F.col("low").cast("bigint")).alias("low"), F.max(F.col("high").cast("bigint")).alias("high"), F.sum("n_rows").alias("n_rows"))


DDL = """
CREATE TABLE o (o_orderkey BIGINT NOT NULL, o_custkey BIGINT, status CHAR(1) DEFAULT 'N', price DOUBLE, UNIQUE (o_orderkey), CONSTRAINT c1 CHECK (price > -1000000)) ENGINE=COLUMNS;
INSERT INTO o SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders;
"""
#: Scripts of statements; the last one is the query that is compared.
SCRIPTS = {
    "stmt_insert": DDL + "INSERT INTO o (o_orderkey, o_custkey) VALUES (-1, 5), (-2, 2 + 3); INSERT INTO o VALUES (-3, NULL, 'it''s', 1.5); SELECT * FROM o",
    "stmt_update": DDL + "UPDATE o SET price = price * 2, status = IF(o_custkey > 50, 'X', 'Y') WHERE status = 'F' XOR o_orderkey % 2 = 0; SELECT * FROM o",
    "stmt_update_subquery": DDL + "UPDATE o SET price = 0 WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0); SELECT * FROM o",
    "stmt_delete": DDL + "DELETE FROM o WHERE price / 0 IS NULL AND status = 'P'; DELETE FROM o WHERE o_custkey BETWEEN 10 AND 20; SELECT * FROM o",
    "stmt_alter": DDL + "ALTER TABLE o ADD COLUMN note VARCHAR(10) DEFAULT 'none', DROP COLUMN status; ALTER TABLE o CHANGE o_custkey customer INT; ALTER TABLE o ADD COLUMN empty DATE; SELECT * FROM o",
    "stmt_transaction": DDL + "START TRANSACTION; DELETE FROM o WHERE status = 'P'; UPDATE o SET price = 1 WHERE status = 'F'; COMMIT; START TRANSACTION; TRUNCATE TABLE o; ALTER TABLE o DROP COLUMN price; ROLLBACK; SELECT * FROM o",
    "stmt_rename_drop": DDL + "CREATE TABLE gone (x INT); DROP TABLE gone; DROP TABLE IF EXISTS gone; RENAME TABLE o TO p; SELECT status, count(*) AS n FROM p GROUP BY status",
    "stmt_auto_increment": "CREATE TABLE n (id BIGINT AUTO_INCREMENT, name VARCHAR(30)); INSERT INTO n (name) SELECT n_name FROM nation; INSERT INTO n (name) VALUES ('last'); SELECT max(id) AS top, count(DISTINCT id) AS ids, max(CASE WHEN name = 'last' THEN id END) AS last_id FROM n",
}


def _script(text: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        register_views(spark, d, "orders", "customer", "nation")
        return Warehouse(spark, storage.scratch(spark, "warehouse")).script(text)

    return query


QUERIES = {n: _script(x) for n, x in SCRIPTS.items()} | {f.__name__: f for f in (
    io_csv_roundtrip, io_bulk_load, io_bulk_rejects, io_job_spec, io_formats, io_foreign_scan, dml_insert, dml_update, dml_delete, dml_delete_exists, dml_rollback, dml_rollback_schema, dml_insert_append, dml_transaction, io_load_job,
    ddl_alter, ddl_auto_increment, partition_show, partition_disable, partition_drop, partition_drop_by_value, table_redistribute, location_columns, location_extents, io_jdbc_scan, location_row_extents,
)}

BASE = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
SHORT = "SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice AS price FROM orders"
ORACLE = {
    "stmt_insert": SHORT + " UNION ALL SELECT -1, 5, 'N', NULL UNION ALL SELECT -2, 5, 'N', NULL UNION ALL SELECT -3, NULL, 'it''s', 1.5",
    "stmt_update": "SELECT o_orderkey, o_custkey, CASE WHEN hit THEN CASE WHEN o_custkey > 50 THEN 'X' ELSE 'Y' END ELSE o_orderstatus END AS status, CASE WHEN hit THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM (SELECT *, (o_orderstatus = 'F') <> (o_orderkey % 2 = 0) AS hit FROM orders) x",
    "stmt_update_subquery": "SELECT o_orderkey, o_custkey, o_orderstatus AS status, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 0 ELSE o_totalprice END AS price FROM orders",
    "stmt_delete": SHORT + " WHERE o_orderstatus <> 'P' AND o_custkey NOT BETWEEN 10 AND 20",
    "stmt_alter": "SELECT o_orderkey, CAST(o_custkey AS INT) AS customer, o_totalprice AS price, 'none' AS note, CAST(NULL AS DATE) AS empty FROM orders",
    "stmt_transaction": "SELECT o_orderkey, o_custkey, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE o_totalprice END AS price FROM orders WHERE o_orderstatus <> 'P'",
    "stmt_rename_drop": "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1",
    "stmt_auto_increment": "SELECT CAST(26 AS BIGINT) AS top, CAST(26 AS BIGINT) AS ids, CAST(26 AS BIGINT) AS last_id",
    "io_jdbc_scan": "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 5000 AND s_nationkey < 20",
    "location_row_extents": "SELECT o_orderkey, (SELECT min(o_orderkey) FROM orders) AS extent_min, (SELECT max(o_orderkey) FROM orders) AS extent_max FROM orders",
    "io_csv_roundtrip": "SELECT * FROM customer",
    "io_bulk_load": "SELECT c_custkey, c_name, c_nationkey, left(c_mktsegment, 4) AS c_mktsegment FROM customer WHERE c_custkey % 70 <> 3 AND c_custkey % 100 <> 0 AND c_custkey % 150 <> 1",
    "io_bulk_rejects": """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 70 = 3 THEN 'fields' WHEN c_custkey % 150 = 1 THEN 'null in c_custkey' WHEN c_custkey % 100 = 0 THEN 'type of c_nationkey' END AS reason FROM customer) x
WHERE reason IS NOT NULL GROUP BY reason""",
    "io_job_spec": "SELECT p_partkey, CAST(CASE WHEN p_size > 25 THEN p_size ELSE -1 END AS INT) AS p_size, p_type, 'b1' AS batch FROM part",
    "io_formats": "SELECT p_partkey, p_size, p_type FROM part",
    "io_foreign_scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000",
    "dml_insert": BASE + " UNION ALL SELECT -o_orderkey - 1, o_custkey, 'N', NULL FROM orders",
    "dml_update": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders",
    "dml_delete": BASE + " WHERE NOT (o_totalprice > 250000 OR o_orderstatus = 'P')",
    "dml_delete_exists": BASE + " WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 5000)",
    "dml_rollback": BASE,
    "dml_rollback_schema": BASE,
    "dml_insert_append": "SELECT *, TRUE AS kept, 2 AS new_files FROM (" + BASE + " UNION ALL SELECT -1, 7, 'N', NULL UNION ALL SELECT -2, 7, 'N', NULL) x",
    "dml_transaction": "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE o_totalprice END AS o_totalprice, 'new' AS version FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 'old' FROM orders",
    "io_load_job": "SELECT 2 * sum(CASE WHEN ok THEN 1 ELSE 0 END) AS stored, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS loaded, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS rejected FROM (SELECT c_custkey % 70 <> 3 AND c_custkey % 100 <> 0 AND c_custkey % 150 <> 1 AS ok FROM customer) x",
    "ddl_alter": "SELECT o_orderkey, o_custkey AS customer, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice, 'none' AS note FROM orders",
    "ddl_auto_increment": "SELECT CAST(30 AS BIGINT) AS n, CAST(30 AS BIGINT) AS ids, CAST(1 AS BIGINT) AS lo, CAST(30 AS BIGINT) AS hi",
    "partition_show": "SELECT 'o_orderstatus=' || o_orderstatus AS part, count(*) AS n_rows, min(o_orderkey) AS low, max(o_orderkey) AS high, o_orderstatus <> 'F' AS enabled FROM orders GROUP BY o_orderstatus",
    "partition_disable": BASE + " WHERE o_orderstatus <> 'F'",
    "partition_drop": BASE + " WHERE o_orderstatus <> 'O'",
    "partition_drop_by_value": BASE + " WHERE o_orderstatus <> 'O'",
    "table_redistribute": BASE,
    "location_columns": "SELECT o_orderkey, TRUE AS has_file FROM orders",
    "location_extents": "SELECT 'o_orderkey' AS \"column\", min(o_orderkey) AS low, max(o_orderkey) AS high, CAST(count(*) AS BIGINT) AS n_rows FROM orders",
}
