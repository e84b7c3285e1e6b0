"""Tables with row DML, schema changes and partitions, as generations over Parquet files.

A generation is a small file that says all about the table: columns, rules, and which data files it
is made of. It is created only if it isn't there yet, so of two writers one fails and nothing is lost,
and the one with the largest number holds: readers see the old table or the new one, never a part.
A change writes files for new or changed rows only; files without changed rows are taken over by name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oxbow.sources import storage


@dataclass
class ColumnSpec:
    name: str
    type: str
    not_null: bool = False
    default: str | None = None
    auto_increment: bool = False


@dataclass
class Meta:
    """One generation. ``files`` are relative to the table's data folder; ``parent`` is the generation a rollback goes back to."""

    generation: int = 0
    parent: int | None = None
    columns: list[dict] = field(default_factory=list)
    partition_by: list[str] = field(default_factory=list)
    disabled: list[str] = field(default_factory=list)
    next_id: int = 1
    checks: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    foreign: list[dict] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)


class ConstraintError(ValueError):
    """Rows break a rule of the table."""


class ConflictError(RuntimeError):
    """Another writer made the next generation first; read the table again and repeat the change."""


NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


class Table:
    """A table in the folder ``path``: its newest generation, or the one asked for (to be read only)."""

    def __init__(self, spark: SparkSession, path: str, generation: int | None = None):
        self.spark, self.path = spark, path
        have = self._generations(spark, path)
        if not have or generation is not None and generation not in have:
            raise FileNotFoundError(path)
        self.fixed = generation is not None
        self.meta = self._read(have[-1] if generation is None else generation)
        self.pending: Meta | None = None  # the generation a transaction began with

    @staticmethod
    def _generations(spark: SparkSession, path: str) -> list[int]:
        return sorted(int(f.split(".")[0]) for f in storage.files(spark, f"{path}/_meta") if f.endswith(".json"))

    def _read(self, generation: int) -> Meta:
        text = storage.read_text(self.spark, f"{self.path}/_meta/{generation:012d}.json")
        if text is None:
            raise FileNotFoundError(f"{self.path}, generation {generation}")
        return Meta(**json.loads(text))

    @classmethod
    def create(cls, spark: SparkSession, path: str, columns: list[ColumnSpec], partition_by: list[str] | None = None, checks: list[str] | None = None, unique: list[list[str]] | None = None) -> Table:
        """CREATE TABLE: columns with types, NOT NULL, defaults, auto-increment; CHECK expressions and UNIQUE column lists."""
        if cls._generations(spark, path):
            raise FileExistsError(path)
        meta = Meta(columns=[asdict(c) for c in columns], partition_by=partition_by or [], checks=checks or [], unique=unique or [])
        if not storage.create_text(spark, f"{path}/_meta/{0:012d}.json", json.dumps(asdict(meta))):
            raise FileExistsError(path)
        return cls(spark, path)

    # reading
    def _schema(self) -> str:
        return ", ".join(f"`{c['name']}` {c['type']}" for c in self.meta.columns)

    def _names(self) -> list[str]:
        return [c["name"] for c in self.meta.columns]

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self._schema())

    def _of(self, files: list[str], place: bool = False) -> DataFrame:
        """The rows of the given files; ``place``: with the file of each, as ``__file``."""
        data = f"{self.path}/data"
        if not files:
            return self._empty().withColumn("__file", F.lit("")) if place else self._empty()
        d = self.spark.read.schema(self._schema()).option("basePath", data).parquet(*[f"{data}/{f}" for f in files])
        return d.select(*self._names(), F.col("_metadata.file_path").alias("__file")) if place else d.select(*self._names())

    def _all(self) -> DataFrame:
        return self._of(self.meta.files)

    def df(self) -> DataFrame:
        """The rows, without those of disabled partitions (whose files aren't read)."""
        return self._of([f for f in self.meta.files if self._partition(f) not in self.meta.disabled]) if self.meta.disabled else self._all()

    def _key(self) -> Column:
        return F.concat_ws("/", *[F.concat(F.lit(f"{p}="), F.coalesce(F.col(p).cast("string"), F.lit("null"))) for p in self.meta.partition_by])

    def _partition(self, file: str) -> str:
        """The partition that a file's folder names, written as ``_key`` writes it."""
        parts = [x.split("=", 1) for x in file.split("/")[:-1]]
        return "/".join(f"{unquote(k)}={'null' if v == NULL_FOLDER else unquote(v)}" for k, v in parts)

    # changing
    def _write(self, d: DataFrame) -> list[str]:
        """New data files with these rows; their names begin with a mark of their own, by which they are listed."""
        mark = uuid.uuid4().hex
        data = f"{self.path}/data"
        w = d.write.mode("append").option("mapreduce.output.basename", mark)
        (w.partitionBy(*self.meta.partition_by) if self.meta.partition_by else w).parquet(data)
        return storage.files_below(self.spark, data, mark)

    def _broken(self, new: DataFrame, others: DataFrame, columns: set[str] | None = None) -> None:
        """Hold new rows against the rules: NOT NULL and CHECK in one pass over them, keys against each other and the other rows.

        ``columns``: those that changed (default: all); rules of other columns hold already.
        """
        touched = lambda names: columns is None or bool(columns & set(names))
        rules = {f"null in {c['name']}": F.col(c["name"]).isNull() for c in self.meta.columns if c["not_null"] and touched([c["name"]])}
        rules |= {f"check {x}": ~F.expr(x) for x in self.meta.checks}
        if rules:
            row = new.agg(*[F.max(r.cast("int")).alias(f"r{i}") for i, r in enumerate(rules.values())]).first()
            broken = [n for i, n in enumerate(rules) if row[f"r{i}"] == 1]
            if broken:
                raise ConstraintError("; ".join(broken))
        for cols in self.meta.unique:
            if touched(cols):
                keys = new.select(*cols).dropna()
                if not keys.groupBy(*cols).count().filter("count > 1").isEmpty() or not others.join(keys, cols, "left_semi").isEmpty():
                    raise ConstraintError(f"not unique: {cols}")
        for f in self.meta.foreign:
            if touched(f["columns"]):
                there = Table(self.spark, f["other"])._all().select(*[F.col(o).alias(c) for c, o in zip(f["columns"], f["other_columns"])])
                if not new.select(*f["columns"]).dropna().join(there, f["columns"], "left_anti").isEmpty():
                    raise ConstraintError(f"no such key: {f['columns']}")

    def _publish(self, parent: int | None = None, **changes) -> None:
        """Make the next generation: one file, created if nobody else did. In a transaction that waits for its end."""
        if self.fixed:
            raise ValueError("an old generation can't be changed")
        if self.pending is not None:
            self.meta = Meta(**{**asdict(self.meta), **changes})
            return
        g = self.meta.generation
        new = Meta(**{**asdict(self.meta), **changes, "generation": g + 1, "parent": g if parent is None else parent})
        if not storage.create_text(self.spark, f"{self.path}/_meta/{g + 1:012d}.json", json.dumps(asdict(new))):
            raise ConflictError(f"{self.path}: generation {g + 1} is there already")
        self.meta = new

    @contextmanager
    def transaction(self) -> Iterator[Table]:
        """Several changes that become one generation at the end; an exception leaves the table as it was."""
        if self.pending is not None:
            raise ValueError("a transaction is open already")
        self.pending = base = self.meta
        try:
            yield self
        except BaseException:
            self.meta, self.pending = base, None
            raise
        made, self.meta, self.pending = asdict(self.meta), base, None
        try:
            self._publish(**{k: v for k, v in made.items() if k not in ("generation", "parent")})
        except ConflictError:
            self.meta = base
            raise

    def _replace(self, rows: DataFrame, gone: list[str], check: bool = True, touched: set[str] | None = None, **changes) -> None:
        """Publish with new files for ``rows`` in the place of the files ``gone``; broken rules leave nothing."""
        kept = sorted(set(self.meta.files) - set(gone))
        old, new = self.meta, self._write(rows)
        try:
            self.meta = Meta(**{**asdict(old), **changes})
            if check:
                self._broken(self._of(new), self._of(kept), touched)
            self.meta = old
            self._publish(**changes, files=kept + new)
        except Exception:
            self.meta = old
            for f in new:
                storage.delete(self.spark, f"{self.path}/data/{f}")
            raise

    def _filled(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """Rows with all columns: defaults, casts, numbers of the auto-increment column."""
        next_id = self.meta.next_id
        d = rows
        for c in self.meta.columns:
            if c["auto_increment"] and c["name"] not in rows.columns:
                # numbers by partition offset: no global sort
                d = d.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()).checkpoint()
                sizes = d.groupBy("__p").count()
                before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
                offsets = sizes.select(F.col("__p").alias("__q"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__o"))
                local = F.row_number().over(Window.partitionBy("__p").orderBy("__i"))
                d = d.withColumn("__n", local).join(offsets, F.col("__p") == F.col("__q")).withColumn(c["name"], F.col("__n") + F.col("__o") + (next_id - 1))
                next_id += d.count()
            elif c["name"] not in d.columns:
                d = d.withColumn(c["name"], F.expr(c["default"]) if c["default"] is not None else F.lit(None))
        return d.select(*[F.col(c["name"]).cast(c["type"]).alias(c["name"]) for c in self.meta.columns]), next_id

    def add_foreign_key(self, columns: list[str], other: str, other_columns: list[str]) -> None:
        """FOREIGN KEY to the table in the folder ``other``; checked now and with every change. Null keys are free."""
        old = self.meta
        foreign = [*old.foreign, {"columns": columns, "other": other, "other_columns": other_columns}]
        self.meta = Meta(**{**asdict(old), "foreign": foreign, "unique": [], "checks": []})
        try:
            self._broken(self._all(), self._empty(), set(columns))
        finally:
            self.meta = old
        self._publish(foreign=foreign)

    def insert(self, rows: DataFrame) -> None:
        """INSERT … SELECT / VALUES: missing columns get their default, the auto-increment column its numbers. Only new files are written."""
        storage.ensure_checkpoint_dir(self.spark)
        d, next_id = self._filled(rows)
        self._replace(d, [], next_id=next_id)

    def last_insert_id(self) -> int:
        """The first number of the next insert, less one."""
        return self.meta.next_id - 1

    def _files_with(self, cond: Column | None, keys: DataFrame | None = None, on: list[str] | None = None) -> list[str]:
        """Files that hold a row of the condition (or of the keys): at most as many names as the table has files."""
        d = self._of(self.meta.files, place=True)
        hit = d.filter(cond) if cond is not None else d.join(keys, on, "left_semi")
        names = {unquote(r["__file"].split("/data/")[-1]) for r in hit.select("__file").distinct().collect()}
        return [f for f in self.meta.files if unquote(f) in names]

    @staticmethod
    def _true(where: Column | str) -> Column:
        return F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))

    def update(self, values: dict[str, Column | str], where: Column | str) -> None:
        """UPDATE: rows for which ``where`` is true get the values; null counts as false. Files without such rows stay."""
        cond = self._true(where)
        touched = self._files_with(cond)
        new = []
        for c in self.meta.columns:
            n = c["name"]
            if n in values:
                v = F.expr(values[n]) if isinstance(values[n], str) else values[n]
                new.append(F.when(cond, v.cast(c["type"])).otherwise(F.col(n)).alias(n))
            else:
                new.append(F.col(n))
        self._replace(self._of(touched).select(*new), touched, touched=set(values))

    def delete(self, where: Column | str) -> None:
        """DELETE: rows for which ``where`` is true. Files without such rows stay."""
        cond = self._true(where)
        touched = self._files_with(cond)
        self._replace(self._of(touched).filter(~cond), touched, check=False)

    def delete_in(self, keys: DataFrame, on: list[str]) -> None:
        """DELETE … WHERE EXISTS / IN: rows whose key stands in ``keys``."""
        k = keys.select(*on).distinct()
        touched = self._files_with(None, k, on)
        self._replace(self._of(touched).join(k, on, "left_anti").select(*self._names()), touched, check=False)

    def truncate(self) -> None:
        self._publish(files=[])

    def rollback(self) -> None:
        """Back to the generation before, with its columns, rules and partitions: as a new generation."""
        if self.meta.parent is None:
            raise ValueError("nothing to roll back")
        try:
            before = self._read(self.meta.parent)
        except FileNotFoundError:
            raise ValueError("nothing to roll back") from None
        content = {k: v for k, v in asdict(before).items() if k not in ("generation", "parent")}
        g = self.meta.generation
        new = Meta(**content, generation=g + 1, parent=before.parent)
        if self.fixed or self.pending is not None:
            raise ValueError("roll back by leaving the transaction")
        if not storage.create_text(self.spark, f"{self.path}/_meta/{g + 1:012d}.json", json.dumps(asdict(new))):
            raise ConflictError(f"{self.path}: generation {g + 1} is there already")
        self.meta = new

    def vacuum(self) -> None:
        """Remove all generations but this one, and the files that it doesn't name."""
        held = {unquote(f) for f in self.meta.files}
        for f in storage.files_below(self.spark, f"{self.path}/data", ""):
            if unquote(f) not in held:
                storage.delete(self.spark, f"{self.path}/data/{f}")
        for g in self._generations(self.spark, self.path):
            if g < self.meta.generation:
                storage.delete(self.spark, f"{self.path}/_meta/{g:012d}.json")

    def rename_to(self, path: str) -> None:
        """RENAME TABLE: the folder moves."""
        storage.move(self.spark, self.path, path)
        self.path = path

    def drop(self) -> None:
        storage.delete(self.spark, self.path)

    # schema
    def add_column(self, c: ColumnSpec) -> None:
        """Without a default, and under a name that was never used, no file is written."""
        columns = [*self.meta.columns, asdict(c)]
        if c.default is None and not c.not_null and c.name not in self.meta.dropped:
            self._publish(columns=columns)
            return
        value = F.expr(c.default) if c.default is not None else F.lit(None)
        self._replace(self._all().withColumn(c.name, value.cast(c.type)), self.meta.files, columns=columns)

    def drop_column(self, name: str) -> None:
        """No file is written; the column's name is remembered."""
        if name in self.meta.partition_by:
            raise ValueError("a partition column can't be dropped")
        if any(name in u for u in self.meta.unique):
            raise ValueError("a column of a UNIQUE rule can't be dropped")
        self._publish(columns=[c for c in self.meta.columns if c["name"] != name], dropped=sorted({*self.meta.dropped, name}))

    def rename_column(self, old: str, new: str) -> None:
        cols = [{**c, "name": new if c["name"] == old else c["name"]} for c in self.meta.columns]
        swap = lambda names: [new if n == old else n for n in names]
        d = self._all().withColumnRenamed(old, new)
        before = self.meta
        self.meta = Meta(**{**asdict(before), "partition_by": swap(before.partition_by)})
        try:
            files = self._write(d)
        finally:
            self.meta = before
        self._publish(columns=cols, partition_by=swap(before.partition_by), unique=[swap(u) for u in before.unique], dropped=sorted({*before.dropped, old}), files=files)

    def modify_type(self, name: str, kind: str) -> None:
        """A new type; values that don't fit it become null."""
        cols = [{**c, "type": kind if c["name"] == name else c["type"]} for c in self.meta.columns]
        self._replace(self._all().withColumn(name, F.col(name).try_cast(kind)), self.meta.files, columns=cols)

    def set_default(self, name: str, default: str | None) -> None:
        self._publish(columns=[{**c, "default": default if c["name"] == name else c["default"]} for c in self.meta.columns])

    # partitions
    def partitions(self, low: Column | None = None, value_column: str | None = None) -> DataFrame:
        """Each partition with its rows, whether it is enabled and, of ``value_column``, its least and greatest value."""
        aggs = [F.count(F.lit(1)).alias("n_rows")]
        if value_column:
            aggs += [F.min(value_column).alias("low"), F.max(value_column).alias("high")]
        return self._all().groupBy(self._key().alias("part")).agg(*aggs).withColumn("enabled", ~F.col("part").isin(self.meta.disabled) if self.meta.disabled else F.lit(True))

    def _by_value(self, column: str, low, high) -> list[str]:
        """Partitions whose values all lie within the range; as many as there are partition folders."""
        p = self.partitions(value_column=column).filter((F.col("low") >= F.lit(low)) & (F.col("high") <= F.lit(high)))
        return [r["part"] for r in p.select("part").collect()]

    def disable_partitions(self, *parts: str) -> None:
        self._publish(disabled=sorted({*self.meta.disabled, *parts}))

    def enable_partitions(self, *parts: str) -> None:
        self._publish(disabled=[p for p in self.meta.disabled if p not in parts])

    def drop_partitions(self, *parts: str) -> None:
        """The partitions' files leave the table; no file is written."""
        self._publish(files=[f for f in self.meta.files if self._partition(f) not in parts], disabled=[p for p in self.meta.disabled if p not in parts])

    def disable_by_value(self, column: str, low, high) -> list[str]:
        parts = self._by_value(column, low, high)
        self.disable_partitions(*parts)
        return parts

    def drop_by_value(self, column: str, low, high) -> list[str]:
        parts = self._by_value(column, low, high)
        self.drop_partitions(*parts)
        return parts

    def redistribute(self, files: int, by: list[str] | None = None, cluster_by: list[str] | None = None) -> None:
        """Rewrite into so many evenly filled files; ``cluster_by`` sorts within them for min/max pruning."""
        d = self._all()
        d = d.repartitionByRange(files, *cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else d.repartition(files, *(by or []))
        self._replace(d, self.meta.files, check=False)
