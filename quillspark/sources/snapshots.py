"""Tables that change by whole snapshots: several tables, one log, one commit row set per version.

Layout of a store folder::

    data/<table>/<id>/*.parquet      staged files; nobody reads them until a version names them
    log/<version>/*.parquet          the files that a version adds to or removes from each table

A transaction stages files with Spark's own writer and then publishes one version,
a table of a few numbers per file that appears with a single commit. If a task or
the driver fails before that, the last version stays what it was. A transaction that
began from an older version than the last one is refused, not merged.

Files hold ranges of the key, and the log has each file's smallest and largest key (as
text), so an upsert or a delete by key reads only files whose range meets the new keys,
and rewrites only those that hold one of them.

Defined results: null keys are equal to each other. Of new rows with one key the first by
``order`` (descending, nulls last), else by all columns, is taken.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOG = "table string, file string, added boolean, rows long, low string, high string"
FILE = "__file"


class Conflict(RuntimeError):
    """Another transaction has published a version meanwhile."""


def key_text(keys: list[str]) -> Column:
    """The first key as text: what files are ordered by."""
    return F.col(keys[0]).cast("string")


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def one_per_key(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    by = [F.desc_nulls_last(order)] if order else []
    pick = Window.partitionBy(*keys).orderBy(*by, *sorted(c for c, t in rows.dtypes if not t.startswith("map")))
    return rows.withColumn("__pick", F.row_number().over(pick)).filter("__pick = 1").drop("__pick")


class SnapshotStore:
    """Tables under one folder that Spark can write to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def log(self) -> DataFrame:
        """(version, table, file, added, rows, low, high) of all versions."""
        try:
            return self.spark.read.schema(f"{LOG}, version long").parquet(f"{self.path}/log/*")
        except AnalysisException:
            return self.spark.createDataFrame([], f"{LOG}, version long")

    def version(self) -> int:
        """The last published version; 0 before the first."""
        return self.log().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def files(self, table: str, version: int | None = None) -> DataFrame:
        """(file, rows, low, high) of a table as of a version."""
        log = self.log().filter(F.col("table") == table)
        if version is not None:
            log = log.filter(F.col("version") <= version)
        last = log.groupBy("file").agg(F.max_by(F.struct("added", "rows", "low", "high"), "version").alias("s"))
        return last.filter("s.added").select("file", "s.rows", "s.low", "s.high")

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The rows of a table; None if it has no file yet. Spark keeps a table's file names on the driver, as for any table."""
        return self._open([r[0] for r in self.files(table, version).select("file").collect()])

    def _open(self, files: list[str]) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", "true").parquet(*sorted(files)) if files else None

    def transaction(self) -> Transaction:
        return Transaction(self)


class Transaction:
    """Staged changes of any number of tables; ``commit`` publishes them as one version."""

    def __init__(self, store: SnapshotStore) -> None:
        self.store, self.spark = store, store.spark
        self.base = store.version()
        self.changes: list[DataFrame] = []
        self.changed: set[str] = set()

    def _stage(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        folder = f"{self.store.path}/data/{table}/{uuid.uuid4().hex}"
        rows.repartitionByRange(key_text(keys)).sortWithinPartitions(*keys).write.parquet(folder)
        text = key_text(keys)
        written = self.spark.read.schema(rows.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.min(text).alias("low"), F.max(text).alias("high"), F.count_if(text.isNull()).alias("__nulls"))
        # A file with a null key has no lower bound.
        found = written.select(F.lit(table).alias("table"), "file", F.lit(True).alias("added"), "rows", F.when(F.col("__nulls") == 0, F.col("low")).alias("low"), "high")
        self.changes.append(found)

    def _once(self, table: str) -> None:
        if table in self.changed:
            raise ValueError(f"{table} is changed already by this transaction")
        self.changed.add(table)

    def append(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        self._once(table)
        self._stage(table, rows, keys)

    def insert_if_absent(self, table: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows whose key the table does not have, one of each key."""
        self._once(table)
        fresh = one_per_key(rows, keys)
        near = self._near(table, fresh, keys)
        if near is not None:
            fresh = fresh.join(near, same(fresh, near, keys), "left_anti")
        self._stage(table, fresh, keys)

    def upsert(self, table: str, rows: DataFrame, keys: list[str], order: str | None = None) -> None:
        """New rows in place of those with their keys."""
        self._once(table)
        fresh = one_per_key(rows, keys, order)
        kept = self._without(table, fresh, keys)
        self._stage(table, fresh if kept is None else kept.unionByName(fresh, allowMissingColumns=True), keys)

    def delete(self, table: str, gone: DataFrame, keys: list[str]) -> None:
        """Remove the rows whose keys are in ``gone``."""
        self._once(table)
        kept = self._without(table, gone.select(*keys).distinct(), keys)
        if kept is not None:
            self._stage(table, kept, keys)

    def _near(self, table: str, fresh: DataFrame, keys: list[str]) -> DataFrame | None:
        """Rows of the files whose key range meets that of ``fresh``, with the name of their file."""
        text = key_text(keys)
        bounds = fresh.agg(F.min(text).alias("a"), F.max(text).alias("b"), F.count_if(text.isNull()).alias("n"))
        files = self.store.files(table, self.base).join(F.broadcast(bounds))  # one row
        meets = (F.col("n") > 0) & F.col("low").isNull() | (F.coalesce(F.col("high") >= F.col("a"), F.lit(False)) & F.coalesce(F.col("low") <= F.col("b"), F.lit(True)))
        rows = self.store._open([r[0] for r in files.filter(meets).select("file").collect()])
        return None if rows is None else rows.withColumn(FILE, F.col("_metadata.file_path"))

    def _without(self, table: str, fresh: DataFrame, keys: list[str]) -> DataFrame | None:
        """The other rows of the files that hold a key of ``fresh``; those files leave the table."""
        near = self._near(table, fresh, keys)
        if near is None:
            return None
        touched = [r[0] for r in near.join(fresh, same(near, fresh, keys), "left_semi").select(FILE).distinct().collect()]
        if not touched:
            return None
        self.changes.append(self.store.files(table, self.base).filter(F.col("file").isin(touched)).select(F.lit(table).alias("table"), "file", F.lit(False).alias("added"), "rows", "low", "high"))
        rows = self.store._open(touched)
        return rows.join(fresh, same(rows, fresh, keys), "left_anti")

    def commit(self) -> int:
        """Publish the version and return its number."""
        if not self.changes:
            return self.base
        rows = reduce(DataFrame.unionByName, self.changes).withColumn("version", F.lit(self.base + 1).cast("long"))
        if self.store.version() != self.base:
            raise Conflict(f"version {self.base} is not the last one any more")
        try:
            rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.store.path}/log/{self.base + 1:012d}")
        except AnalysisException as error:
            raise Conflict(f"version {self.base + 1} is there already") from error
        return self.base + 1
