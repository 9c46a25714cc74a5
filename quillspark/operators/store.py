"""Table semantics over immutable Parquet: each call returns the table that results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_if_absent(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Append rows whose key the table lacks; of equal keys among them the first by ``order``."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
    return table.unionByName(first.join(table.select(*keys), keys, "left_anti"))


def already_there(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that an insert would skip."""
    return rows.join(table.select(*keys).distinct(), keys, "left_semi")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write wins by ``version``, a null one being the oldest; of equal versions the incoming row, then the larger one.

    One aggregate, so a hot key is combined before the shuffle.
    """
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    order = F.struct(F.col(version), F.col("__new"), F.xxhash64(*[F.col(c).cast("string") for c in rest]))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def delete(table: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(doomed.select(*keys).distinct(), keys, "left_anti")


def update(table: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def bounded_insert(table: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    """Append, or raise when the table would exceed ``most`` rows."""
    if table.count() + rows.count() > most:
        raise ValueError(f"at most {most} rows")
    return table.unionByName(rows)


def with_key(rows: DataFrame, name: str, *parts: str) -> DataFrame:
    """A deterministic id in place of a random one."""
    return rows.withColumn(name, F.sha2(F.concat_ws(":", *[F.col(p).cast("string") for p in parts]), 256))
