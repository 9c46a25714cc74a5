"""Relational as-of join: for every row the last one of the other side at or before it.

Both sides are cut into bins of their position and meet inside a bin; what stands last in
a bin is carried over to later bins by a table of one row per bin. So a key with any number of
rows is work for many tasks, and no task sorts a whole key.

Defined results: a row before the first of the other side takes the first (``first=True``) or
null; a key that the other side lacks, and a null key or position, gives null. Of several rows
at one position the largest value counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str, width: int, first: bool = True) -> DataFrame:
    """``left`` with ``value`` of the row of ``right`` that is last at or before it; positions are whole numbers, bins ``width`` wide."""
    inside = F.floor(F.col("__at") / width).alias("__bin")
    kept = [F.col(f"`{c}`") for c in left.columns]
    a = left.select(F.struct(*kept).alias("__row"), F.col(key).alias("__key"), F.col(left_at).cast("long").alias("__at")).select("*", inside, F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))
    marks = right.filter(F.col(key).isNotNull() & F.col(right_at).isNotNull()).groupBy(F.col(key).alias("__key"), F.col(right_at).cast("long").alias("__at")).agg(F.max(value).alias("__value"))
    b = marks.select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), "__key", "__at", inside, F.lit(0).alias("__side"), "__value")
    both = a.unionByName(b)
    in_bin = Window.partitionBy("__key", "__bin").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__own", F.last("__value", ignorenulls=True).over(in_bin)).filter("__side = 1")
    # One row per bin: the last mark of each, carried to the bins behind it.
    bins = both.groupBy("__key", "__bin").agg(F.max_by("__value", F.when(F.col("__side") == 0, F.col("__at"))).alias("__last"), F.min_by("__value", F.when(F.col("__side") == 0, F.col("__at"))).alias("__head"))
    before = Window.partitionBy("__key").orderBy("__bin")
    carried = bins.select(F.col("__key"), F.col("__bin"), F.last("__last", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"), F.first("__head", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__first"))
    joined = met.filter("__key IS NOT NULL AND __at IS NOT NULL").join(carried, ["__key", "__bin"])
    found = F.coalesce("__own", "__carry", *(["__first"] if first else []))
    lost = met.filter("__key IS NULL OR __at IS NULL").select("__row.*", F.lit(None).cast(right.schema[value].dataType).alias(value))
    return joined.select("__row.*", found.alias(value)).unionByName(lost)
