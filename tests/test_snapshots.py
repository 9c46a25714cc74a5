"""Snapshot tables: one commit for several tables, what survives a failure, which files an upsert touches."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources.snapshots import Conflict, SnapshotStore


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, f"file://{tmp_path}/store")


def numbers(spark, low, high, text="a"):
    return spark.range(low, high, numPartitions=3).select("id", F.lit(text).alias("t"))


def test_all_changes(spark, store):
    assert store.version() == 0 and store.read("x") is None
    t = store.transaction()
    t.append("x", numbers(spark, 100, 200), ["id"])
    t.append("y", numbers(spark, 0, 3, "why"), ["id"])
    assert store.version() == 0 and store.read("x") is None  # staged only
    assert t.commit() == 1
    t = store.transaction()
    t.insert_if_absent("x", numbers(spark, 190, 210, "new").unionByName(numbers(spark, 205, 207, "zz")), ["id"])
    t.upsert("y", spark.createDataFrame([(1, "one", 1), (1, "uno", 2), (None, "none", 1), (7, "seven", None)], "id long, t string, at int"), ["id"], "at")
    assert t.commit() == 2
    x = {r.id: r.t for r in store.read("x").collect()}
    assert len(x) == 110 and x[195] == "a" and x[206] == "new"
    assert rows_of(store.read("y").select("id", "t")) == [(0, "why"), (1, "uno"), (2, "why"), (7, "seven"), (None, "none")]
    t = store.transaction()
    t.delete("x", spark.createDataFrame([(100,), (150,), (999,)], "id long"), ["id"])
    t.upsert("y", spark.createDataFrame([(None, "again", 3)], "id long, t string, at int"), ["id"])
    t.commit()
    assert store.read("x").count() == 108 and store.read("x", 2).count() == 110 and store.read("x", 1).count() == 100
    assert rows_of(store.read("y").filter("id IS NULL")) == [(None, "again", 3)]
    assert store.transaction().commit() == 3  # nothing to say


def test_only_touched_files_are_rewritten(spark, store):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t = store.transaction()
        t.append("x", spark.range(10_000).select("id", F.lit("a").alias("t")), ["id"])
        t.commit()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    before = {r[0] for r in store.files("x").select("file").collect()}
    t = store.transaction()
    t.upsert("x", numbers(spark, 5000, 5003, "b"), ["id"])
    t.commit()
    after = {r[0] for r in store.files("x").select("file").collect()}
    assert len(before) == 4 and len(before - after) == 1
    assert store.read("x").count() == 10_000 and store.read("x").filter("t = 'b'").count() == 3


def test_a_lost_task_leaves_the_last_version(spark, store):
    t = store.transaction()
    t.append("x", numbers(spark, 0, 50), ["id"])
    t.append("y", numbers(spark, 0, 5), ["id"])
    t.commit()

    def dies(batches):
        for batch in batches:
            if batch.column(0).to_pylist()[-1:] == [49]:
                os._exit(9)  # the worker is gone, as with a lost executor
            yield batch

    t = store.transaction()
    t.upsert("y", numbers(spark, 0, 5, "changed"), ["id"])
    with pytest.raises(Exception, match="."):
        t.upsert("x", numbers(spark, 0, 50, "changed").mapInArrow(dies, "id long, t string"), ["id"])
    again = SnapshotStore(spark, store.path)
    assert again.version() == 1 and again.read("x").filter("t = 'a'").count() == 50 and again.read("y").filter("t = 'a'").count() == 5
    t = again.transaction()
    t.upsert("x", numbers(spark, 0, 50, "changed"), ["id"])
    assert t.commit() == 2 and again.read("x").filter("t = 'changed'").count() == 50


def test_late_transactions_are_refused(spark, store):
    first, second = store.transaction(), store.transaction()
    first.append("x", numbers(spark, 0, 5), ["id"])
    second.append("x", numbers(spark, 0, 5), ["id"])
    first.commit()
    with pytest.raises(Conflict):
        second.commit()
    with pytest.raises(ValueError, match="already"):
        first.append("x", numbers(spark, 0, 5), ["id"])
    assert store.read("x").count() == 5
