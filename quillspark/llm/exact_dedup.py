"""Exact deduplication against immutable snapshots, screened by static filters.

A snapshot is what earlier batches left: one row per distinct text, dealt into
exact buckets by digest, with one binary fuse filter per bucket. A new batch is
first grouped by itself (its own duplicates never meet the snapshot twice); its
distinct digests are screened by the filters; only positives join the exact
buckets, and rows of equal digest are compared byte by byte.

Texts are equal when identical after lower-casing A-Z only; null counts as
empty. Defined results: an empty table gives an empty result; equal ids are
separate rows and all survive if theirs is the largest id of the group; extra
columns are ignored. Nothing is dropped, capped or collected.

Skew: a group may hold any share of the rows. Rows carry a salt, so the member
side of every join is dealt by (digest, salt); what is grouped by digest alone
has at most SALTS rows a digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import fuse_filter
from quillspark.llm.idmap import id_map, where_marked
from quillspark.session import materialise, ship_code

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 64
#: Keys of one filter: a build and a screening task hold about 40 bytes of each.
KEYS_PER_FILTER = 500_000


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digests(docs: DataFrame, is_snapshot: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, old, salt): all that is shuffled of most rows."""
    return _salted(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"), F.coalesce(is_snapshot, F.lit(False)).alias("old")))


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.abs(F.xxhash64("doc_id") % SALTS).cast("int"))


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: keep_id, group_size. Two steps, so no digest is hot."""
    part = rows.groupBy("digest", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return part.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def with_buckets(groups: DataFrame, n_buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64(F.substring("digest", 9, 8)), F.lit(n_buckets)).cast("int"))


def _keys(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(d[:8], "little") for d in column.to_pylist()], np.uint64)


def snapshot_filters(snapshot: DataFrame) -> DataFrame:
    """(bucket, filter): one static filter per bucket of a snapshot's groups."""

    def build(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "filter": pa.array([fuse_filter.build(_keys(rows.column("digest"))).to_bytes()], pa.binary())})

    return snapshot.select("bucket", "digest").groupBy("bucket").applyInArrow(build, "bucket int, filter binary")


def screened(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """``batch`` groups with ``maybe_known``: false only for digests the snapshot lacks."""

    def screen(new: pa.Table, known: pa.Table) -> pa.Table:
        hits = np.zeros(new.num_rows, bool)
        for data in known.column("filter").to_pylist():
            hits |= fuse_filter.FuseFilter.from_bytes(data).contains(_keys(new.column("digest")))
        return new.append_column("maybe_known", pa.array(hits))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema) + ", maybe_known boolean"
    return batch.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(screen, schema)


def halves(docs: DataFrame, doc_id: str = "doc_id") -> Column:
    """Rows with ids below the middle of the id range: those that came first."""
    low, high = docs.agg(F.min(doc_id), F.max(doc_id)).first()
    return F.col(doc_id) < (0 if low is None else (low + high) // 2)


def merged(batch: DataFrame, snapshot: DataFrame, filters: DataFrame) -> DataFrame:
    """The groups of snapshot and batch together: (digest, keep_id, group_size)."""
    new = screened(batch, filters)
    known = snapshot.select("digest", F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size"))
    # Negatives are new for certain and skip the exact buckets.
    fresh = new.filter(~F.col("maybe_known")).select("digest", "keep_id", "group_size")
    probed = new.filter("maybe_known").select("digest", "keep_id", "group_size").join(known, "digest", "full_outer")
    joined = probed.select(
        "digest",
        F.greatest("keep_id", "old_id").alias("keep_id"),
        (F.coalesce("group_size", F.lit(0)) + F.coalesce("old_size", F.lit(0))).alias("group_size"),
    )
    return fresh.unionByName(joined)


def _differing(docs: DataFrame, joined: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of shared digests whose bytes differ from those of the row that stays.

    SHA-256 makes this set empty in practice; it is what turns "equal digest"
    into "equal text". A map of the shared digests keeps the other texts where
    they are. Texts are dealt once, by (digest, salt); the text of a group's last
    row goes only to the salts that hold members of the group.
    """
    salts = materialise(joined.filter("group_size > 1").groupBy("digest", "salt").agg(F.max("keep_id").alias("keep_id")), "shared")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(F.col(text)).alias("norm"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("norm", 256)))
    shared = docs.sparkSession.sparkContext.broadcast(id_map(salts, "digest"))
    texts = _salted(where_marked(texts, F.col("digest"), shared))
    members = materialise(texts.join(salts, ["digest", "salt"]), "members")
    models = members.filter("doc_id = keep_id").groupBy("digest").agg(F.max("norm").alias("model"))
    models = salts.select("digest", "salt").join(models, "digest")
    return members.join(models, ["digest", "salt"]).filter(F.col("norm") != F.col("model")).select("doc_id", "digest", "norm")


def dedup(docs: DataFrame, is_snapshot: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with the group it belongs to; the largest id stays.

    ``is_snapshot`` tells the rows that an earlier run has indexed from those of
    the new batch. Result: doc_id, keep_id, group_size, kept, text_sha256.
    """
    ship_code(docs.sparkSession)
    rows = materialise(digests(docs, is_snapshot, doc_id, text), "digests")
    counts = {r["old"]: r["n"] for r in rows.groupBy("old").agg(F.count("*").alias("n")).collect()}
    # At least as many as a shuffle has partitions, so that no task screens a large share.
    n_buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-max([1, *counts.values()]) // KEYS_PER_FILTER))
    snapshot = materialise(with_buckets(grouped(rows.filter("old")), n_buckets), "snapshot")
    filters = snapshot_filters(snapshot)
    batch = with_buckets(grouped(rows.filter("NOT old")), n_buckets)
    groups = merged(batch, snapshot, filters)
    # A group's row goes to each salt that holds members, so members join without a hot key.
    part = rows.select("digest", "salt").distinct().join(groups, "digest")
    joined = materialise(rows.join(part, ["digest", "salt"]).select("doc_id", "digest", "salt", "keep_id", "group_size"), "joined")
    odd = materialise(_differing(docs, joined, doc_id, text), "collisions")
    plain = joined.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
    if not odd.isEmpty():
        plain = _regrouped(plain, odd)
    return plain.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _regrouped(plain: DataFrame, odd: DataFrame) -> DataFrame:
    """Split the groups of colliding digests by text."""
    split = odd.groupBy("digest", "norm").agg(F.max("doc_id").alias("odd_keep"), F.count("*").alias("odd_size"))
    mine = odd.join(split, ["digest", "norm"]).select("doc_id", "odd_keep", "odd_size")
    lost = odd.groupBy("digest").agg(F.count("*").alias("lost")).select(F.lower(F.hex("digest")).alias("text_sha256"), "lost")
    out = plain.join(mine, "doc_id", "left").join(lost, "text_sha256", "left")
    return out.select(
        "doc_id",
        F.coalesce("odd_keep", "keep_id").alias("keep_id"),
        F.coalesce("odd_size", F.col("group_size") - F.coalesce("lost", F.lit(0))).alias("group_size"),
        "text_sha256",
    )
