"""Connected components of a table of links, without collecting it.

Links are first contracted inside each partition to a spanning forest, then
alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014) turn every component into a star
around its smallest id. A node may have any number of neighbours: what meets
at a node is dealt by (node, salt), and the least neighbour is found by salt
first. Joins ask for a merge: a broadcast for each of them adds up in the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialise, ship_code

EDGES = "a long, b long"
SALTS = 32


def find(parent: dict[int, int], x: int) -> int:
    root = x
    while parent.get(root, root) != root:
        root = parent[root]
    while parent.get(x, x) != root:
        parent[x], x = root, parent[x]
    return root


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(parent, a), find(parent, b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(parent, x) for x in nodes], pa.int64())], ["a", "b"])


def _settled(edges: DataFrame) -> bool:
    """Whether edges (a > b) are stars: no id stands under two others, or under one and over another."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("under")).unionByName(edges.select(F.col("b").alias("id"), F.lit(0).alias("under")))
    return ends.groupBy("id").agg(F.sum("under").alias("times"), F.min("under").alias("least")).filter("times > 1 OR times = 1 AND least = 0").isEmpty()


def _with_least(edges: DataFrame) -> DataFrame:
    """(a, b, m): every edge with the least neighbour of ``a``, which reaches each salt of ``a`` once."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("a", "salt").agg(F.min("b").alias("low"))
    least = part.groupBy("a").agg(F.min("low").alias("m"), F.collect_list("salt").alias("salts"))
    return salted.join(least.select("a", F.explode("salts").alias("salt"), "m").hint("merge"), ["a", "salt"]).select("a", "b", "m")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); component is the smallest id reachable."""
    ship_code(links.sparkSession)
    edges = materialise(links.select("a", "b").filter("a <> b").mapInArrow(_forest, EDGES).distinct(), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct()
        # Written, since its least neighbours read it several times: a plan that holds it as often fills the driver's memory.
        small = _with_least(materialise(large, "large"))
        edges = materialise(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
