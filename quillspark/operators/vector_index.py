"""A stored inverted file over vectors, with residual codes: approximate pre-selection, exact re-scoring.

A coarse quantiser of ``lists`` centroids and a product quantiser of what is left
are trained by k-means on at most ``sample`` vectors. Every vector, whichever the
sample, is put on the list of its nearest centroid as a code of ``parts`` bytes (Jégou
et al., "Product Quantization for Nearest Neighbor Search", 2011). Lists are stored
as blocks of up to ``BLOCK`` codes in a folder per list, so a search for one vector
opens only the lists that it probes.

A set of queries meets the lists block by block. First each query meets its nearest lists,
as many as hold ``shortlist`` codes; the score of its last code there is a floor that the codes
of all other lists must reach, so few rows are made, however many lists are probed. The
best of all are re-scored with the vectors themselves. The exact scan (``exact_top``) works
through blocks in the same way, and a task keeps only the best of what it has seen.

Defined results: vectors are compared by cosine; null, empty and zero vectors, those with
null or non-finite components and those of another length than the index are on no list and
find nothing. Ties are ordered by id. Rows that share an id are candidates of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.session import materialise, ship_code

#: Codes of a block, queries that meet it at a time, and tasks that share all rows of an exact scan.
BLOCK, QUERIES, SHARES = 4096, 256, 16


@dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray
    books: np.ndarray  # (parts, words, length of a part)

    @property
    def length(self) -> int:
        return self.centroids.shape[1]

    def nearest(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` centroids with the largest inner product, best first."""
        score = unit @ self.centroids.T
        n = min(n, score.shape[1])
        some = np.argpartition(-score, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(score, some, 1), axis=1, kind="stable"), 1)

    def homes(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.centroids.T - (self.centroids**2).sum(1) / 2).argmax(1)

    def codes(self, unit: np.ndarray, home: np.ndarray) -> np.ndarray:
        left = (unit - self.centroids[home]).reshape(len(unit), len(self.books), -1)
        out = np.empty(left.shape[:2], np.uint8)
        for j, book in enumerate(self.books):
            out[:, j] = (left[:, j] @ book.T - (book**2).sum(1) / 2).argmax(1)
        return out


def kmeans(rows: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    """Centres of ``rows``; a centre that loses all its rows moves to the row that is farthest from its own."""
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(steps):
        score = rows @ centres.T - (centres**2).sum(1) / 2
        own = score.argmax(1)
        size = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
        if (empty := np.flatnonzero(size == 0)).size:
            centres[empty] = rows[np.argsort(score.max(1), kind="stable")[: len(empty)]]
    return centres


def unit_rows(column: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the usable vectors of ``length``, or of the first usable length."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    if length is None:
        length = int(lengths[lengths > 0][0]) if (lengths > 0).any() else 1
    at = np.flatnonzero(lengths == length)
    rows = values[(np.cumsum(lengths) - lengths)[at][:, None] + np.arange(length)]
    most = np.abs(rows).max(1, initial=0)
    good = np.isfinite(most) & (most > 0)
    rows = rows[good] / most[good, None]
    return at[good], rows / np.sqrt((rows**2).sum(1))[:, None]


def train(vectors: DataFrame, vector: str = "embedding", lists: int | None = None, parts: int = 16, sample: int = 20_000, seed: int = 7) -> Quantiser | None:
    """Quantiser of a sample of at most ``sample`` vectors; None if there is no usable one. ``lists`` is the root of the rows, from 1 to 1,024."""
    rows = vectors.filter(F.size(vector) > 0)
    n = rows.count()
    picked = rows.select(vector).sample(min(1.0, 1.2 * sample / n), seed=seed).limit(sample).toArrow() if n else None
    if picked is None or not picked.num_rows:
        picked = rows.select(vector).limit(sample).toArrow()
    _, unit = unit_rows(picked.column(0).combine_chunks()) if picked.num_rows else (None, np.zeros((0, 1)))
    if not len(unit):
        return None
    rng = np.random.default_rng(seed)
    centroids = kmeans(unit, lists or max(1, min(1024, round(n**0.5))), rng)
    while unit.shape[1] % parts:
        parts -= 1
    model = Quantiser(centroids, np.zeros((parts, 1, unit.shape[1] // parts)))
    left = (unit - centroids[model.homes(unit)]).reshape(len(unit), parts, -1)
    words = min(256, len(unit))
    return Quantiser(centroids, np.stack([kmeans(left[:, j], words, rng) for j in range(parts)]))


def _packed(rows: DataFrame, key: str, most: int, spread: int, tasks: int) -> DataFrame:
    """(cell, ids, data) blocks of rows (cell, id, data binary); a cell's rows are dealt into ``spread`` salts."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, ids, data = [], [], []

        def block() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([cells[0]], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())], ["cell", "ids", "data"])
            cells.clear(), ids.clear(), data.clear()
            return out

        for batch in batches:
            for cell, own, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cells and (cell != cells[0] or len(ids) == most):
                    yield block()
                cells.append(cell)
                ids.append(own)
                data.append(piece)
        if cells:
            yield block()

    dealt = rows.repartition(tasks, "cell", F.pmod(F.xxhash64(key), F.lit(spread))).sortWithinPartitions("cell")
    return dealt.select("cell", key, "data").mapInArrow(body, "cell int, ids array<long>, data binary")


def _meeting(blocks: DataFrame, asked: DataFrame, salts: int) -> DataFrame:
    """Blocks of rows beside the blocks of queries of their cell; a cell's blocks are dealt to ``salts`` tasks, its queries go to each of them."""
    salted = blocks.withColumn("salt", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(salts)).cast("int"))
    everywhere = asked.select("cell", F.col("ids").alias("queries"), F.col("data").alias("vectors"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return salted.join(everywhere, ["cell", "salt"])


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the ``k`` largest of each row."""
    k = min(k, score.shape[1])
    some = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(score)), k), some.reshape(-1)


def top(found: DataFrame, k: int, score: str) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc(score), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class VectorIndex:
    """Lists in a folder; ``model`` is trained first and shared with every task."""

    def __init__(self, spark: SparkSession, path: str, model: Quantiser | None, spread: int = 4) -> None:
        self.spark, self.path, self.model, self.spread = spark, path.rstrip("/"), model, spread
        self.shared = spark.sparkContext.broadcast(model)  # 1,024 centroids and 256 words a part at most
        self.tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def add(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
        """Append the codes of ``vectors``; readers see them when the write has ended."""
        ship_code(self.spark)
        shared = self.shared

        def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                if model is not None:
                    at, unit = unit_rows(batch.column(1), model.length)
                    home = model.homes(unit) if len(at) else np.zeros(0, np.int64)
                    codes = model.codes(unit, home)
                    yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), batch.column(0).take(pa.array(at)), pa.array([c.tobytes() for c in codes], pa.binary())], ["cell", "id", "data"])

        coded = vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), vector).mapInArrow(body, "cell int, id long, data binary")
        _packed(coded, "id", BLOCK, self.spread, self.tasks).write.mode("append").partitionBy("cell").parquet(f"{self.path}/lists")

    def _probes(self, queries: DataFrame, probe: int, enough: int, sizes: dict[int, int]) -> DataFrame:
        """(cell, id, data, near): every query under each of the lists that it probes, with its unit vector as bytes; ``near`` are the first lists that hold ``enough`` codes."""
        shared = self.shared

        def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                if model is not None:
                    at, unit = unit_rows(batch.column(1), model.length)
                    if len(at):
                        cells = model.nearest(unit, probe)
                        held = np.array([sizes.get(c, 0) for c in range(len(model.centroids))])[cells]
                        near = np.cumsum(held, axis=1) - held < enough
                        n = cells.shape[1]
                        yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1).astype(np.int32)), batch.column(0).take(pa.array(np.repeat(at, n))), pa.array([u.tobytes() for u in unit for _ in range(n)], pa.binary()), pa.array(near.reshape(-1))], ["cell", "id", "data", "near"])

        return queries.select("query", "vector").mapInArrow(body, "cell int, id long, data binary, near boolean")

    def _scored(self, lists: DataFrame, asked: DataFrame, shortlist: int) -> DataFrame:
        """(query, id, score) of the codes on the lists of ``asked`` (cell, id, data, floor) that reach the query's floor, at most ``shortlist`` of a block."""
        shared = self.shared
        floored = asked.select("cell", "id", F.concat("data", F.col("floor")).alias("data"))

        def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                for row in batch.to_pylist():
                    both = np.frombuffer(row["vectors"]).reshape(-1, model.length + 1)
                    unit, floor = both[:, :-1], both[:, -1]
                    codes = np.frombuffer(row["data"], np.uint8).reshape(-1, len(model.books))
                    score = np.repeat((unit @ model.centroids[row["cell"]])[:, None], len(codes), 1)
                    for j, book in enumerate(model.books):
                        part = unit[:, j * book.shape[1] : (j + 1) * book.shape[1]]
                        score += (part @ book.T)[:, codes[:, j]]
                    who, what = _best(score, shortlist)
                    kept = score[who, what] >= floor[who]
                    who, what = who[kept], what[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(row["queries"])[who]), pa.array(np.array(row["ids"])[what]), pa.array(score[who, what])], ["query", "id", "score"])

        blocks = _packed(floored, "id", QUERIES, 1, self.tasks)
        return _meeting(lists, blocks, self.spread).mapInArrow(body, "query long, id long, score double")

    def candidates(self, queries: DataFrame, probe: int, shortlist: int, cells: list[int] | None = None) -> DataFrame:
        """(query, id, score): the best ``shortlist`` codes for each of ``queries`` (query, vector) on the ``probe`` nearest lists."""
        ship_code(self.spark)
        lists = self.spark.read.parquet(f"{self.path}/lists")
        if cells is not None:
            lists = lists.filter(F.col("cell").isin(cells))
        sizes = {r[0]: r[1] for r in lists.groupBy("cell").agg(F.sum(F.size("ids"))).collect()}  # a number a list
        probes = materialise(self._probes(queries, probe, shortlist, sizes), "probes")
        lowest = bytes(np.array([-np.inf]).tobytes())
        first = materialise(self._scored(lists, probes.filter("near").withColumn("floor", F.lit(bytearray(lowest))), shortlist), "near")
        floors = top(first, shortlist, "score").groupBy("query").agg(F.when(F.count("*") >= shortlist, F.min("score")).alias("f"))

        def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(1).fill_null(float("-inf")).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.float64(v).tobytes() for v in values], pa.binary())], ["query", "floor"])

        floored = probes.filter("NOT near").join(floors.mapInArrow(as_bytes, "query long, floor binary").withColumnRenamed("query", "id"), "id")
        return top(first.unionByName(self._scored(lists, floored, shortlist)), shortlist, "score").drop("rank")

    def search(self, queries: DataFrame, vectors: DataFrame, k: int, probe: int, shortlist: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(query, id, score, rank): the ``k`` best by exact cosine among the candidates of each of ``queries`` (query, vector)."""
        found = self.candidates(queries, probe, shortlist).select("query", "id")
        full = found.join(vectors.select(F.col(key).alias("id"), F.col(vector).alias("__v")), "id").join(queries.select("query", F.col("vector").alias("__q")), "query")
        return top(full.select("query", "id", F.round(cosine_of(F.col("__v"), F.col("__q")), 6).alias("score")), k, "score")

    def nearest(self, query: list[float], vectors: DataFrame, k: int, probe: int, shortlist: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """(key, score) of the ``k`` nearest to one vector; only the folders of its lists are opened."""
        cells = self.model.nearest(np.array([query]) / np.linalg.norm(query), probe)[0].tolist() if self.model is not None else []
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query long, vector array<double>")
        found = self.candidates(one, probe, shortlist, cells).select("id")
        full = vectors.select(F.col(key).alias("id"), F.col(vector).alias("__v")).join(F.broadcast(found), "id")  # shortlist rows
        scored = full.select(F.col("id").alias(key), F.round(cosine_of(F.col("__v"), F.array(*[F.lit(float(x)) for x in query])), 6).alias("score"))
        return scored.orderBy(F.desc("score"), key).limit(k)


def cosine_of(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def exact_top(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, id, score, rank) by the exact scan: blocks of the stated queries against blocks of all vectors."""
    spark = vectors.sparkSession
    ship_code(spark)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths[lengths > 0]):
                at, unit = unit_rows(batch.column(1), int(n))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), batch.column(0).take(pa.array(at)), pa.array([u.tobytes() for u in unit], pa.binary())], ["cell", "id", "data"])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                a, b = (np.frombuffer(row[c]).reshape(-1, row["cell"]) for c in ("vectors", "data"))
                score, ids = np.round(a @ b.T, 6), np.array(row["ids"])
                floor = np.array([best[q][-1][0] if len(best.get(q, ())) == k else np.inf for q in row["queries"]])
                # Ties at the end of a block's best are all looked at, since the id decides between them.
                limit = -np.partition(-score, min(k, score.shape[1]) - 1, axis=1)[:, min(k, score.shape[1]) - 1]
                hit = score >= np.maximum(limit, -floor)[:, None]
                for i in np.flatnonzero(hit.any(1)).tolist():
                    own = [*best.get(row["queries"][i], ()), *zip((-score[i, hit[i]]).tolist(), ids[hit[i]].tolist(), strict=True)]
                    best[row["queries"][i]] = sorted(own)[:k]
        flat = [(q, i, -s) for q, own in best.items() for s, i in own]
        yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in flat], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query", "id", "score"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = "cell int, id long, data binary"
    rows = _packed(vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), vector).mapInArrow(units, kind), "id", BLOCK, SHARES, tasks)
    asked = _packed(queries.select("query", "vector").mapInArrow(units, kind), "id", QUERIES, 1, tasks)
    met = _meeting(rows, asked, SHARES)
    return top(met.mapInArrow(body, "query long, id long, score double"), k, "score")
