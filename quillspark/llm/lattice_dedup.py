"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to a few blocks of eight dimensions, each
decoded to its nearest point of the E8 lattice (Conway and Sloane, "Fast
Quantizing and Decoding Algorithms for Lattice Quantizers and Codes", 1982); the
points of one table's blocks are a cell. A vector lives in its home cell of every
table and probes the neighbouring cells that its residual lies nearest to.
Vectors that meet in a cell and whose sign sketches agree are compared in double
precision.

Equal vectors are one from the start. Of vectors crowded in a cell, those close
to a leader form a tight group: any two of them link by the triangle inequality
on the sphere, so a group of copies with small noise is never compared pair by
pair. Groups meet through the cells of all their members; two groups link as a
whole, not at all, or else member by member, as the angle between their leaders
and their radii allow.

Defined results. A vector that is null, empty, zero, or holds a null or
non-finite component links with nothing: no links, its own component, kept; so
does a row without an id, whose component is null. Vectors of different length
do not link. Rows that share an id and a vector count each; an id with several
vectors is one node of a component. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.session import materialise, ship_code

WORDS = 4  # of 64 sketch bits
BITS = 64 * WORDS
#: Rows of one step of the decoder, which holds 240 distances for each of their points.
STEP = 256
#: A cell with so many vectors is searched for tight groups, led by up to LEADERS of them.
CROWD, LEADERS = 32, 4
#: Leaders and members are this close, so two members are at most twice as far apart.
TIGHT = 0.98
#: Sketches may differ by so many standard deviations more than the angle makes likely.
SLACK = 5.5
EPS = 1e-7


@dataclass(frozen=True)
class Lattice:
    """Tables, E8 blocks of a table, scale of the projections, probed neighbours, and the cosine from which vectors link."""

    tables: int = 16
    blocks: int = 2
    scale: float = 0.55
    probes: int = 4
    threshold: float = 0.9
    seed: int = 8

    def __post_init__(self) -> None:
        if self.threshold > math.cos(2 * math.acos(TIGHT)):
            raise ValueError(f"thresholds up to {math.cos(2 * math.acos(TIGHT)):.3f} are possible")


@lru_cache(1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or eight halves with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1.0, -1.0), repeat=2):
            row = np.zeros(8)
            row[i], row[j] = a, b
            out.append(row)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Integers with an even sum: round, and if the sum is odd round the worst coordinate the other way."""
    out = np.rint(x)
    off = x - out
    odd = np.flatnonzero(out.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    out[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return out


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of each row: E8 is D8 and its copy shifted by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors in double precision) by length; rows that link with nothing are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        rows = values[starts[at][:, None] + np.arange(n)]
        most = np.abs(rows).max(1)
        good = np.isfinite(most) & (most > 0)
        rows = rows[good] / most[good, None]
        yield at[good], rows / np.sqrt((rows * rows).sum(1))[:, None]


class Hasher:
    """Home cells, probed cells and sketches of unit vectors of one length."""

    def __init__(self, how: Lattice, length: int) -> None:
        rng = np.random.default_rng([how.seed, length])
        self.how, self.length = how, length
        self.to_blocks = rng.normal(size=(length, how.tables * how.blocks * 8)) * how.scale
        self.to_bits = rng.normal(size=(length, BITS))

    def _hash(self, points: np.ndarray) -> np.ndarray:
        """64-bit hash of (rows, tables, 8 * blocks) doubled coordinates, of the table and of the length."""
        out = np.arange(self.how.tables, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.length)
        for c in range(points.shape[2]):
            out = (out ^ points[:, :, c].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(29))
        return out.view(np.int64)

    def __call__(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        how, n = self.how, len(unit)
        shape = (n, how.tables, how.blocks * 8)
        x = unit @ self.to_blocks
        home = nearest_e8(x.reshape(-1, 8))
        residual = x.reshape(-1, 8) - home
        # |residual - v|**2 grows by 2 - 2 residual.v with each neighbour v, all of which have length sqrt(2)
        near = (residual @ neighbours().T).reshape(n, how.tables, how.blocks * 240)
        best = np.argpartition(-near, how.probes - 1, axis=2)[:, :, : how.probes]
        home = np.rint(2 * home).reshape(shape)
        probes = np.empty((n, how.tables, how.probes), np.int64)
        steps = np.rint(2 * neighbours())
        for p in range(how.probes):
            block, which = np.divmod(best[:, :, p], 240)
            point = home.copy().reshape(n, how.tables, how.blocks, 8)
            np.put_along_axis(point, block[:, :, None, None].repeat(8, 3), np.take_along_axis(point, block[:, :, None, None].repeat(8, 3), 2) + steps[which][:, :, None, :], 2)
            probes[:, :, p] = self._hash(point.reshape(shape))
        bits = np.packbits(unit @ self.to_bits > 0, axis=1).view(np.int64)
        return self._hash(home), probes.reshape(n, -1), bits


def _long_lists(rows: np.ndarray) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(rows.reshape(-1)))


def _identified(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding, digest): a digest of 128 bits of the components, null for vectors that link with nothing."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = [None] * batch.num_rows
            for at, _ in unit_rows(batch.column(1)):
                own = batch.column(1).take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), -1) + 0.0  # -0.0 is 0.0
                for i, row in zip(at.tolist(), own, strict=True):
                    out[i] = hashlib.blake2b(row.tobytes(), digest_size=16).digest()
            known = batch.column(0).is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d if k else None for d, k in zip(out, known, strict=True)], pa.binary())], ["vec_id", "embedding", "digest"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(body, f"vec_id long, embedding {kind}, digest binary")


def _coded(distinct: DataFrame, how: Lattice) -> DataFrame:
    """(digest, homes, probes, sketch) of distinct vectors."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            for at, unit in unit_rows(batch.column(1)):
                if unit.shape[1] not in hashers:
                    hashers[unit.shape[1]] = Hasher(how, unit.shape[1])
                hasher = hashers[unit.shape[1]]
                for s in range(0, len(at), STEP):
                    homes, probes, bits = hasher(unit[s : s + STEP])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[s : s + STEP])), _long_lists(homes), _long_lists(probes), _long_lists(bits)], ["digest", "homes", "probes", "sketch"])

    return distinct.select("digest", "embedding").mapInArrow(body, "digest binary, homes array<long>, probes array<long>, sketch array<long>")


def _dots(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Cosines row by row; -1 where a row links with nothing or lengths differ."""
    out = np.full(len(left), -1.0)
    other = {v.shape[1]: (at, v) for at, v in unit_rows(right)}
    for at, a in unit_rows(left):
        if a.shape[1] in other:
            theirs, b = other[a.shape[1]]
            both, i, j = np.intersect1d(at, theirs, assume_unique=True, return_indices=True)
            out[both] = (a[i] * b[j]).sum(1)
    return out


def _followers(codes: DataFrame, distinct: DataFrame) -> DataFrame | None:
    """(digest, g, angle): vectors of crowded cells that are close to a leader ``g``; None if no cell is crowded."""
    homes = codes.select("digest", F.explode("homes").alias("cell"))
    crowded = materialise(homes.groupBy("cell").count().filter(F.col("count") >= CROWD), "crowded")
    if crowded.isEmpty():
        return None
    # Everyone goes to the most crowded of their cells, so a dense group meets in few places.
    chosen = homes.join(crowded, "cell").groupBy("digest").agg(F.max(F.struct("count", "cell")).alias("best")).select("digest", F.col("best.cell").alias("cell"))
    chosen = materialise(chosen.join(distinct.select("digest", "embedding"), "digest"), "chosen")
    heads = chosen.groupBy("cell").agg(*[F.min(F.struct(F.xxhash64("digest", F.lit(i)).alias("h"), "digest")).alias(f"l{i}") for i in range(LEADERS)])
    heads = heads.select("cell", F.explode(F.array_distinct(F.array(*[F.col(f"l{i}.digest") for i in range(LEADERS)]))).alias("g"))
    leaders = materialise(heads.join(distinct.select(F.col("digest").alias("g"), F.col("embedding").alias("leader")), "g"), "leaders")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = _dots(batch.column("embedding"), batch.column("leader"))
            at = np.flatnonzero(cosine >= TIGHT)
            picked = batch.select(["digest", "g"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), pa.array(np.arccos(np.minimum(cosine[at], 1.0)))], ["digest", "g", "angle"])

    near = chosen.join(leaders, "cell").select("digest", "g", "embedding", "leader").mapInArrow(close, "digest binary, g binary, angle double")
    return materialise(near.groupBy("digest").agg(F.min(F.struct("g", "angle")).alias("m")).select("digest", "m.g", "m.angle"), "followers")


def _most_bits(angle: float) -> int:
    p = min(angle, math.pi) / math.pi
    return math.ceil(BITS * p + SLACK * math.sqrt(BITS * p * (1 - p)))


def _met(codes: DataFrame, followers: DataFrame | None, how: Lattice) -> DataFrame:
    """(g, h), g < h: groups, or vectors outside groups, that meet in a cell where one of them is at home and whose sketches agree."""
    words = [F.col("sketch")[i].alias(f"s{i}") for i in range(WORDS)]

    def cells(rows: DataFrame, *more: Column) -> DataFrame:
        lives = F.transform("homes", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("home")))
        visits = F.transform("probes", lambda c: F.struct(c.alias("cell"), F.lit(False).alias("home")))
        return rows.select(F.explode(F.concat(lives, visits)).alias("c"), *more).select("c.cell", "c.home", "*").drop("c")

    if followers is None:
        rows = cells(codes, F.col("digest").alias("g"), *words).withColumn("many", F.lit(0))
    else:
        alone = codes.join(followers.select("digest"), "digest", "left_anti")
        inside = cells(codes.join(followers.select("digest", "g"), "digest"), F.col("g")).groupBy("cell", "g").agg(F.max("home").alias("home"))
        heads = codes.join(followers.select(F.col("g").alias("digest")).distinct(), "digest").select(F.col("digest").alias("g"), *words)
        rows = cells(alone, F.col("digest").alias("g"), *words).withColumn("many", F.lit(0)).unionByName(inside.join(heads, "g").withColumn("many", F.lit(1)))
    rows = materialise(rows, "cells")
    a, b = rows.filter("home").alias("a"), rows.alias("b")
    differ = sum((F.bit_count(F.col(f"a.s{i}").bitwiseXOR(F.col(f"b.s{i}"))) for i in range(WORDS)), F.lit(0))
    reach, radius = math.acos(how.threshold), math.acos(TIGHT)
    most = F.get(F.array(*[F.lit(_most_bits(reach + k * radius)) for k in range(3)]), F.col("a.many") + F.col("b.many"))
    meet = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.g") != F.col("b.g")) & (~F.col("b.home") | (F.col("a.g") < F.col("b.g"))) & (differ <= most)
    return materialise(a.join(b, meet).select(F.least("a.g", "b.g").alias("g"), F.greatest("a.g", "b.g").alias("h")).distinct(), "met")


def _judged(rows: DataFrame, left: str, right: str, how: Lattice, slack: Column) -> DataFrame:
    """``rows`` with ``verdict`` in place of the vectors: 1 if all pairs within ``slack`` of the two vectors link, 0 if none can, null if it depends."""
    kept = [c for c in rows.columns if c not in (left, right)]
    reach = math.acos(how.threshold)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine, loose = _dots(batch.column(left), batch.column(right)), batch.column("__slack").to_numpy()
            angle = np.arccos(np.clip(cosine, -1, 1))
            sure, never = angle + loose <= reach - EPS, angle - loose > reach + EPS
            verdict = np.where(loose == 0, cosine >= how.threshold, sure)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(verdict.astype(np.int32), mask=(loose > 0) & ~sure & ~never)], [*kept, "verdict"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.withColumn("__slack", slack).mapInArrow(body, f"{schema}, verdict int")


def near_duplicates(rows: DataFrame, how: Lattice = Lattice()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``rows`` (vec_id, embedding), one row per row."""
    ship_code(rows.sparkSession)
    marked = _identified(rows)
    distinct = materialise(marked.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.first("embedding").alias("embedding")), "distinct")
    codes = materialise(_coded(distinct, how), "codes")
    followers = _followers(codes, distinct)
    met = _met(codes, followers, how)

    info = distinct.select("digest", F.col("digest").alias("g"), "embedding", "low", F.col("n").alias("weight"), F.lit(0.0).alias("radius"))
    owners = distinct.select("digest", F.col("digest").alias("g"), F.col("n").alias("total"), "low")
    if followers is not None:
        inside = followers.join(distinct.select("digest", "n", "low"), "digest")
        groups = materialise(inside.groupBy("g").agg(F.sum("n").alias("total"), F.min("low").alias("least"), (F.max("angle") + EPS).alias("width")), "groups")
        info = distinct.join(groups, distinct.digest == groups.g, "left").select("digest", distinct.digest.alias("g"), "embedding", F.coalesce("least", "low").alias("low"), F.coalesce("total", "n").alias("weight"), F.coalesce("width", F.lit(0.0)).alias("radius"))
        mine = followers.select("digest", "g").join(groups.select("g", "total", F.col("least").alias("low")), "g")
        owners = mine.select("digest", "g", "total", "low").unionByName(owners.join(followers.select("digest"), "digest", "left_anti"))

    def of(side: str, *columns: str) -> DataFrame:
        return info.select(F.col("g").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])

    facts = ("embedding", "low", "weight", "radius")
    verified = met.join(of("g", *facts), "g").join(of("h", *facts), "h")
    verified = materialise(_judged(verified, "embedding_g", "embedding_h", how, F.col("radius_g") + F.col("radius_h")).filter("verdict IS NULL OR verdict = 1"), "verified")
    whole = verified.filter("verdict = 1")
    edges = whole.select(F.col("low_g").alias("a"), F.col("low_h").alias("b"))
    by_group = whole.select("g", F.col("weight_h").alias("n")).unionByName(whole.select(F.col("h").alias("g"), F.col("weight_g").alias("n"))).groupBy("g").agg(F.sum("n").alias("links"))
    result = owners.join(by_group, "g", "left").select("digest", "low", (F.col("total") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    if followers is not None and not (open_ := verified.filter("verdict IS NULL")).isEmpty():
        both = ["g", "h", "low_g", "low_h", "radius_h", "weight_h"]
        turned = open_.select(F.col("h").alias("g"), F.col("g").alias("h"), F.col("low_h").alias("low_g"), F.col("low_g").alias("low_h"), F.col("radius_g").alias("radius_h"), F.col("weight_g").alias("weight_h"))
        members = owners.select("digest", "g").join(distinct.select("digest", "embedding", "n"), "digest")
        each = open_.select(*both).unionByName(turned).join(members.select("g", F.col("digest").alias("x"), F.col("embedding").alias("embedding_x")), "g")
        each = each.join(of("h", "embedding"), "h")
        held = materialise(each.select("x", "h", "low_g", "low_h", "radius_h", "weight_h", "embedding_x", "embedding_h"), "held")
        tried = materialise(_judged(held, "embedding_x", "embedding_h", how, F.col("radius_h")).filter("verdict IS NULL OR verdict = 1"), "tried")
        unsure = tried.filter("verdict IS NULL").select("x", "h", "low_g", "low_h").join(distinct.select(F.col("digest").alias("x"), F.col("embedding").alias("embedding_x")), "x")
        unsure = unsure.join(members.select(F.col("g").alias("h"), F.col("embedding").alias("embedding_y"), "n"), "h")
        single = _judged(unsure, "embedding_x", "embedding_y", how, F.lit(0.0)).filter("verdict = 1").groupBy("x", "low_g", "low_h").agg(F.sum("n").alias("n"))
        more = materialise(tried.filter("verdict = 1").select("x", "low_g", "low_h", F.col("weight_h").alias("n")).unionByName(single), "more")
        edges = edges.unionByName(more.select(F.col("low_g").alias("a"), F.col("low_h").alias("b")))
        by_member = more.groupBy(F.col("x").alias("digest")).agg(F.sum("n").alias("more"))
        result = result.join(by_member, "digest", "left").select("digest", "low", (F.col("n_links") + F.coalesce("more", F.lit(0))).alias("n_links"))
    reached = components(edges).withColumnRenamed("id", "low")
    result = materialise(result.join(reached, "low", "left").select("digest", "n_links", F.coalesce("component", "low").alias("component_id")), "links")
    out = marked.select("vec_id", "digest").join(result, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
