"""Phrase collocation mining with depth-limited count tries.

Every task reads its documents in shards of bounded size and builds a count trie
of four words' depth for each language, as sorted arrays: one row for each
distinct path of up to four words, with its count. A shard is serialised sorted,
cut by prefix ranges, and the pieces of one range meet in one group, where the
sorted runs are merged and nodes get their counts. A path is counted once per
position of the text, so the counts of all its prefixes follow by summing.

A node's ancestors on the walk are the left parts of its phrase, and following
suffix links (the phrase without its first word, again and again) gives the right
parts. Nodes that reach over the bounds of a range are few, at most six a range;
their counts are summed over the ranges, and patched into what stands below them.

Range bounds come from a bounded sample of paths (``sample``); they decide where a path
is merged, never what is counted. All arithmetic on counts is exact.

Defined results. A null text is empty, a null language is ``und``; the id is not
used. Ties in score and count are ordered by the phrase's bytes. Words may hold
any signs but the separators. Texts of any length are read in slices. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.session import materialise, ship_code

DEPTH = 4
#: Bytes of text that are cut into words at a time.
SLICE = 1 << 20
RUNS = "part int, lang string, n int, words binary, paths binary, counts binary"
NODES = "lang string, phrase string, k int, f long, l1 long, l2 long, l3 long, shared int, open boolean"


@dataclass(frozen=True)
class Mining:
    """Least count, share of a longer phrase that covers a shorter one, results per language; words of a shard, text bytes of a range, sampled paths."""

    min_count: int = 30
    covered_pct: int = 80
    top: int = 2000
    scale: int = 2_000_000
    shard_words: int = 1_000_000
    range_bytes: int = 8 << 20
    sample: int = 20_000
    sample_docs: int = 4_000


def _table() -> bytes:
    """Byte map: A-Z lower-cased, tab to space, separators to line feed."""
    out = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        out[c] += 32
    out[9] = 32
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        out[c] = 10
    return bytes(out)


TABLE = _table()


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Lists of words and line feeds, a slice at a time; empty strings between spaces."""
    plain = text.translate(TABLE).replace(b"\n", b" \n ")
    start = 0
    while start < len(plain):
        end = len(plain)
        if end - start > SLICE:
            end = plain.rfind(b" ", start, start + SLICE)
            if end <= start and (end := plain.find(b" ", start + SLICE)) < 0:
                end = len(plain)
        yield plain[start:end].split(b" ")
        start = end + 1


class Shard:
    """Words of some documents by language, and the sorted paths of each; ids of words are made while reading."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {b"": -1, b"\n": 0}
        self.read: dict[str, list[np.ndarray]] = {}
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        ids = self.ids
        found = np.fromiter((ids.setdefault(w, len(ids) - 1) for w in words), np.int32, len(words))
        found = found[found >= 0]
        self.size += len(found)
        self.read.setdefault(lang, []).append(found)

    def _ids_of(self, lang: str) -> np.ndarray:
        return np.concatenate(self.read[lang])

    def tails(self) -> dict[str, list[bytes]]:
        """The last words of each language, whose paths go on in the next shard."""
        names = list(self.ids)
        return {lang: [names[i + 1] for i in self._ids_of(lang)[1 - DEPTH :].tolist()] for lang in self.read}

    def paths(self, last: bool) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
        """(lang, sorted words, paths of word numbers from 1, counts); unless ``last``, without the paths that start in the tail."""
        words = sorted(w for w in self.ids if w not in (b"", b"\n"))
        rank = np.zeros(len(words) + 1, np.int32)
        rank[[self.ids[w] for w in words]] = np.arange(1, len(words) + 1)
        for lang in sorted(self.read):
            ids = rank[self._ids_of(lang)]
            yield lang, words, *counted_paths(ids, len(ids) if last else max(0, len(ids) - DEPTH + 1))


def counted_paths(ids: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """(DEPTH, distinct) sorted paths and their counts of the positions before ``stop``; 0 separates pieces and ends a path."""
    at = np.flatnonzero(ids[:stop])
    padded = np.concatenate([ids, np.zeros(DEPTH, np.int32)])
    path = np.empty((DEPTH, len(at)), np.int32)
    path[0] = padded[at]
    for d in range(1, DEPTH):
        path[d] = np.where(path[d - 1] > 0, padded[at + d], 0)
    return merged(path, np.ones(len(at), np.int64))


def merged(path: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort paths and add up the counts of equal ones."""
    if not path.shape[1]:
        return path, counts
    high = path[0].astype(np.int64) << 32 | path[1]
    low = path[2].astype(np.int64) << 32 | path[3]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return path[:, order[first]], np.add.reduceat(counts[order], first)


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


Bound = tuple[bytes, ...]


def cut(lang: str, words: list[bytes], path: np.ndarray, counts: np.ndarray, bounds: list[Bound]) -> Iterator[dict]:
    """The rows of one shard's trie of a language, one for each prefix range that it has paths in."""
    key = lang.encode()
    name = [b"", *words]
    own = [(i, b[1:]) for i, b in enumerate(bounds) if b[0] == key]
    part = bisect_left(bounds, (key,))
    places = [0]
    for _, bound in own:
        places.append(bisect_left(range(path.shape[1]), bound, lo=places[-1], key=lambda i: tuple(name[w] for w in path[:, i])))
    for k, (a, b) in enumerate(zip(places, [*places[1:], path.shape[1]], strict=True)):
        if a < b:
            used, place = np.unique(path[:, a:b], return_inverse=True)
            if used[0]:  # 0, no word, keeps the number 0
                used, place = np.concatenate([[0], used]), place + 1
            yield {"part": part + k, "lang": lang, "n": b - a, "words": b" ".join(name[w] for w in used[1:]), "paths": _pack(place.reshape(DEPTH, -1).astype(np.int32)), "counts": _pack(counts[a:b])}


def _sampled_bounds(docs: DataFrame, how: Mining) -> list[Bound]:
    """Sorted bounds between prefix ranges, of about ``range_bytes`` of text each."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = min(-(-size // how.range_bytes), how.sample)
    if ranges < 2:
        return []

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, keys = [], [[] for _ in range(DEPTH)]
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard()
                for piece in tokens(text):
                    shard.add(lang, piece)
                for _, words, path, _ in shard.paths(True) if shard.read else ():
                    name = [b"", *words]
                    for i in range(len(text) % 16, path.shape[1], 16):
                        langs.append(lang)
                        for d in range(DEPTH):
                            keys[d].append(name[path[d, i]])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), *[pa.array(k, pa.binary()) for k in keys]], ["lang", *[f"w{d}" for d in range(DEPTH)]])

    some = docs.sample(min(1.0, how.sample_docs / rows), seed=13).mapInArrow(body, "lang string, " + ", ".join(f"w{d} binary" for d in range(DEPTH)))
    picked = some.orderBy(F.xxhash64(*some.columns)).limit(how.sample).collect()
    paths = sorted((r[0].encode(), *map(bytes, r[1:])) for r in picked)
    return sorted({paths[len(paths) * i // ranges] for i in range(1, ranges)}) if paths else []


def trie_runs(docs: DataFrame, bounds: list[Bound], how: Mining) -> DataFrame:
    """Serialised tries of all shards, cut by prefix range."""
    shared = docs.sparkSession.sparkContext.broadcast(bounds)  # at most ``sample`` of them

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RUNS.split(", ")]
        types = [pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

        def flushed(shard: Shard, last: bool) -> Iterator[pa.RecordBatch]:
            for found in shard.paths(last) if shard.read else ():
                rows = list(cut(*found, shared.value))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, types, strict=True)], names)

        shard = Shard()
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for piece in tokens(text):
                    shard.add(lang, piece)
                    if shard.size >= how.shard_words:
                        yield from flushed(shard, False)
                        tails = shard.tails()
                        shard = Shard()
                        for k, words in tails.items():
                            shard.add(k, words)
                shard.add(lang, [b"\n"])
        yield from flushed(shard, True)

    return docs.mapInArrow(body, RUNS)


def trie_nodes(lang: str, runs: list[dict], lower: Bound | None, upper: Bound | None, least: int) -> dict[str, list]:
    """Merge the runs of one range and language; nodes that are frequent, or that reach over a bound, with the counts of their ancestors."""
    cut_up = [r["words"].split(b" ") if r["words"] else [] for r in runs]
    words = sorted(set().union(*cut_up))
    number = {w: i + 1 for i, w in enumerate(words)}
    paths, counts = [], []
    for r, own in zip(runs, cut_up, strict=True):
        to = np.array([0, *[number[w] for w in own]], np.int32)
        paths.append(to[_unpack(r["paths"], np.int32, DEPTH * r["n"]).reshape(DEPTH, -1)])
        counts.append(_unpack(r["counts"], np.int64, r["n"]))
    path, count = merged(np.concatenate(paths, axis=1), np.concatenate(counts))
    name = [b"", *words]
    out: dict[str, list] = {c.split()[0]: [] for c in NODES.split(", ")}

    def put(*row: object) -> None:
        for column, value in zip(out.values(), row, strict=True):
            column.append(value)

    put(lang, "", 0, int(count.sum()), 0, 0, 0, 0, False)
    changed = np.zeros(path.shape[1], bool)
    changed[0] = True
    starts, sums, opens = [], [], []
    for d in range(DEPTH):
        changed[1:] |= path[d, 1:] != path[d, :-1]
        start = np.flatnonzero(changed)
        total = np.add.reduceat(count, start)
        # Only the first and the last node of a depth can be part of a bound's path.
        is_open = np.zeros(len(start), bool)
        for i in {0, len(start) - 1} if d < DEPTH - 1 else ():
            own = tuple(name[w] for w in path[: d + 1, start[i]])
            is_open[i] = bool(own[-1]) and any(b is not None and b[: d + 1] == own for b in (lower, upper))
        above = [np.searchsorted(s, start, "right") - 1 for s in starts]
        left = [s[a] for s, a in zip(sums, above, strict=True)]
        shared = sum((o[a].astype(int) for o, a in zip(opens, above, strict=True)), np.zeros(len(start), int))
        for i in np.flatnonzero((path[d, start] > 0) & ((total >= least) | is_open)).tolist():
            phrase = b" ".join(name[w] for w in path[: d + 1, start[i]]).decode()
            put(lang, phrase, d + 1, int(total[i]), *[int(left[j][i]) if j < d else 0 for j in range(DEPTH - 1)], int(shared[i]), bool(is_open[i]))
        starts.append(start)
        sums.append(total)
        opens.append(is_open)
    return out


def _merged_nodes(runs: DataFrame, bounds: list[Bound], how: Mining) -> DataFrame:
    shared = runs.sparkSession.sparkContext.broadcast(bounds)
    least = how.min_count

    def body(key: tuple, table: pa.Table) -> pa.Table:
        part, lang = key[0].as_py(), key[1].as_py()
        mine = lang.encode()
        near = [shared.value[i][1:] if 0 <= i < len(shared.value) and shared.value[i][0] == mine else None for i in (part - 1, part)]
        found = trie_nodes(lang, table.select(["n", "words", "paths", "counts"]).to_pylist(), *near, least)
        types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
        return pa.table({c: pa.array(found[c], types[t]) for c, t in (x.split() for x in NODES.split(", "))})

    return runs.groupBy("part", "lang").applyInArrow(body, NODES)


def frequent_phrases(nodes: DataFrame, how: Mining) -> DataFrame:
    """(lang, phrase, k, f, l1, l2, l3) of complete frequent nodes; ``lj`` is the count of the first j words."""
    open_ = nodes.filter("open").groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).filter(F.col("f") >= how.min_count)
    open_ = materialise(open_, "open-nodes")
    zero = F.lit(0).cast("long")
    closed = nodes.filter("k > 0 AND NOT open").drop("open")
    # What stands above an open node is open.
    rows = closed.unionByName(open_.select("lang", "phrase", "k", "f", *[zero.alias(f"l{j}") for j in (1, 2, 3)], (F.col("k") - 1).alias("shared")))
    patched = rows.filter("shared > 0")
    for j in (1, 2, 3):
        above = open_.filter(F.col("k") == j).select(F.col("lang"), F.col("phrase").alias("__above"), F.col("f").alias("__f"))
        patched = patched.withColumn("__above", F.when(F.col("shared") >= j, F.substring_index("phrase", " ", j))).join(above, ["lang", "__above"], "left").withColumn(f"l{j}", F.coalesce("__f", f"l{j}")).drop("__above", "__f")
    return rows.filter("shared = 0").unionByName(patched).drop("shared")


def _last(phrase: str, words: Column) -> Column:
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), -words)


def collocations(docs: DataFrame, how: Mining = Mining()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language of ``docs`` (text, lang)."""
    ship_code(docs.sparkSession)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    bounds = _sampled_bounds(texts, how)
    nodes = materialise(_merged_nodes(trie_runs(texts, bounds, how), bounds, how), "nodes")
    known = materialise(frequent_phrases(nodes, how), "phrases")
    candidates = known.filter("k >= 2")
    # A suffix link leads to the phrase without its first word; following it j times gives the right part after j words.
    cuts = F.filter(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"l{j}").alias("l"), _last("phrase", F.col("k") - j).alias("rest")) for j in (1, 2, 3)]), lambda c: c["j"] < F.col("k"))
    pieces = candidates.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("lang", "phrase", "k", "a", "c.*")
    scored = pieces.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"cast((cast(a AS decimal(28, 0)) * {how.scale}) div (cast(l AS decimal(28, 0)) + r) AS long)")
    lowest = scored.withColumn("score", score).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "j", "l", "r")).alias("m"))
    parts = [(j, m) for m in (2, 3) for j in range(1, DEPTH - m + 2)]
    inner = F.filter(F.array(*[F.when(F.col("k") >= j + m - 1, F.substring_index(_last("phrase", F.col("k") - (j - 1)), " ", m)) for j, m in parts]), lambda p: p.isNotNull() & (p != F.col("phrase")))
    longer = candidates.filter("k >= 3").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    covered = F.expr(f"coalesce(100 * cast(longer AS decimal(28, 0)) >= {how.covered_pct} * cast(a AS decimal(28, 0)), false)")
    kept = lowest.join(longer, ["lang", "phrase"], "left").filter(~covered)
    order = Window.partitionBy("lang").orderBy(F.desc("m.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= how.top)
    totals = nodes.filter("k = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score")
