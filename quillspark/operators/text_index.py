"""A stored inverted index: BM25 that reads only the buckets of its terms.

Layout of an index folder::

    segments/<id>/bucket=<n>/*.parquet   postings of one window of documents for the terms of one bucket, a row each
    commits/<id>/*.parquet               one row that makes the segment visible

A window is up to ``WINDOW`` documents that one task read together, so its
postings are gathered where the texts are, and travel to the bucket of their
term's hash as they are stored: columns of numbers, each compressed, beside the
keys and lengths of the window's documents, which stand there once and not once
a posting. A query reads the buckets of its terms and makes blocks of them: the
postings of one term in one window, with the best (count, length) pairs, those
that no other pair beats in both. From them follows the largest score that the
term can add in the window, whatever the corpus has grown to since.

A top-k query scores the windows with the largest bounds first; windows whose bound
does not reach the k-th score found there are never opened. New documents are
appended as segments; ``merge`` packs many segments into one and retires them with
the same commit row; full windows go over as they are, others are joined. A segment without its row is not seen, so a failed write
leaves the index as it was.

Defined results: a null or empty text counts as a document of length 0 that no term
finds; rows that share a key are documents of their own.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.session import ship_code

WINDOW = 1024
#: Windows that a top-k query scores to find out which others can matter.
PROBE = 32
#: Bucket of the blocks that list the documents themselves, under the empty term.
DOCUMENTS = -1
#: Stands for scores that are rounded up.
ROUNDING = 1e-6

#: A row of a segment: ``n`` documents of ``total`` words in the window; ``terms`` and ``keys`` are Arrow streams, the others packed numbers.
STORED = "window bigint, n int, total bigint, terms binary, sizes binary, docs binary, tfs binary, places binary, keys binary, dls binary"
ROWS = f"bucket int, {STORED}"
#: Bytes of a file's row group: a reader holds one at once.
ROW_GROUP = 16 << 20
KEYS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}

Analyser = Callable[[list[str]], list[str | None]]


def _frontier(row: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
    """Places of the postings that no other of their row beats: ordered by row, each has more words than all with a higher count."""
    order = np.lexsort((dl, -tf, row))
    # Rows are set apart by more than any length, so one running minimum serves all of them.
    level = dl[order].astype(np.int64) - row[order].astype(np.int64) * (int(dl.max(initial=0)) + 1)
    least = np.minimum.accumulate(level)
    return order[np.concatenate([[True], level[1:] < least[:-1]])] if len(order) else order


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def _int_lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return _lists(pa.array(values.astype(np.int32)), ends)


def _packed(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes: most of the upper bytes are zero."""
    return pa.compress(values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(packed, 4 * int(n), codec="zstd"), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _streamed(values: pa.Array) -> bytes:
    batch, sink = pa.RecordBatch.from_arrays([values], ["v"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _values(streamed: bytes) -> pa.Array:
    return pa.ipc.open_stream(streamed).read_next_batch().column(0)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 7]
    names = [c.split()[0] for c in ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _window_rows(keys: pa.Array, words: pa.ListArray, analyse: Analyser | None, window: int, buckets: int) -> pa.RecordBatch:
    """One window's row for each bucket that it has terms of, and the row of its documents under the empty term."""
    lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(words.flatten())
    names = coded.dictionary.to_pylist()
    # The analyser sees every distinct word of the window once.
    terms = names if analyse is None else analyse(names)
    distinct = {t: i for i, t in enumerate(dict.fromkeys(filter(None, terms)))}
    at = np.array([zlib.crc32(t.encode()) % buckets for t in distinct], np.int64)
    # Terms are numbered bucket by bucket, so that those of a bucket stand together, as their postings then do.
    by_bucket = np.argsort(at, kind="stable")
    number = np.full(len(distinct) + 1, -1)  # the last is that of words left out
    number[by_bucket] = np.arange(len(distinct))
    known = pa.array(distinct, pa.string()).take(pa.array(by_bucket))
    term = number[[distinct.get(t, -1) for t in terms]][coded.indices.to_numpy(zero_copy_only=False)] if names else number[:0]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    doc, place, term = doc[term >= 0], place[term >= 0], term[term >= 0]
    dl = np.bincount(doc, minlength=len(lengths))
    # Documents and places are in order, so terms alone are sorted: by halves, since stable sorts of 16 bits are linear.
    order = np.argsort(term.astype(np.uint16), kind="stable")
    order = order[np.argsort((term[order] >> 16).astype(np.uint16), kind="stable")]
    term, doc, place = term[order], doc[order], place[order]
    first = np.flatnonzero(np.diff(term * len(lengths) + doc, prepend=-1))
    row, own = term[first], doc[first]
    # The postings, and the places, up to each term; places of a posting stand one after another.
    ends, upto = np.append(0, np.cumsum(np.bincount(row, minlength=len(known)))), np.append(first, len(term))
    tf = np.diff(upto)
    documents = (window, len(lengths), int(dl.sum()))
    who = (_streamed(keys), _packed(dl))
    zeros = np.zeros(len(lengths), np.int32)
    rows = [(DOCUMENTS, *documents, _streamed(pa.array([""])), _packed(np.array([len(lengths)])), _packed(np.arange(len(lengths))), _packed(zeros), _packed(zeros[:0]), *who)]
    cuts = np.append(0, np.cumsum(np.bincount(at, minlength=buckets)))
    for bucket in np.unique(at):
        a, b = cuts[bucket], cuts[bucket + 1]
        p, q = ends[a], ends[b]
        rows.append((bucket, *documents, _streamed(known[a:b]), _packed(np.diff(ends[a : b + 1])), _packed(own[p:q]), _packed(tf[p:q]), _packed(place[upto[p] : upto[q]]), *who))
    return _rows(rows)


def _joined(pieces: pa.Table) -> pa.Table:
    """Rows of one bucket that go into one window, as one row; ``offset`` has the documents before each.

    A window without a term of the bucket has no row here: its documents keep their numbers, without keys and lengths.
    """
    parts = sorted(pieces.to_pylist(), key=lambda r: r["offset"])
    names = [_values(r["terms"]).to_pylist() for r in parts]
    known = sorted({t for ts in names for t in ts})
    number = {t: i for i, t in enumerate(known)}
    whole, words = parts[0]["whole"], parts[0]["words"]
    keys, dls, have = [], np.zeros(whole, np.int32), 0
    term, docs, tfs, places = [], [], [], []
    for r, ts in zip(parts, names, strict=True):
        sizes = _unpacked(r["sizes"], len(ts))
        term.append(np.repeat(np.array([number[t] for t in ts], np.int64), sizes))
        docs.append(_unpacked(r["docs"], sizes.sum()) + r["offset"])
        tfs.append(_unpacked(r["tfs"], sizes.sum()))
        places.append(_unpacked(r["places"], tfs[-1].sum()))
        own = _values(r["keys"])
        keys += [pa.nulls(r["offset"] - have, own.type), own]
        have = r["offset"] + len(own)
        dls[r["offset"] : have] = _unpacked(r["dls"], r["n"])
    keys.append(pa.nulls(whole - have, own.type))
    term, docs, tfs, places = (np.concatenate(x) for x in (term, docs, tfs, places))
    order = np.argsort(term, kind="stable")
    moved = places[np.argsort(np.repeat(term, tfs), kind="stable")]
    row = (parts[0]["bucket"], parts[0]["into"], whole, words, _streamed(pa.array(known)), _packed(np.bincount(term)), _packed(docs[order]), _packed(tfs[order]), _packed(moved), _streamed(pa.concat_arrays(keys)), _packed(dls))
    return pa.Table.from_batches([_rows([row])])


def _blocks(batches: Iterator[pa.RecordBatch], terms: list[str], placed: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of ``terms`` from stored rows, with places by posting if ``placed``."""
    wanted = pa.array(terms)
    for batch in batches:
        heads, best_tf, best_dl, docs, keys, tfs, dls, places = ([] for _ in range(8))
        for r in batch.to_pylist():
            names = _values(r["terms"])
            found = np.flatnonzero(pc.is_in(names, value_set=wanted).to_numpy(zero_copy_only=False))
            if not len(found):
                continue
            ends = np.cumsum(_unpacked(r["sizes"], len(names)))
            all_docs, all_tfs, lengths, owners = _unpacked(r["docs"], ends[-1]), _unpacked(r["tfs"], ends[-1]), _unpacked(r["dls"], r["n"]), _values(r["keys"])
            at = np.append(0, np.cumsum(all_tfs))
            all_places = _unpacked(r["places"], at[-1]) if placed else None
            for t in found:
                a, b = ends[t - 1] if t else 0, ends[t]
                own, tf = all_docs[a:b], all_tfs[a:b]
                dl = lengths[own]
                best = _frontier(np.zeros(b - a, np.int64), tf, dl)
                name = names[int(t)].as_py()
                heads.append((r["segment"], name, r["window"], b - a, tf.sum() if name else r["total"]))
                for held, part in ((best_tf, tf[best]), (best_dl, dl[best]), (docs, own), (tfs, tf), (dls, dl), (keys, owners.take(pa.array(own)))):
                    held.append(part)
                places.append(all_places[at[a] : at[b]] if placed else own[:0])
        if heads:
            ints = lambda parts: _int_lists(np.concatenate(parts), np.cumsum([len(x) for x in parts]))
            posted, counts = np.cumsum([len(x) for x in docs]), np.concatenate(tfs)
            each = _int_lists(np.concatenate(places), np.cumsum(counts if placed else 0 * counts))
            head = [pa.array(c, t) for c, t in zip(zip(*heads, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            made = [*head, ints(best_tf), ints(best_dl), ints(docs), _lists(pa.concat_arrays(keys), posted), ints(tfs), ints(dls), _lists(each, posted)]
            yield pa.RecordBatch.from_arrays(made, ["segment", "term", "window", "n", "total", "top_tf", "top_dl", "docs", "keys", "tfs", "dls", "places"])


class TextIndex:
    """An index in a folder, by keys of type bigint, int or string. A query reads the whole buckets of its terms, so
    ``buckets`` should grow with the texts (128 for 1 GB); a bucket of a segment has ``files`` files at least, if it has
    windows enough. ``analyser`` maps the distinct words of a window to terms, or None for words to leave out; the same one must be given again when the index is opened."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint", buckets: int = 128, files: int = 1, analyser: Analyser | None = None) -> None:
        self.spark, self.path, self.key_type, self.buckets, self.files, self.analyser = spark, path.rstrip("/"), key_type, buckets, files, analyser
        self.live: list = []
        self.refresh()

    @property
    def schema(self) -> str:
        """Of blocks; each posting has a list of places."""
        return f"segment string, term string, window bigint, n int, total bigint, top_tf array<int>, top_dl array<int>, docs array<int>, keys array<{self.key_type}>, tfs array<int>, dls array<int>, places array<array<int>>"

    def refresh(self) -> None:
        """Read the commit rows: which segments are live, and their sums."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/commits/*").collect()  # one row a segment
        except AnalysisException:
            rows = []
        retired = {s for r in rows for s in r.replaces}
        self.live = sorted((r for r in rows if r.segment not in retired), key=lambda r: r.segment)

    @property
    def n_docs(self) -> int:
        return sum(r.n_docs for r in self.live)

    @property
    def mean_length(self) -> float:
        return sum(r.total for r in self.live) / max(1, self.n_docs)

    def bucket_of(self, term: str) -> int:
        return zlib.crc32(term.encode()) % self.buckets if term else DOCUMENTS

    def append(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Index ``docs`` as a new segment."""
        ship_code(self.spark)
        analyse, kind, buckets = self.analyser, self.key_type, self.buckets

        def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            window = TaskContext.get().partitionId() << 32

            def flushed(most: int) -> Iterator[pa.RecordBatch]:
                nonlocal held, window
                whole = pa.Table.from_batches(held).combine_chunks() if held else None
                start = 0
                while whole is not None and whole.num_rows - start >= most and start < whole.num_rows:
                    part = whole.slice(start, WINDOW).combine_chunks()
                    yield _window_rows(part.column(0).combine_chunks(), part.column(1).combine_chunks(), analyse, window, buckets)
                    window, start = window + 1, start + WINDOW
                held = whole.slice(start).to_batches() if whole is not None else []

            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= WINDOW:
                    yield from flushed(WINDOW)
            yield from flushed(1)

        rows = docs.select(F.col(key).cast(kind).alias("key"), T.tokens(F.col(text)).alias("words")).mapInArrow(body, ROWS)
        self._write(rows, [])

    def _write(self, rows: DataFrame, replaces: list[str]) -> None:
        segment = uuid.uuid4().hex
        folder = f"{self.path}/segments/{segment}"
        # Every bucket gets a row without a window, so that every folder is there to be read.
        marks = self.spark.range(-1, self.buckets, numPartitions=1).selectExpr("cast(id AS int) AS bucket")
        # By bucket, and tasks of a fitting size: a large bucket is written by several, small ones by one together.
        placed = rows.unionByName(marks, allowMissingColumns=True).withColumn("file", F.pmod(F.xxhash64("window"), F.lit(self.files)))
        placed = placed.hint("rebalance", (self.buckets + 1) * self.files, "bucket", "file").drop("file")
        placed.write.partitionBy("bucket").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(folder)
        documents = self.spark.read.schema(STORED).parquet(f"{folder}/bucket={DOCUMENTS}").filter("window IS NOT NULL")
        row = documents.agg(F.lit(segment).alias("segment"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.count("*").alias("windows"), F.array(*[F.lit(s) for s in replaces]).cast("array<string>").alias("replaces"))
        row.coalesce(1).write.parquet(f"{self.path}/commits/{segment}")
        self.refresh()

    def _segment(self, name: str, *buckets: int) -> DataFrame:
        """Stored rows of a segment: of all buckets, or of some without their numbers."""
        folder = f"{self.path}/segments/{name}"
        read = self.spark.read.schema(STORED if buckets else ROWS)
        rows = read.parquet(*[f"{folder}/bucket={b}" for b in buckets] or [folder])
        return rows.filter("window IS NOT NULL").withColumn("segment", F.lit(name))

    def merge(self, smaller_than: int | None = None) -> None:
        """Pack the live segments (those of fewer documents than ``smaller_than``) into one; windows that are not full are joined until they are."""
        old = [r for r in self.live if smaller_than is None or r.n_docs < smaller_than]
        if len(old) < 2:
            return
        ship_code(self.spark)
        # One row a window: where it goes, and how many documents stand before its own there.
        windows = reduce(DataFrame.unionByName, [self._segment(r.segment, DOCUMENTS) for r in old])
        order, same = Window.orderBy("segment", "window"), Window.partitionBy("into")
        before = F.coalesce(F.sum(F.when(F.col("n") < WINDOW, F.col("n"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = windows.select("segment", "window", "n", "total", before.alias("start"), F.row_number().over(order).cast("bigint").alias("row"))
        placed = placed.selectExpr("segment", "window", "n", "total", "start", f"IF(n < {WINDOW}, -1 - start div {WINDOW}, row) AS into")
        joint = {"offset": F.col("start") - F.min("start").over(same), "together": F.count("*").over(same), "whole": F.sum("n").over(same), "words": F.sum("total").over(same)}
        placed = placed.select("segment", "window", "into", *[c.alias(name) for name, c in joint.items()])
        rows = reduce(DataFrame.unionByName, [self._segment(r.segment) for r in old]).join(F.broadcast(placed), ["segment", "window"])
        names = [c.split()[0] for c in ROWS.split(", ")]
        alone = rows.filter("together = 1").withColumn("window", F.col("into")).select(names)
        joined = rows.filter("together > 1").groupBy("bucket", "into").applyInArrow(_joined, ROWS)
        self._write(alone.unionByName(joined), [r.segment for r in old])

    def blocks(self, terms: list[str], placed: bool = False, windows: DataFrame | None = None) -> DataFrame:
        """Blocks of ``terms``, from their buckets alone, in all windows or those of ``windows`` (segment, window); places only if ``placed``."""
        wanted = sorted({self.bucket_of(t) for t in terms})
        if not self.live or not wanted:
            return self.spark.createDataFrame([], self.schema)
        ship_code(self.spark)
        rows = reduce(DataFrame.unionByName, [self._segment(r.segment, *wanted) for r in self.live])
        rows = rows if windows is None else rows.join(windows, ["segment", "window"], "left_semi")
        rows = rows.select("segment", "window", "n", "total", "terms", "sizes", "docs", "tfs", "keys", "dls", *(["places"] if placed else []))
        return rows.mapInArrow(lambda batches: _blocks(batches, terms, placed), self.schema)

    def vocabulary(self) -> DataFrame:
        """(term, n_docs, n_occurrences) of the whole index."""
        if not self.live:
            return self.spark.createDataFrame([], "term string, n_docs bigint, n_occurrences bigint")
        ship_code(self.spark)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    names = _values(r["terms"])
                    sizes = _unpacked(r["sizes"], len(names))
                    totals = np.add.reduceat(_unpacked(r["tfs"], sizes.sum()), np.cumsum(sizes) - sizes, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([names, pa.array(sizes), pa.array(totals)], ["term", "n", "total"])

        rows = reduce(DataFrame.unionByName, [self._segment(r.segment) for r in self.live]).filter(f"bucket <> {DOCUMENTS}")
        return rows.select("terms", "sizes", "tfs").mapInArrow(counted, "term string, n int, total bigint").groupBy("term").agg(F.sum("n").alias("n_docs"), F.sum("total").alias("n_occurrences"))

    def _terms(self, words: list[str]) -> list[str | None]:
        """Terms of query words, None for those that the analyser leaves out."""
        return list(words) if self.analyser is None else self.analyser(list(words))

    def scores(self, terms: list[str], key: str = "doc_id", k: int | None = None, all_terms: bool = False, query: str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, score) of the documents with any (or all) of ``terms``, or that match ``query``; with ``k`` at least the best k.

        ``query`` has the grammar of ``functions.text.parse_query`` and is ranked by its positive words.
        """
        groups: list[list[tuple[bool, list[tuple[int, str]]]]] = []
        if query is not None:
            for group in T.query_groups(query):
                found = [(negated, [(i, t) for i, t in enumerate(self._terms(T.query_words(words))) if t]) for negated, words in group]
                groups.append([f for f in found if f[1]])
            groups = [g for g in groups if g]
            ranked = list(dict.fromkeys(t for g in groups for negated, ts in g if not negated for _, t in ts))
        else:
            ranked = list(dict.fromkeys(t for t in self._terms(terms) if t))
        needed = list(dict.fromkeys([*ranked, *(t for g in groups for _, ts in g for _, t in ts)]))
        # A group of negated words alone matches documents that no posting names.
        listed = any(all(negated for negated, _ in g) for g in groups)
        phrases = {t for g in groups for _, ts in g if len(ts) > 1 for _, t in ts}
        if not ranked and not listed:
            return self.spark.createDataFrame([], f"`{key}` {self.key_type}, score double")
        asked = [*needed, *([""] if listed else [])]
        blocks = self.blocks(asked, bool(phrases))
        # Expressions are SQL text: one call for each, where columns built up piece by piece take hundreds.
        numbers = blocks.agg(*[F.expr(f"coalesce(sum(CASE WHEN term = {T.sql_string(t)} THEN n END), 0L) AS df{i}") for i, t in enumerate(ranked)] or [F.expr("0 AS df")])
        mean = T.sql_double(self.mean_length)

        def idf(i: int) -> str:
            return f"ln(1 + ({self.n_docs}L - df{i} + 0.5D) / (df{i} + 0.5D))"

        def share(tf: str, dl: str) -> str:
            return f"* {tf} * {T.sql_double(k1 + 1)} / ({tf} + {T.sql_double(k1)} * ({T.sql_double(1 - b)} + {T.sql_double(b)} * {dl} / {mean}))"

        def passes() -> str:
            def one(negated: bool, ts: list[tuple[int, str]]) -> str:
                hit = " AND ".join(f"tf{needed.index(t)} > 0" for _, t in ts)
                if len(ts) > 1:
                    start, first = ts[0]
                    behind = " AND ".join(f"array_contains(coalesce(at{needed.index(t)}, array()), p + {i - start})" for i, t in ts[1:])
                    hit = f"{hit} AND exists(coalesce(at{needed.index(first)}, array()), p -> {behind})"
                return f"NOT ({hit})" if negated else hit

            if query is None:
                return (" AND " if all_terms else " OR ").join(f"tf{i} > 0" for i in range(len(ranked)))
            return " OR ".join("(" + " AND ".join(one(*t) for t in g) + ")" for g in groups)

        def scored(rows: DataFrame) -> DataFrame:
            zipped = "docs, keys, tfs, dls" + (", places" if phrases else "")
            p = rows.selectExpr("segment", "window", "term", f"explode(arrays_zip({zipped})) AS p")
            count = [f"coalesce(max(CASE WHEN term = {T.sql_string(t)} THEN p.tfs END), 0) AS tf{i}" for i, t in enumerate(needed)]
            where = [f"max(CASE WHEN term = {T.sql_string(t)} THEN p.places END) AS at{i}" for i, t in enumerate(needed) if t in phrases]
            each = p.groupBy("segment", "window", "p.docs").agg(*[F.expr(x) for x in ("max(p.keys) AS key", "max(p.dls) AS dl", *count, *where)]).filter(passes())
            total = " + ".join(idf(i) + share(f"tf{i}", "dl") for i in range(len(ranked))) or "0.0D"
            return each.join(F.broadcast(numbers)).selectExpr(f"key AS `{key}`", f"round({total}, 6) AS score")  # numbers is one row

        if k is None or listed or sum(r.windows for r in self.live) <= PROBE:
            return scored(blocks)
        weight = "CASE term " + " ".join(f"WHEN {T.sql_string(t)} THEN {idf(i)}" for i, t in enumerate(ranked)) + " END"
        most = f"array_max(transform(arrays_zip(top_tf, top_dl), x -> 1.0D {share('x.top_tf', 'x.top_dl')}))"
        bounds = blocks.filter(F.col("term").isin(ranked)).selectExpr("segment", "window", "term", f"{most} AS most").join(F.broadcast(numbers))
        bounds = bounds.groupBy("segment", "window").agg(F.expr(f"sum({weight} * most) + {T.sql_double(ROUNDING)} AS bound"))
        first = bounds.orderBy(F.desc("bound"), "segment", "window").limit(PROBE)
        kth = scored(self.blocks(asked, bool(phrases), F.broadcast(first))).orderBy(F.desc("score")).limit(k).agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        worth = bounds.join(F.broadcast(kth)).filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))).select("segment", "window")
        return scored(self.blocks(asked, bool(phrases), F.broadcast(worth)))  # a row a window at most
