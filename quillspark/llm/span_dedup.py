"""Removal of byte strings that an earlier document holds, by a run-length index.

A byte goes if a 50-byte string over it also starts in a document of smaller id.

1. Copies. A text that equals the whole text of a smaller id goes whole; such
   rows leave before anything else, by a digest of the text.
2. Anchors. Every 50-byte string holds the smallest hash of its 16-byte grams,
   so two documents that share the string share that gram at the same place.
   Only anchors leave the scan, packed eight bytes each.
3. Sources. An anchor's source is the smallest document that holds it, with the
   block of that document in which it lies; anchors of one document only end
   here. Each (bucket, salt) sends one anchor per hash for this, and is told the
   sources of the shared ones.
4. Regions. Anchors of a document with one source block that follow each other
   make one region, up to 49 bytes wider than its anchors. An anchor that very
   many documents hold is a source of its own, so what meets stays bounded.
5. Index. Regions that share a source block meet in one bucket. The window
   around each anchor is cut to what another window of that anchor shares, on
   either side; windows of equal bytes then count once: the later ones go whole.
   The rest becomes a run-compressed transform with sampled run ends, through which
   all but the smallest documents of an anchor stream their matching statistics.
   A match of 50 bytes leads to a row, its group to the smallest document with
   those bytes.

Defined results: null or empty text has 0 bytes and the digest of nothing;
strings never cross documents; documents below 50 bytes are kept; rows that
share an id are meant to be equal rows, and never remove from each other; an
empty table gives an empty result; extra columns are ignored; a null id counts
as the smallest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.idmap import bits_of, hash_of, id_map, marked
from quillspark.llm.run_index import RunIndex
from quillspark.llm.shingles import mix
from quillspark.session import materialise, ship_code

#: Stands for a null id: the smallest one.
NO_ID = -(1 << 63)
LENGTH = 50
GRAM = 16
WINDOW = LENGTH - GRAM + 1
PIECE = 1 << 20
SALTS = 4
#: Bytes of text whose anchors share a bucket, and bytes of text whose regions share an index.
ANCHOR_BUCKET = 12 << 20
INDEX_BUCKET = 4 << 20
#: Regions of which a task remembers that it has met them.
MOST_SEEN = 1_000_000
#: Bytes of a source document whose anchors keep together; documents from which on an anchor is a source of its own.
SOURCE_BLOCK = 512
HOT = 2_000
SEGMENT = 1024
#: Bytes of regions that one index covers, or one source's if that is more.
TOGETHER = 1 << 20


def anchors(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the chosen grams of concatenated pieces that end at ``cuts``."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    v = data.astype(np.uint64)
    for k in (1, 2, 4):
        v = v[:-k] | (v[k:] << np.uint64(8 * k))
    gram = mix(v[:-8] * np.uint64(0x9E3779B97F4A7C15) + v[8:] * np.uint64(0xD6E8FEB86659FD93))
    low = np.uint64((1 << 22) - 1)
    best = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    for k in (1, 2, 4, 8, 16):
        best = np.minimum(best[:-k], best[k:])
    best = np.minimum(best[: -(WINDOW - 32)], best[WINDOW - 32 :])
    starts = np.arange(len(best))
    inside = starts + LENGTH <= cuts[np.searchsorted(cuts, starts, "right")]
    at = np.unique((best[inside] & low).astype(np.int64))
    return at, gram[at]


def _pieces(texts: Iterator[bytes]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Batches (document numbers, offsets, bytes, cuts) of about PIECE bytes; long texts overlap by LENGTH - 1."""
    who, offsets, parts, total = [], [], [], 0
    for i, data in enumerate(texts):
        for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
            part = data[at : at + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            who.append(i)
            offsets.append(at)
            parts.append(part)
            total += len(part)
            if total >= PIECE:
                yield who, offsets, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])
                who, offsets, parts, total = [], [], [], 0
    if parts:
        yield who, offsets, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def _located(ids: np.ndarray, texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, ids, places in the text) of all anchors."""
    for who, offsets, data, cuts in _pieces(texts):
        at, h = anchors(data, cuts)
        k = np.searchsorted(cuts, at, "right")
        begins = np.concatenate([[0], cuts[:-1]])
        yield h, ids[np.array(who)[k]], at - begins[k] + np.array(offsets)[k]


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield (x.as_py() or "").encode("utf-8", "surrogatepass")


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values as deflated planes of the bytes of their differences."""
    gaps = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    return zlib.compress(gaps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def anchor_blobs(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, salt, h, doc, place, ids): packed anchors of a batch, in order of document and place.

    Hashes keep their upper half beside the bucket; doc counts into ids.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.array([NO_ID if i is None else i for i in batch.column(0).to_pylist()], np.int64)
            names = np.unique(ids)
            got = list(_located(np.searchsorted(names, ids), _bytes(batch.column(1))))
            if not got:
                continue
            h, doc, place = (np.concatenate(x) for x in zip(*got, strict=True))
            where = (h % np.uint64(buckets)).astype(np.int64)
            h = (h >> np.uint64(32)).astype(np.uint32)
            table = zlib.compress(names.tobytes(), 1)
            salt = int(h[0]) % SALTS
            order = np.lexsort((place, doc, where))
            cuts = np.searchsorted(where[order], np.arange(buckets + 1))
            out: list[tuple] = []
            for b in range(buckets):
                mine = order[cuts[b] : cuts[b + 1]]
                if len(mine):
                    out.append((b, salt, h[mine].tobytes(), _pack(doc[mine]), _pack(place[mine]), table))
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["bucket", "salt", "h", "doc", "place", "ids"])

    return rows.mapInArrow(body, "bucket int, salt int, h binary, doc binary, place binary, ids binary")


def _named(values: np.ndarray) -> tuple[bytes, bytes]:
    """64-bit values as packed places in a packed table."""
    names, places = np.unique(values, return_inverse=True)
    return zlib.compress(names.tobytes(), 1), _pack(places)


def _names(table: bytes, places: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(table), np.int64)[_unpack(places)]


def _opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, id, place) of all blobs of a group."""
    parts = [(np.frombuffer(h, np.uint32), _names(ids, doc), _unpack(place)) for h, doc, place, ids in zip(*(table.column(c).to_pylist() for c in ("h", "doc", "place", "ids")), strict=True)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _begins(h: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], h[1:] != h[:-1]])


def heads(blobs: DataFrame) -> DataFrame:
    """(bucket, h, doc, ids, block, many): by (bucket, salt), one anchor per hash: its smallest id, the block of its first place there, and how many documents have it."""

    def body(group: pa.Table) -> pa.Table:
        h, doc, place = _opened(group)
        by = np.lexsort((place, doc, h))
        h, doc, place = h[by], doc[by], place[by]
        new = _begins(h)
        first = np.flatnonzero(new)
        other = np.concatenate([[True], doc[1:] != doc[:-1]]) | new
        ids, docs = _named(doc[first])
        packed = (_pack(h[first]), docs, ids, _pack(place[first] // SOURCE_BLOCK), _pack(np.add.reduceat(other, first, dtype=np.uint32)))
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), **{n: pa.array([x], pa.binary()) for n, x in zip(("h", "doc", "ids", "block", "many"), packed, strict=True)}})

    return blobs.groupBy("bucket", "salt").applyInArrow(body, "bucket int, h binary, doc binary, ids binary, block binary, many binary")


def sources(found: DataFrame) -> DataFrame:
    """(bucket, h, src, ids, block): packed hashes that two documents or more hold, with the smallest and its block.

    block is 0 for an anchor of HOT documents or more, else one more than the block's number.
    """

    def body(group: pa.Table) -> pa.Table:
        parts = [(_unpack(h), _names(ids, doc), _unpack(block), _unpack(many)) for h, doc, ids, block, many in zip(*(group.column(c).to_pylist() for c in ("h", "doc", "ids", "block", "many")), strict=True)]
        h, doc, block, many = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((block, doc, h))
        h, doc, block, many = h[by], doc[by], block[by], many[by].astype(np.int64)
        first = np.flatnonzero(_begins(h))
        last = np.append(first[1:], len(h)) - 1
        held = np.add.reduceat(many, first)
        shared = (many[first] > 1) | (doc[first] != doc[last])
        first, held = first[shared], held[shared]
        ids, docs = _named(doc[first])
        packed = (_pack(h[first]), docs, ids, _pack(np.where(held >= HOT, 0, block[first] + 1)))
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), **{n: pa.array([x], pa.binary()) for n, x in zip(("h", "src", "ids", "block"), packed, strict=True)}})

    return found.groupBy("bucket").applyInArrow(body, "bucket int, h binary, src binary, ids binary, block binary")


def shared_places(blobs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, src, block, place) of every anchor that has a source; a hot anchor's src is its hash."""

    def body(occurrences: pa.Table, known: pa.Table) -> pa.Table:
        none = pa.table({"id": pa.array([], pa.int64()), "src": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "place": pa.array([], pa.int32())})
        if not occurrences.num_rows or not known.num_rows:
            return none
        h, doc, place = _opened(occurrences)
        row = known.slice(0, 1).to_pylist()[0]
        key, src, block = _unpack(row["h"]), _names(row["ids"], row["src"]), _unpack(row["block"]).astype(np.int32)
        if not len(key):
            return none
        at = np.minimum(np.searchsorted(key, h), len(key) - 1)
        hit = key[at] == h
        at = at[hit]
        hot = (key[at].astype(np.int64) << 20) | (row["bucket"] % (1 << 20))
        return pa.table({"id": doc[hit], "src": np.where(block[at] == 0, hot, src[at]), "block": block[at], "place": place[hit].astype(np.int32)})

    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return blobs.groupBy("bucket", "salt").cogroup(salted.groupBy("bucket", "salt")).applyInArrow(body, "id long, src long, block int, place int")


def regions(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(id, src, block, start, size, data): the regions of all documents with shared anchors. ``texts`` has (doc_id, z).

    A region whose bytes a smaller document of the task has as well, for the same
    source block, goes whole: it comes without data.
    """
    per_doc = places.groupBy("id").agg(F.collect_list(F.struct("place", "src", "block")).alias("hits"))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for i, z, hits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = opened.decompress(z.as_py())
                place, src, block = (hits.values.field(k).to_numpy() for k in range(3))
                by = np.lexsort((place, block, src))
                place, src, block = place[by].astype(np.int64), src[by], block[by]
                low, high = np.maximum(0, place - WINDOW + 1), np.minimum(len(data), place + LENGTH)
                inside = low < high  # places of another row that shares the id may lie beyond this text
                src, block, low, high = src[inside], block[inside], low[inside], high[inside]
                if not len(src):
                    continue
                cut = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (block[1:] != block[:-1]) | (low[1:] > high[:-1])]))
                last = np.append(cut[1:], len(src)) - 1
                for owner, part, s, e in zip(src[cut].tolist(), block[cut].tolist(), low[cut].tolist(), high[last].tolist(), strict=True):
                    piece = data[s:e]
                    key = xxhash.xxh3_128_digest(piece + b"%d,%d" % (owner, part))
                    first = seen.get(key)
                    if first is None or i < first:
                        if len(seen) > MOST_SEEN:
                            seen.clear()
                        seen[key] = i
                    known = first is not None and first < i and e - s >= LENGTH
                    out.append((i, owner, part, s, e - s, None if known else piece))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["id", "src", "block", "start", "size", "data"])

    joined = texts.join(per_doc, texts.doc_id == per_doc.id).select("doc_id", "z", "hits")
    return joined.mapInArrow(body, "id long, src long, block int, start int, size int, data binary")


def _streamed(index: RunIndex, text: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics of all regions. A match looks at most LENGTH ahead, so
    long regions stream as segments that overlap by LENGTH and keep what lies before."""
    counts = np.maximum(1, -(-(ends - begins) // SEGMENT))
    owner = np.repeat(np.arange(len(begins)), counts)
    first = begins[owner] + SEGMENT * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
    # Odd and even segments apart: neighbours overlap in the arrays that a pass fills.
    length, row = np.zeros(len(text), np.int16), np.zeros(len(text), np.int64)
    for turn in (0, 1):
        mine = first[turn::2]
        if not len(mine):
            continue
        whose = ends[owner[turn::2]]
        some_length, some_row = index.stream(text, mine, np.minimum(mine + SEGMENT + LENGTH, whose))
        keep = np.zeros(len(text) + 1, np.int32)
        np.add.at(keep, mine, 1)
        np.add.at(keep, np.minimum(mine + SEGMENT, whose), -1)
        inside = np.cumsum(keep[:-1]) > 0
        length[inside], row[inside] = some_length[inside], some_row[inside]
    return length, row


def _groups(*keys: np.ndarray) -> np.ndarray:
    """The number of the group of equal keys, per row."""
    by = np.lexsort(keys)
    new = np.zeros(len(by), bool)
    for k in keys:
        new[1:] |= k[by][1:] != k[by][:-1]
    group = np.empty(len(by), np.int64)
    group[by] = np.cumsum(new)
    return group


def _reach(data: np.ndarray, at: np.ndarray, room: np.ndarray, width: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes from ``at`` on, up to ``room``, agree with another place of equal ``h``, and a hash of those bytes.

    ``data`` has ``width`` bytes more than its places. Of sorted places the neighbours agree most.
    """
    beside = np.zeros((len(at), -(-width // 8) * 8), np.uint8)
    beside[:, :width] = np.lib.stride_tricks.sliding_window_view(data, width)[at]
    count = np.arange(beside.shape[1])
    beside[count >= room[:, None]] = 0
    by = np.lexsort((*beside.view(">u8").T[::-1], h))
    differ = beside[by[1:]] != beside[by[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(room[by[1:]], room[by[:-1]])) * (h[by[1:]] == h[by[:-1]])
    reach = np.zeros(len(at), np.int64)
    reach[by[1:]] = common
    reach[by[:-1]] = np.maximum(reach[by[:-1]], common)
    beside[count >= reach[:, None]] = 0
    odd = mix(np.arange(beside.shape[1] // 8, dtype=np.uint64) + np.uint64(width)) | np.uint64(1)
    return reach, mix((beside.view(np.uint64) * odd).sum(axis=1, dtype=np.uint64))


def region_anchors(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of regions data[begins:ends]."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for who, offsets, part, cuts in _pieces(data[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)):
        at, h = anchors(part, cuts)
        piece = np.searchsorted(cuts, at, "right")
        places.append(begins[np.array(who)[piece]] + np.array(offsets)[piece] + at - np.concatenate([[0], cuts[:-1]])[piece])
        hashes.append(h)
    at, once = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[once]


def open_windows(data: np.ndarray, back: np.ndarray, at: np.ndarray, h: np.ndarray, low: np.ndarray, high: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, state, least) of the windows around anchors at ``at`` in regions [low, high) of documents ``who``.

    ``data`` and ``back``, which is it backwards, have LENGTH bytes more. A window
    is cut to what it has in common with another one of its anchor. state 0: a
    smaller document has the same window, so it goes whole; 1: some of its strings
    may be in another one; 2: no other window shares a string that a smaller
    document might have. least: the smallest id with that anchor.
    """
    right, right_hash = _reach(data, at, np.minimum(high - at, LENGTH), LENGTH, h)
    left, left_hash = _reach(back, len(data) - LENGTH - at, np.minimum(at - low, WINDOW - 1), WINDOW - 1, h)
    alive = left + right >= LENGTH
    window, anchor = _groups(left_hash, right_hash, left, right, h), _groups(h)
    most = np.iinfo(np.int64).max
    first, least, one, two = np.full(len(at), most), np.full(len(at), most), np.full(len(at), most), np.full(len(at), -1)
    np.minimum.at(first, window, who)
    np.minimum.at(least, anchor, who)
    np.minimum.at(one, anchor[alive], window[alive])
    np.maximum.at(two, anchor[alive], window[alive])
    state = np.where(~alive, 2, np.where(first[window] < who, 0, np.where((one != two)[anchor], 1, 2)))
    return at - left, at + right, state, least[anchor]


def _removed(group: pa.Table) -> pa.Table:
    """(id, start, size): what goes from regions in the order of ids."""
    ids, starts, lengths = (group.column(n).to_numpy().astype(np.int64) for n in ("id", "start", "size"))
    data = np.frombuffer(b"".join(group.column("data").to_pylist()) + bytes(LENGTH), np.uint8)
    back = np.concatenate([data[:-LENGTH][::-1], data[-LENGTH:]])
    ends = np.cumsum(lengths)
    begins = ends - lengths
    places, hashes = region_anchors(data, begins, ends)
    gone: list[tuple[np.ndarray, np.ndarray]] = []
    # Anchors have nothing to do with each other, so a large source is done in shares of them.
    shares = max(1, -(-len(data) // TOGETHER))
    share = (mix(hashes) >> np.uint64(33)) % np.uint64(shares)
    for turn in range(shares):
        at, h = places[share == turn], hashes[share == turn]
        if not len(at):
            continue
        k = np.searchsorted(ends, at, "right")
        low, high, state, least = open_windows(data, back, at, h, begins[k], ends[k], ids[k])
        gone.append((low[state == 0], high[state == 0]))
        some = state == 1
        if some.any():
            gone.append(_matched(data, ends, ids, low[some], high[some], least[some]))
    low, high = (np.concatenate([g[i] for g in gone] or [np.zeros(0, np.int64)]) for i in (0, 1))
    by = np.argsort(low, kind="stable")
    low, high = low[by], high[by]
    if not len(low):
        return pa.table({n: pa.array([], pa.int64()) for n in ("id", "start", "size")})
    # Runs end where nothing reaches on, and with their region.
    k = np.searchsorted(ends, low, "right")
    far = np.maximum.accumulate(high)
    cut = np.flatnonzero(np.concatenate([[True], (low[1:] > far[:-1]) | (k[1:] != k[:-1])]))
    a, b, k = low[cut], far[np.append(cut[1:], len(low)) - 1], k[cut]
    return pa.table({"id": ids[k], "start": starts[k] + a - begins[k], "size": b - a})


def removed(found: DataFrame, buckets: int) -> DataFrame:
    """(id, start, size): runs of bytes to remove."""

    def body(group: pa.Table) -> pa.Table:
        whole = group.filter(pc.is_null(group.column("data"))).select(["id", "start", "size"])
        out = [whole.cast(pa.schema([(n, pa.int64()) for n in ("id", "start", "size")]))]
        group = group.filter(pc.is_valid(group.column("data"))).sort_by([("src", "ascending"), ("block", "ascending"), ("id", "ascending"), ("start", "ascending")])
        # Whole sources at a time, up to a few megabytes together.
        src, block, size = (group.column(n).to_numpy() for n in ("src", "block", "size"))
        new = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (block[1:] != block[:-1])])) if len(src) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        low = 0
        for high in [*new[1:].tolist(), len(src)] if len(src) else []:
            if total[high] - total[low] >= TOGETHER or high == len(src):
                out.append(_removed(group.slice(low, high - low).sort_by([("id", "ascending"), ("start", "ascending")])))
                low = high
        # Workers live on; what a bucket took should not stay with them.
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(out)

    keyed = found.withColumn("bucket", F.pmod(F.xxhash64("src", "block"), F.lit(buckets)).cast("int"))
    return keyed.select("bucket", "src", "block", "id", "start", "size", "data").groupBy("bucket").applyInArrow(body, "id long, start long, size long")


def _matched(data: np.ndarray, ends: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of runs of 50-byte strings in the given windows that a window of a smaller document has too."""
    by = np.argsort(low, kind="stable")
    low, high, least = low[by], high[by], least[by]
    region = np.searchsorted(ends, low, "right")
    cut = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (low[1:] > high[:-1])]))
    begins, stops, owner = low[cut], np.maximum.reduceat(high, cut), ids[region[cut]]
    # What the smallest document of an anchor has is there to be found; it finds nothing itself.
    seeks = np.maximum.reduceat(ids[region] > least, cut)
    size = stops - begins
    # Pieces one after another, each with a separator behind it.
    text_ends = np.cumsum(size + 1) - 1
    text_begins = text_ends - size
    text = np.empty(int(text_ends[-1]) + 1, np.uint16)
    where = np.repeat(begins - text_begins, size + 1) + np.arange(len(text))
    text[:] = data[np.minimum(where, len(data) - 1)]
    text[text_ends] = 256 + np.arange(len(text_ends)) % 250
    index = RunIndex(text, LENGTH)
    # Pieces lie in the order of ids, so a group's first position is in its smallest document.
    lowest = owner[np.searchsorted(text_ends, index.lowest_position(), "right").clip(max=len(owner) - 1)]
    index.drop_order()
    length, row = _streamed(index, text, text_begins[seeks], text_ends[seeks])
    at = np.flatnonzero(length >= LENGTH)
    at = at[lowest[index.group_of(row[at])] < owner[np.searchsorted(text_ends, at, "right")]]
    starts = where[at]
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) > LENGTH) | (np.diff(np.searchsorted(text_ends, at, "right")) > 0)]))
    return starts[cut], starts[np.append(cut[1:], len(starts)) - 1] + LENGTH


def whole_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, copy) of every row: whether a text of LENGTH bytes or more equals that of a smaller id."""
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    keyed = materialise(rows.select("doc_id", digest.alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n_bytes")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")), "digests")
    number = F.coalesce("doc_id", F.lit(NO_ID))
    part = keyed.groupBy("digest", "salt").agg(F.min(number).alias("low"))
    least = part.groupBy("digest").agg(F.min("low").alias("least"))
    known = part.join(least, "digest").select("digest", "salt", "least")
    return keyed.join(known, ["digest", "salt"]).select("doc_id", "n_bytes", ((number > F.col("least")) & (F.col("n_bytes") >= LENGTH)).alias("copy"))


def packed_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, z): the UTF-8 bytes of texts, deflated each by itself, as they cross the network."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.compress(x) for x in _bytes(batch.column(1))], pa.binary())], ["doc_id", "z"])

    return rows.select("doc_id", "text").mapInArrow(body, "doc_id long, z binary")


def dedup_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept is null where nothing went."""
    spark = docs.sparkSession
    ship_code(spark)
    sc = spark.sparkContext
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    told = materialise(whole_copies(rows), "copies")
    copies = told.filter("copy")
    # A map of the copies' ids, and one of other ids that it marks too: only copies are in the first and not the second.
    own = F.coalesce("doc_id", F.lit(NO_ID))
    second = F.xxhash64(own, F.lit(1))
    gone_words = id_map(copies.select(own.alias("id")))
    cell = F.pmod(hash_of(own), F.lit(bits_of(gone_words)))
    spared = told.filter("NOT copy").withColumn("cell", cell).join(copies.select(cell.alias("cell")).distinct(), "cell", "left_semi").select(second.alias("id"))
    gone_map, kept_map = sc.broadcast(gone_words), sc.broadcast(id_map(spared))

    def dropped(batch: pa.RecordBatch) -> np.ndarray:
        first, other = batch.column("first").to_numpy(), batch.column("other").to_numpy()
        return marked(gone_map.value, first) & ~marked(kept_map.value, other)

    def remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["doc_id", "text"]).filter(pa.array(~dropped(batch)))

    def going(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["doc_id", "n_bytes"]).filter(pa.array(dropped(batch)))

    hashes = hash_of(own).alias("first"), hash_of(second).alias("other")
    left = rows.select("doc_id", "text", *hashes).mapInArrow(remaining, "doc_id long, text string")
    total = told.filter("NOT copy").agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, -(-total // ANCHOR_BUCKET))
    blobs = anchor_blobs(left, buckets)
    places = shared_places(blobs, sources(heads(blobs)))
    gone = materialise(removed(regions(packed_texts(left.withColumn("doc_id", own)), places), max(8, -(-total // INDEX_BUCKET))), "spans")
    spans = gone.groupBy("id").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    touched = sc.broadcast(id_map(gone))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for i, z, spans in zip(*(batch.column(c) for c in range(3)), strict=True):
                raw = opened.decompress(z.as_py())
                runs: list[list[int]] = []
                for s in sorted((x["start"], x["start"] + x["size"]) for x in spans.as_py() or []):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                edges = [0, *(x for r in runs for x in r), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else raw
                out.append((i.as_py(), len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept if runs else None))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    def part(wanted: bool) -> object:
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select(["doc_id", "text"]).filter(pa.array(marked(touched.value, batch.column(2).to_numpy()) == wanted))

        return left.withColumn("hash", hash_of(own)).mapInArrow(pick, "doc_id long, text string")

    # Only texts of documents that lose something travel; the others are done where they are read.
    joined = packed_texts(part(True)).join(spans, own == spans.id, "left").select("doc_id", "z", "spans")
    alone = packed_texts(part(False)).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    n = F.col("n_bytes").cast("long")
    # Copies that the maps could not tell stay among the others, where all their strings are found in the smaller document.
    lost = copies.select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), *hashes).mapInArrow(going, "doc_id long, n_bytes long")
    lost = lost.select("doc_id", n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.unhex(F.lit("")).alias("kept"))
    return joined.mapInArrow(body, schema).unionByName(alone.mapInArrow(body, schema)).unionByName(lost)
