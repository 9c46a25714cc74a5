"""Exact self-join of documents by the Jaccard similarity of their word shingles.

If two sets overlap enough, their prefixes (the first n - ceil(t n) + 1 tokens)
share a token under *any* global order of tokens. A pair is compared only if it
shares prefix tokens under three orders at once:

* orders put tokens known to be frequent last and break ties by a hash with the
  order's own seed; the table of frequent tokens is bounded by ``most_frequent``
  and only steers the order, so results never depend on it;
* prefix tokens under order A leave the scan packed, about four bytes each, and
  meet in buckets by hash; equal sets count once;
* every member of a token's group is paired with the group's smallest id only,
  so pairs grow with the tokens, not with the square of a group. Parity maps of
  the sets (about a bit a token) tell most unlike pairs apart: they differ in no
  more bits than the sets have tokens apart. Prefixes under orders B and C are
  tested beside what is left, then the sets are compared;
* what these links join is one class. Groups whose members lie in several
  classes meet again, member against member, block by block: a block holds a
  bounded number of bytes, blocks of one class never meet each other, parity
  maps are tested before any set moves, and only links between different classes
  are looked for and emitted;
* components come from components.py.

A token that very many documents hold is dealt into salts with a centre each,
and the centres are paired with the smallest of them.

The joins ask for a merge, and tables that several branches of a plan read are
written first: over a hundred broadcasts and nested plans of some hundred nodes
fill the memory of a driver, whatever the size of the tables.

Defined results: words are lower-cased in A-Z only; a text of fewer words than
a shingle is one shingle; null, empty or blank texts have none and link with
nothing; rows that share a doc_id share its component, whatever their texts;
rows without a doc_id link with nothing; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.idmap import hash_of, id_map, marked
from quillspark.llm.shingles import mix, shingle_sets
from quillspark.session import materialise, ship_code

SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
SALTS = 64
#: Prefix tokens that meet in one bucket, and that a task packs at once.
BUCKET_TOKENS, PACK_TOKENS = 2_000_000, 1_000_000
#: A token held by 2**HOT_BITS documents or more is dealt into salts of about that many.
HOT_BITS = 15
#: Bytes of token sets in a block.
BLOCK_BYTES = 6 << 20
NODE = ["id", "key"]


@dataclass(frozen=True)
class Join:
    """Shingle size, similarity num/den, and entries of the frequent-token table."""

    size: int = 5
    num: int = 80
    den: int = 100
    most_frequent: int = 1_500_000

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1 if n else 0

    def near(self, x: Column, y: Column) -> Column:
        """Sizes at which two sets can be similar enough."""
        return F.least(x, y) * self.den >= F.greatest(x, y) * self.num


class Orders:
    """Global token orders: frequency class first (unknown tokens are rare), then a seeded hash."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        by = np.argsort(tokens)
        self.tokens = tokens[by]
        self.classes = np.minimum(255, 1 + (4 * np.log2(np.maximum(counts[by], 1))).astype(np.int64)).astype(np.uint64)

    def classes_of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(tokens), np.uint64)
        at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
        return np.where(self.tokens[at] == tokens, self.classes[at], np.uint64(0))

    def prefix(self, tokens: np.ndarray, classes: np.ndarray, order: int, length: int) -> np.ndarray:
        """Places of the first ``length`` tokens under an order."""
        if length >= len(tokens):
            return np.arange(len(tokens))
        key = mix(tokens ^ np.uint64(SEEDS[order])) >> np.uint64(8) | classes << np.uint64(56)
        return np.argpartition(key, length - 1)[:length]


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, sets) of a batch, a few hundred rows at a time."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1)
    for at in range(0, len(ids), 256):
        yield ids[at : at + 256], shingle_sets(texts.slice(at, 256).to_pylist(), size)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _node_key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def parity_map(s: np.ndarray) -> np.ndarray:
    """Words of 2**k bits for a set of 2**k tokens or more: a bit is set if an odd number of tokens falls on it."""
    bits = 1 << max(6, len(s).bit_length() - 1)
    cell = (mix(s ^ np.uint64(SEEDS[3])) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def fold(words: np.ndarray) -> np.ndarray:
    """The parity map of half as many bits."""
    half = words.shape[-1] // 2
    return words[..., :half] ^ words[..., half:]


def set_keys(rows: DataFrame, join: Join) -> DataFrame:
    """(doc_id, n, key, node, parity): set size, a 128-bit digest of the set and its first half, its parity map; null keys for empty sets."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            for ids, sets in _sets(batch, join.size):
                out = []
                for i, s in zip(ids, sets, strict=True):
                    key = _digest(s) if len(s) else None
                    out.append((i, len(s), key, _node_key(key), parity_map(s)) if key else (i, 0, None, None, None))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["doc_id", "n", "key", "node", "parity"])

    return rows.mapInArrow(body, "doc_id long, n long, key binary, node long, parity array<long>")


def frequent_tokens(rows: DataFrame, join: Join) -> Orders:
    """Tokens met twice or more inside a task, with summed counts, the most frequent ones.

    A token that many documents hold is met twice in some task; one that never
    is stays in the rare class, which costs candidates but no links. Where there
    are more than ``most_frequent``, whole frequency classes are left out.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for _, sets in _sets(batch, join.size):
                for s in sets:
                    key = _digest(s)
                    if key not in seen:
                        seen.add(key)
                        parts.append(s)
                        held += len(s)
            if held > 2_500_000:
                yield from counted(parts)
                parts, held = [], 0
        yield from counted(parts)

    def counted(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        if len(flat):
            flat.sort()
            edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]]))
            n = np.diff(edge)
            twice = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(flat[edge[:-1]][twice].view(np.int64)), pa.array(n[twice].astype(np.int64))], ["tok", "n"])

    counts = rows.mapInArrow(body, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n")).filter("n >= 4")
    counts = materialise(counts.withColumn("level", F.floor(F.log2("n") * 4)), "token-counts")
    least, total = 0, 0
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("c")).collect(), key=lambda r: -r["level"]):  # at most 256 levels
        total += r["c"]
        if total > join.most_frequent:
            least = r["level"] + 1
            break
    got = counts.filter(F.col("level") >= least).select("tok", "n").toArrow()
    return Orders(got.column("tok").to_numpy().view(np.uint64), got.column("n").to_numpy())


def packed_prefixes(rows: DataFrame, join: Join, orders: object, buckets: int) -> DataFrame:
    """(bucket, salt, h, many, ids, sizes, keys): packed prefix tokens under order A.

    ``h`` has 32 bits of every token beside the bucket, ``many`` how many of them
    each document of ids, sizes and keys has. Equal sets of a task leave it once.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = orders.value, set()
        nodes: list[tuple[int, int, int]] = []
        parts: list[np.ndarray] = []
        salts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for ids, sets in _sets(batch, join.size):
                for i, s in zip(ids, sets, strict=True):
                    digest = _digest(s)
                    if not len(s) or i is None or digest in seen:
                        continue
                    seen.add(digest)
                    key, classes = _node_key(digest), own.classes_of(s)
                    first = own.prefix(s, classes, 0, join.prefix(len(s)))
                    nodes.append((i, len(s), key))
                    parts.append(mix(s[first]))
                    # Classes count quarters of a power of two.
                    over = np.maximum(0, (classes[first].astype(np.int64) + 2) // 4 - HOT_BITS)
                    salts.append(np.where(over > 0, 1 + (key & 0x7FFFFFFF) % (1 << over), 0))
                    held += len(first)
            if held > PACK_TOKENS:
                yield packed(nodes, parts, salts)
                nodes, parts, salts, held = [], [], [], 0
        if nodes:
            yield packed(nodes, parts, salts)

    def packed(nodes: list, parts: list, salts: list) -> pa.RecordBatch:
        token, salt = np.concatenate(parts), np.concatenate(salts)
        owner = np.repeat(np.arange(len(nodes)), [len(p) for p in parts])
        ids, sizes, keys = np.array([n[0] for n in nodes], np.int64), np.array([n[1] for n in nodes], np.int32), np.array([n[2] for n in nodes], np.int64)
        bucket = (token % np.uint64(buckets)).astype(np.int64)
        h = (token >> np.uint64(32)).astype(np.uint32)
        by = np.lexsort((owner, salt, bucket))
        bucket, salt, h, owner = bucket[by], salt[by], h[by], owner[by]
        cut = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])]))
        out = []
        for a, b in zip(cut, np.append(cut[1:], len(h)), strict=True):
            mine, many = np.unique(owner[a:b], return_counts=True)
            out.append((int(bucket[a]), int(salt[a]), h[a:b].tobytes(), many.astype(np.int32).tobytes(), ids[mine].tobytes(), sizes[mine].tobytes(), keys[mine].tobytes()))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["bucket", "salt", "h", "many", "ids", "sizes", "keys"])

    return rows.mapInArrow(body, "bucket int, salt int, h binary, many binary, ids binary, sizes binary, keys binary")


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column])


def centred(prefixes: DataFrame, join: Join) -> DataFrame:
    """(tok, id, key, n, cid, ckey, cn, paired, crowd): members beside the centre of a token's group.

    paired: their sizes let them be similar. crowd: the member can be similar to
    another one too. tok is null but for salted tokens, whose centres are many.
    """
    names = ["tok", "id", "key", "n", "cid", "ckey", "cn", "paired", "crowd"]

    def body(group: pa.Table) -> pa.Table:
        many = _joined(group.column("many"), np.int32)
        owner = np.repeat(np.arange(len(many)), many)
        h = _joined(group.column("h"), np.uint32)
        ids, sizes, keys = _joined(group.column("ids"), np.int64), _joined(group.column("sizes"), np.int32).astype(np.int64), _joined(group.column("keys"), np.int64)
        hot = group.column("salt")[0].as_py() > 0
        # Equal sets count once, by their smallest id, which comes first.
        place = np.lexsort((keys, ids)).argsort()
        by = np.lexsort((place[owner], h))
        h, owner = h[by], owner[by]
        same = np.lexsort((place[owner], keys[owner], h))
        again = np.zeros(len(h), bool)
        again[same[1:]] = (h[same][1:] == h[same][:-1]) & (keys[owner[same]][1:] == keys[owner[same]][:-1])
        h, owner = h[~again], owner[~again]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count = np.diff(np.append(first, len(h)))
        at, centre, members = np.arange(len(h)), np.repeat(first, count), np.repeat(count, count)
        n, cn = sizes[owner], sizes[owner[centre]]
        fits = lambda x, y: np.minimum(x, y) * join.den >= np.maximum(x, y) * join.num
        paired = (at != centre) & fits(n, cn)
        # By size inside the group, a member's nearest neighbours tell whether any other one fits.
        rest = np.flatnonzero((at != centre) & (members > 2))
        rest = rest[np.lexsort((n[rest], h[rest]))]
        beside = (h[rest][1:] == h[rest][:-1]) & fits(n[rest][1:], n[rest][:-1])
        crowd = np.zeros(len(h), bool)
        crowd[rest[1:][beside]] = True
        crowd[rest[:-1][beside]] = True
        if hot:
            crowd[:] = True
        keep = np.flatnonzero(paired | crowd)
        mine, its = owner[keep], owner[centre[keep]]
        tok = (np.int64(group.column("bucket")[0].as_py()) << 32) | h[keep].astype(np.int64)
        table = pa.table({"tok": pa.array(tok, mask=np.full(len(keep), not hot)), "id": ids[mine], "key": keys[mine], "n": sizes[mine], "cid": ids[its], "ckey": keys[its], "cn": sizes[its], "paired": paired[keep], "crowd": crowd[keep]})
        return table.group_by(names).aggregate([]).select(names)

    return prefixes.groupBy("bucket", "salt").applyInArrow(body, "tok long, id long, key long, n long, cid long, ckey long, cn long, paired boolean, crowd boolean")


def node_sets(rows: DataFrame, join: Join, orders: object, wanted: np.ndarray) -> DataFrame:
    """(id, key, b, c, tokens) of documents marked in the map ``wanted``: prefixes under orders B and C in 32 bits a token, and the set.

    A document of repeated rows leaves every task that holds it once.
    """
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, map_, seen = orders.value, sent.value, set()
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            for ids, sets in _sets(batch.filter(pa.array(marked(map_, batch.column(2).to_numpy()))), join.size):
                out: list[tuple] = []
                for i, s in zip(ids, sets, strict=True):
                    if not len(s) or (node := (i, _node_key(_digest(s)))) in seen:
                        continue
                    seen.add(node)
                    classes = own.classes_of(s)
                    out.append((*node, *((mix(s[own.prefix(s, classes, k, join.prefix(len(s)))]) >> np.uint64(32)).astype(np.uint32).view(np.int32) for k in (1, 2)), s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["id", "key", "b", "c", "tokens"])

    hashed = rows.filter("doc_id IS NOT NULL").select("doc_id", "text", hash_of(F.col("doc_id")).alias("hash"))
    return hashed.mapInArrow(body, "id long, key long, b array<int>, c array<int>, tokens array<long>")


def _beside(pairs: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the given columns of both nodes, the centre's with an x before the name."""
    mine = nodes.select(*NODE, *columns)
    its = nodes.select(F.col("id").alias("cid"), F.col("key").alias("ckey"), *[F.col(c).alias("x" + c) for c in columns])
    return pairs.join(mine.hint("merge"), NODE).join(its.hint("merge"), ["cid", "ckey"])


def in_blocks(crowds: DataFrame, size: Column) -> DataFrame:
    """(crowd, low, high, block, id, key, n, class): members of crowds of several classes, for every two blocks that must meet.

    ``size`` is the bytes of a member. A class of more bytes than a block has
    blocks of its own, which need not meet each other; small classes share blocks.
    """
    of_class = crowds.groupBy("crowd", "class").agg(F.sum(size).alias("bytes")).withColumn("large", F.col("bytes") > BLOCK_BYTES)
    small = of_class.filter(~F.col("large")).groupBy("crowd").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("rest"))
    dealt = of_class.filter("large").select("crowd", "class", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("parts"))
    # block: number within the class, or within what is left (owner null).
    members = crowds.join(dealt.hint("merge"), ["crowd", "class"], "left").join(small.hint("merge"), "crowd", "left").select(
        "crowd", *NODE, "n", "class", F.when(F.col("parts").isNotNull(), F.col("class")).alias("owner"),
        F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(*NODE), "parts")).otherwise(F.pmod(F.xxhash64("class"), "rest")).alias("number"))
    # Written, since three branches of the plan read it.
    members = materialise(members.withColumn("block", F.concat_ws(":", F.coalesce(F.col("owner").cast("string"), F.lit("")), F.col("number").cast("string"))), "members")
    blocks = members.select("crowd", "block", "owner").distinct()
    other = blocks.select("crowd", F.col("block").alias("block2"), F.col("owner").alias("owner2"))
    met = blocks.join(other.hint("merge"), "crowd").filter((F.col("block") <= F.col("block2")) & F.coalesce(F.col("owner") != F.col("owner2"), F.lit(True)))
    sides = met.select("crowd", F.col("block").alias("low"), F.col("block2").alias("high"), F.explode(F.array_distinct(F.array("block", "block2"))).alias("block"))
    return members.join(sides.hint("merge"), ["crowd", "block"]).select("crowd", "low", "high", "block", *NODE, "n", "class")


class _Lists:
    """Lists of a column: how many values those of rows low to high have in common with that of row i."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        values, self.flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        self.mark = np.zeros(len(values), bool)

    def shared(self, i: int, low: int, high: int) -> np.ndarray:
        mine = self.flat[self.at[i] : self.at[i + 1]]
        self.mark[mine] = True
        out = np.add.reduceat(self.mark[self.flat[self.at[low] : self.at[high]]], self.at[low:high] - self.at[low], dtype=np.int64)
        self.mark[mine] = False
        return out


def _open_pairs(group: pa.Table, join: Join) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, later rows whose class differs and size fits, classes) for every row of a group in order of size; classes may be changed on the way."""
    low = group.column("low")[0].as_py()
    side, alone = np.array(group.column("block").to_pylist()) == low, low == group.column("high")[0].as_py()
    label, n = group.column("class").to_numpy().copy(), group.column("n").to_numpy()
    ends = np.searchsorted(n, n * join.den // join.num, "right")
    for i, end in enumerate(ends.tolist()):
        if i % 64 == 0 and (label == label[0]).all():
            return
        meets = label[i + 1 : end] != label[i]
        if not alone:
            meets &= side[i + 1 : end] != side[i]
        if meets.any():
            yield i, i + 1 + np.flatnonzero(meets), label


def _close(words: np.ndarray, sizes: np.ndarray, join: Join) -> np.ndarray:
    """Whether sets of ``sizes`` together can be similar enough, by the exclusive or of their parity maps."""
    apart = np.bitwise_count(words.view(np.uint64)).sum(axis=-1, dtype=np.int64)
    return apart * (join.den + join.num) <= (join.den - join.num) * sizes


def close_pairs(pairs: DataFrame, join: Join) -> DataFrame:
    """Pairs (id, key, cid, ckey) whose parity maps allow a link; pairs come with n, parity, xn and xparity."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            n, xn = batch.column("n").to_numpy(), batch.column("xn").to_numpy()
            for i, (x, y) in enumerate(zip(batch.column("parity"), batch.column("xparity"), strict=True)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                while len(x) > len(y):
                    x = fold(x)
                while len(y) > len(x):
                    y = fold(y)
                keep[i] = _close(x ^ y, n[i] + xn[i], join)
            yield batch.select([*NODE, "cid", "ckey"]).filter(pa.array(keep))

    return pairs.select(*NODE, "cid", "ckey", "n", "xn", "parity", "xparity").mapInArrow(body, "id long, key long, cid long, ckey long")


def crowd_candidates(crowds: DataFrame, maps: DataFrame, join: Join) -> DataFrame:
    """Members whose parity maps allow a link with another class of their crowd: rows of ``crowds``."""

    def body(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        lists = group.column("parity").combine_chunks()
        length = lists.value_lengths().to_numpy()
        at, flat, n = np.cumsum(length) - length, lists.flatten().to_numpy(), group.column("n").to_numpy()
        # By map length: the members of that length, and those of twice the length folded; larger sets come later.
        side: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in np.unique(length).tolist():
            own, twice = np.flatnonzero(length == size), np.flatnonzero(length == 2 * size)
            folded = fold(flat[at[twice][:, None] + np.arange(2 * size)])
            side[size] = np.concatenate([own, twice]), np.concatenate([flat[at[own][:, None] + np.arange(size)], folded])
        keep = np.zeros(group.num_rows, bool)
        for i, others, _ in _open_pairs(group, join):
            members, words = side[length[i]]
            close = _close(words[np.searchsorted(members, others)] ^ flat[at[i] : at[i] + length[i]], n[others] + n[i], join)
            keep[others[close]] = True
            keep[i] |= close.any()
        return group.filter(pa.array(keep)).select(["crowd", *NODE, "n", "class"])

    dealt = in_blocks(crowds, F.col("n") / 8 + 16).join(maps.hint("merge"), NODE)
    return dealt.groupBy("crowd", "low", "high").applyInArrow(body, crowds.select("crowd", *NODE, "n", "class").schema).distinct()


def crowd_links(crowds: DataFrame, nodes: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) that join different classes of a crowd; the ends of those found stand for their classes."""

    def body(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        b, c, tokens = (_Lists(group.column(name)) for name in ("b", "c", "tokens"))
        ids, n = group.column("id").to_numpy(), group.column("n").to_numpy()
        out = []
        for i, others, label in _open_pairs(group, join):
            for prefix in (b, c):
                if len(others):
                    others = others[prefix.shared(i, others[0], others[-1] + 1)[others - others[0]] > 0]
            if len(others):
                both = tokens.shared(i, others[0], others[-1] + 1)[others - others[0]]
                for j in others[both * join.den >= join.num * (n[others] + n[i] - both)]:
                    if label[j] != label[i]:
                        out.append((ids[i], ids[j]))
                        label[label == label[j]] = label[i]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    dealt = in_blocks(crowds, F.lit(8) * F.col("n")).join(nodes.hint("merge"), NODE)
    return dealt.groupBy("crowd", "low", "high").applyInArrow(body, "a long, b long")


def _meeting(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of member and centre, and crowds (crowd, id, key, n); salted tokens get one centre above their centres."""
    its = ["cid", "ckey", "cn"]
    salted = found.filter("tok IS NOT NULL")
    locals_ = salted.select("tok", *its).distinct()
    tops = locals_.groupBy("tok").agg(F.min(F.struct(*its)).alias("top"))
    above = locals_.join(tops.hint("merge"), "tok").select("tok", *its, "top")
    upward = above.filter("cid <> top.cid OR ckey <> top.ckey").select(F.col("cid").alias("id"), F.col("ckey").alias("key"), F.col("top.cid").alias("cid"), F.col("top.ckey").alias("ckey"))
    pairs = found.filter("paired").select(*NODE, "cid", "ckey").unionByName(upward).distinct()
    members = found.filter("crowd AND tok IS NULL").select(F.struct("cid", "ckey").alias("crowd"), *NODE, "n")
    more = salted.join(above.hint("merge"), ["tok", *its]).select(F.struct("top.cid", "top.ckey").alias("crowd"), *NODE, "n")
    return pairs, members.unionByName(more).distinct()


def linked(rows: DataFrame, join: Join, tokens: int, maps: DataFrame, same: DataFrame, repeated: bool) -> DataFrame:
    """(id, component): ids joined by ``same`` (a, b) and by links between different sets.

    ``tokens`` is about how many prefixes hold; ``maps`` has (id, key, n, parity)
    of every document; ``repeated`` tells whether some rows share id and set.
    """
    orders = rows.sparkSession.sparkContext.broadcast(frequent_tokens(rows, join))
    found = materialise(centred(packed_prefixes(rows, join, orders, max(16, -(-tokens // BUCKET_TOKENS))), join), "centred")
    pairs, crowds = _meeting(found)
    pairs = materialise(close_pairs(_beside(pairs, maps, ["n", "parity"]), join), "pairs")
    crowds = materialise(crowd_candidates(materialise(crowds.withColumn("class", F.col("id")), "crowds"), maps.drop("n"), join), "crowds")
    ends = lambda some: some.select("id").unionByName(some.select(F.col("cid").alias("id")))
    nodes = node_sets(rows, join, orders, id_map(ends(pairs).unionByName(crowds.select("id"))))
    nodes = materialise(nodes.dropDuplicates(NODE) if repeated else nodes, "nodes")
    # Member and centre: orders B and C beside the pair, then the sets.
    left = materialise(_beside(pairs, nodes, ["b", "c"]).filter(F.arrays_overlap("b", "xb") & F.arrays_overlap("c", "xc")).select(*NODE, "cid", "ckey"), "candidates")
    compared = _beside(left, nodes, ["tokens"]).withColumn("both", F.size(F.array_intersect("tokens", "xtokens")))
    alike = compared.filter(F.col("both") * join.den >= join.num * (F.size("tokens") + F.size("xtokens") - F.col("both")))
    stars = components(alike.select(F.col("id").alias("a"), F.col("cid").alias("b")).unionByName(same))
    # Crowds whose members are in one class by now have nothing left to tell.
    crowds = crowds.drop("class").join(stars.hint("merge"), "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")
    several = crowds.groupBy("crowd").agg(F.min("class").alias("one"), F.max("class").alias("two")).filter("one <> two").select("crowd")
    crowds = materialise(crowd_candidates(materialise(crowds.join(several.hint("merge"), "crowd"), "crowds"), maps.drop("n"), join), "crowds")
    more = materialise(crowd_links(crowds, nodes, join), "links")
    if more.isEmpty():
        return stars
    return components(stars.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))


def join_documents(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = materialise(set_keys(rows, join).withColumn("salt", F.abs(F.xxhash64("doc_id") % SALTS).cast("int")), "set-keys")
    some = keyed.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    # A class of equal sets may hold any share of the rows: smallest id by salt, then over salts.
    part = some.groupBy("key", "salt").agg(F.min("doc_id").alias("low"))
    least = part.groupBy("key").agg(F.min("low").alias("class"))
    same = some.join(part.join(least.hint("merge"), "key").select("key", "salt", "class").hint("merge"), ["key", "salt"]).select(F.col("doc_id").alias("a"), F.col("class").alias("b")).filter("a <> b")
    tokens = keyed.agg(F.sum(F.floor(F.col("n") * (join.den - join.num) / join.den) + 1)).first()[0] or 0
    repeated = not some.groupBy("doc_id", "key").count().filter("count > 1").isEmpty()
    maps = keyed.filter("key IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("node").alias("key"), "n", "parity")
    found = linked(rows, join, int(tokens), maps.dropDuplicates(NODE) if repeated else maps, same, repeated)
    return keyed.join(found.hint("merge"), F.col("doc_id") == F.col("id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
