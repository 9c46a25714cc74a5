"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that
is itself a token. Tier two: a miss starts as linked single bytes; a heap of
(rank, place) pops the lowest-ranked adjacent pair until none merges.

Every match of the split pattern is encoded by itself, without special tokens,
so the ids equal those of a rank-based byte-pair encoder. Defined results: null
text counts as empty and gives no ids; repeated rows are encoded one by one;
extra columns are ignored. A row is handled in one task, never a group of rows,
and the memo of resolved pre-tokens is bounded (it is emptied when full).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import ship_code

#: Pieces that a task remembers, and the characters of the longest of them.
MEMO, MEMO_CHARS = 400_000, 256
#: Average keys of one displacement bucket of the perfect hash.
BUCKET = 4


class PerfectHash:
    """key -> 0..n-1 without gaps, for a fixed set of byte strings.

    Compress, hash, displace: keys fall into buckets; buckets, largest first,
    try displacements until all their keys land on free slots. A displacement
    d maps hash h to (h1 + d * h2) mod a prime-free range, done in numpy.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // BUCKET)
        self.seed = 0
        while not self._place([xxhash.xxh3_64_intdigest(k, self.seed) for k in keys]):
            self.seed += 1

    def _place(self, hashes: list[int]) -> bool:
        groups: dict[int, list[int]] = {}
        for h in hashes:
            groups.setdefault((h >> 40) % self.buckets, []).append(h & 0xFFFFFFFFFF)
        taken = bytearray(self.n)
        shifts = np.zeros(self.buckets, np.int64)
        tries = np.arange(1 << 12, dtype=np.uint64)
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(set(members)) < len(members):
                return False
            base = 0
            while True:
                slots = np.stack([_slots(np.uint64(m), tries + np.uint64(base), self.n) for m in members])
                free = ~np.frombuffer(taken, np.uint8).astype(bool)[slots].any(axis=0) if len(members) > 1 else np.frombuffer(taken, np.uint8)[slots[0]] == 0
                found = False
                for d in np.flatnonzero(free):
                    mine = slots[:, d].tolist()
                    if len(set(mine)) == len(mine):
                        for s in mine:
                            taken[s] = 1
                        shifts[bucket] = base + int(d)
                        found = True
                        break
                if found:
                    break
                base += len(tries)
                if base > 1 << 24:
                    return False
        self.shifts = shifts.tolist()
        return True

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        x = (h & 0xFFFFFFFFFF) + self.shifts[(h >> 40) % self.buckets] * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (x ^ x >> 29) % self.n


def _slots(member: np.uint64, shifts: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = member + shifts * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(n)).astype(np.int64)


def read_ranks(lines: list[str]) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 token, space, rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.tokens = dict(sorted((r, t) for t, r in ranks.items()))
        self.hash = PerfectHash(list(ranks))
        self.slots: list[tuple[bytes, int]] = [(b"", -1)] * len(ranks)
        for token, rank in ranks.items():
            self.slots[self.hash.slot(token)] = (token, rank)
        self.pairs = ranks
        self._ready()

    def _ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}
        self.digits = {r: str(r) for r in self.tokens}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "memo", "digits")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def whole(self, piece: bytes) -> int | None:
        """Tier one: the id of a pre-token that is a token."""
        token, rank = self.slots[self.hash.slot(piece)]
        return rank if token == piece else None

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Tier two: heap over linked bytes. A stale entry no longer matches the
        pair that starts at its place, which its length tells."""
        n, ranks = len(piece), self.pairs
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        push, pop, get = heapq.heappush, heapq.heappop, ranks.get
        while heap:
            rank, i, end = pop(heap)
            mid = after[i]
            if mid >= n or mid < 0 or after[mid] != end:
                continue
            after[i] = end
            after[mid] = -1
            if end < n:
                before[end] = i
                stop = after[end]
                rank = get(piece[i:stop])
                if rank is not None:
                    push(heap, (rank, i, stop))
            i0 = before[i]
            if i0 >= 0:
                rank = get(piece[i0:end])
                if rank is not None:
                    push(heap, (rank, i0, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        pieces = self.find(text)
        memo = self.memo
        try:
            return list(chain.from_iterable(map(memo.__getitem__, pieces)))
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        # Long pieces are not kept beyond their text, so the memo is bounded in bytes too.
        long: dict[str, tuple[int, ...]] = {}
        for piece in pieces:
            if piece not in memo and piece not in long:
                data = piece.encode("utf-8", "surrogatepass")
                one = self.whole(data)
                (memo if len(piece) <= MEMO_CHARS else long)[piece] = (one,) if one is not None else self.merged(data)
        return list(chain.from_iterable(memo[p] if p in memo else long[p] for p in pieces))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def load_codec(spark: SparkSession, path: str, pattern: str) -> Codec:
    """A codec of the rank file at ``path``, read on the driver, a few MB at most."""
    with open(path, encoding="ascii") as file:
        return Codec(read_ranks(file.readlines()), pattern)


def encode_table(docs: DataFrame, codec: Codec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the tokens of every row."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            ids = pa.array([own.encode(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(body, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, codec: Codec, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, then decode: doc_id, n_tokens and digests of the ids and of the bytes.

    The ids of a row live only inside its task; what leaves is three values.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        digits = own.digits.__getitem__
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for t in batch.column(1):
                ids = own.encode(t.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(codec)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(body, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
