"""Static 3-wise binary fuse filters over 64-bit keys, in numpy.

Graf and Lemire, "Binary Fuse Filters: Fast and Smaller Than Xor Filters"
(2022). A filter holds about 1.13 x 8 bits a key, answers every key it was
built from with true and any other with true in one case of 256.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

ARITY = 3


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) of ``x + seed``."""
    with np.errstate(over="ignore"):
        h = x + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _high_product(h: np.ndarray, n: int) -> np.ndarray:
    """floor(h * n / 2**64) for n < 2**32, without 128-bit integers."""
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return (high * np.uint64(n) + ((low * np.uint64(n)) >> np.uint64(32))) >> np.uint64(32)


@dataclass(frozen=True)
class FuseFilter:
    seed: int
    segment: int
    segments: int
    table: np.ndarray

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(self.segment - 1)
        first = _high_product(h, self.segments * self.segment)
        second = (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & mask)
        third = (first + np.uint64(2 * self.segment)) ^ (h & mask)
        return [first.astype(np.int64), second.astype(np.int64), third.astype(np.int64)]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.table) or not len(keys):
            return np.zeros(len(keys), bool)
        h = mix(keys, self.seed)
        a, b, c = self._places(h)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == _print(h)

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<u8").tobytes() + self.table.tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> FuseFilter:
        seed, segment, segments = np.frombuffer(data, "<u8", 3).tolist()
        return FuseFilter(seed, segment, segments, np.frombuffer(data, np.uint8, offset=24))


def _print(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> FuseFilter:
    """A filter of distinct or repeated 64-bit keys; peels in rounds over whole arrays."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if n == 0:
        return FuseFilter(0, 1, 1, np.zeros(0, np.uint8))
    segment = 1 << max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25))) if n > 1 else 4
    segment = min(segment, 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)) if n > 1 else 2.0
    segments = max(1, -(-int(n * factor + 8) // segment) - (ARITY - 1))
    for attempt in range(1, 100):
        if attempt % 10 == 0:
            segments += max(1, segments // 10)
        empty = FuseFilter(attempt * 0x9E3779B97F4A7C15 & (1 << 64) - 1, segment, segments, np.zeros((segments + ARITY - 1) * segment, np.uint8))
        h = mix(keys, empty.seed)
        places = np.stack(empty._places(h))
        order = _peel(places, len(empty.table))
        if order is None:
            continue
        table, prints = empty.table, _print(h)
        # Later peeled first: the keys of one round own distinct cells, none of which a key of the same or an earlier round reads otherwise.
        for ids, cells in reversed(order):
            a, b, c = places[:, ids]
            table[cells] = 0
            table[cells] = prints[ids] ^ table[a] ^ table[b] ^ table[c]
        return empty
    raise RuntimeError("no peelable seed found")


def _peel(places: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, their own cells) until no key is left, or None."""
    n = places.shape[1]
    left = np.arange(n)
    count = np.bincount(places.ravel(), minlength=size)
    ids = np.zeros(size, np.int64)
    for row in places:
        np.bitwise_xor.at(ids, row, left)
    order, cells, done = [], np.flatnonzero(count == 1), 0
    while len(cells):
        owner = ids[cells]
        owner, first = np.unique(owner, return_index=True)
        own = cells[first]
        order.append((owner, own))
        done += len(owner)
        touched = places[:, owner]
        for row in touched:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(ids, row, owner)
        touched = np.unique(touched.ravel())
        cells = touched[count[touched] == 1]
    return order if done == n else None
