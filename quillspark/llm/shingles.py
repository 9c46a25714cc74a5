"""Word shingles of many texts as 64-bit hashes, over whole byte arrays."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, then a random 64-bit value per byte.
_rng = np.random.default_rng(20240229)
_VALUE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_LANES = _rng.integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
SEGMENT = 1 << 20
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + (1 << 16))
        both = []
        for base in (_STEP, _BACK):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p, dtype=np.uint64))
        _powers[:] = both
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in one segment."""
    up, down = _tables(len(data) + 1)
    inside = ~SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte offsets of all words of ``data``, cut at white space into segments."""
    array = np.frombuffer(data, np.uint8)
    if len(array) <= SEGMENT + (1 << 16):
        return _words(array)
    hashes, starts, at = [], [], 0
    while at < len(array):
        end = min(len(array), at + SEGMENT)
        while end < len(array):
            gaps = np.flatnonzero(SPACE[array[end : end + 65536]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(array), end + 65536)
        h, s = _words(array[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """Per text, its distinct ``size``-word shingles, sorted; a shorter text is one shingle, one without words has none."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        blob, ends, total = [], [], 0
        while at < len(texts) and (not blob or total < SEGMENT // 2):
            data = (texts[at] or "").encode("utf-8", "surrogatepass")
            total += len(data) + 1
            blob.append(data)
            ends.append(total)
            at += 1
        hashes, starts = word_hashes(b" ".join(blob))
        cuts = np.searchsorted(starts, np.array(ends))
        n = len(hashes)
        first = np.concatenate([[0], cuts[:-1]])
        full = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size):
            full += hashes[k : n - size + 1 + k] * _LANES[k] if n >= size else np.uint64(0)
        full = mix(full)
        for a, b in zip(first.tolist(), cuts.tolist(), strict=True):
            if b - a >= size:
                out.append(np.unique(full[a : b - size + 1]))
            elif b > a:
                out.append(mix((hashes[a:b] * _LANES[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
