"""A run-length compressed Burrows-Wheeler index with sampled run ends.

Suffixes are ordered by their first ``depth`` bytes, then by position, which
backward steps up to that depth cannot tell from the full order. The transform
is kept as its runs; for each run the positions of its two end rows are kept
(Gagie, Navarro and Prezza, "Optimal-Time Text Indexing in BWT-runs Bounded
Space", 2018). Matching statistics stream patterns backwards, many at once: a
row whose run has the wanted byte steps on; else the nearest runs of that byte
above and below offer their sampled ends, and the longer common extension wins
(Rossi et al., "MONI", 2022).
"""

from __future__ import annotations

import numpy as np


def bounded_ranks(text: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(length, ranks of the first ``length`` symbols at every position), by doubling; the last length is ``depth``."""
    # Seven symbols of nine bits fill a word, so the first three doublings are one sort.
    have = min(7, depth)
    key = np.zeros(len(text), np.uint64)
    for k in range(have):
        symbol = np.zeros(len(text), np.uint64)
        symbol[: len(text) - k] = text[k:].astype(np.uint64) + np.uint64(1)
        key = (key << np.uint64(9)) | symbol
    out = [(have, np.unique(key, return_inverse=True)[1].astype(np.int32) + 1)]
    while have < depth:
        rank = out[-1][1].astype(np.int64)
        step = min(have, depth - have)
        shifted = np.zeros_like(rank)
        shifted[: len(rank) - step] = rank[step:]
        rank = rank * (int(rank.max()) + 1) + shifted
        have += step
        out.append((have, np.unique(rank, return_inverse=True)[1].astype(np.int32) + 1))
    return out


class RunIndex:
    """Index of ``text`` (uint16 symbols below 511, so separators can differ from bytes)."""

    def __init__(self, text: np.ndarray, depth: int):
        self.depth, self.text = depth, text
        self.ranks = bounded_ranks(text, depth)
        ranks = self.ranks[-1][1]
        order = np.argsort(ranks, kind="stable")
        n = len(text)
        last = text[order - 1].astype(np.int64)  # row of position 0 wraps to the closing separator
        edge = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.heads, self.starts = last[edge], edge
        self.ends = np.concatenate([edge[1:], [n]]) - 1
        self.first_at, self.last_at = order[self.starts], order[self.ends]
        counts = np.bincount(last, minlength=512)
        base = np.concatenate([[0], np.cumsum(counts)[:-1]])
        length = self.ends - self.starts + 1
        # Rows with the run's symbol before the run: a running sum inside each symbol.
        by = np.argsort(self.heads, kind="stable")
        sums = np.cumsum(length[by]) - length[by]
        group = np.searchsorted(self.heads[by], self.heads[by])
        before = np.empty_like(sums)
        before[by] = sums - sums[group]
        self.step = base[self.heads] + before - self.starts
        # Runs of each symbol, for the jumps.
        self.by, self.by_key = by, self.heads[by] * np.int64(len(edge) + 1) + by
        self.runs = len(edge)
        self.group = ranks[order]
        self.group_start = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]]))
        self.order = None
        self._order = order

    def lowest_position(self) -> np.ndarray:
        """Per group of rows with equal first ``depth`` symbols, its first position (rows are stable)."""
        return self._order[self.group_start]

    def drop_order(self) -> None:
        """Forget the full order; samples at run ends remain."""
        del self._order
        del self.group

    def group_of(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.group_start, rows, "right") - 1

    def _extension(self, at: np.ndarray, patterns: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Common length, up to depth, of the text at ``at`` and the pattern stream at ``where``."""
        out = np.zeros(len(at), np.int64)
        if patterns is self.text:
            # Equal ranks of a length are equal strings of it: the lengths halve, so each is tried once or twice.
            live = (at < len(self.text)) & (where < len(self.text))
            whole = np.zeros(len(at), bool)
            whole[live] = self.ranks[-1][1][at[live]] == self.ranks[-1][1][where[live]]
            out[whole] = self.depth
            rest = np.flatnonzero(live & ~whole)
            a, b, n = at[rest], where[rest], np.zeros(len(rest), np.int64)
            for length, ranks in reversed(self.ranks[:-1]):
                inside = (a + n < len(ranks)) & (b + n < len(ranks))
                same = np.zeros(len(rest), bool)
                same[inside] = ranks[(a + n)[inside]] == ranks[(b + n)[inside]]
                n += length * same
            live = np.ones(len(rest), bool)
            for _ in range(self.ranks[0][0] - 1):
                live &= (a + n < len(self.text)) & (b + n < len(self.text))
                live[live] = self.text[(a + n)[live]] == self.text[(b + n)[live]]
                n += live
            out[rest] = n
            return np.minimum(out, self.depth)
        live = np.ones(len(at), bool)
        for k in range(self.depth):
            a, b = at + k, where + k
            live &= (a < len(self.text)) & (b < len(patterns))
            if not live.any():
                break
            live[live] = self.text[a[live]] == patterns[b[live]]
            out += live
        return out

    def stream(self, patterns: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of patterns[begins[i]:ends[i]], all in lockstep from their ends.

        Returns per symbol of ``patterns`` the match length (up to depth) and a
        row whose text begins with that match.
        """
        length, row_at = np.zeros(len(patterns), np.int16), np.zeros(len(patterns), np.int64)
        order = np.argsort(begins - ends, kind="stable")  # longest first
        begins, ends = begins[order], ends[order]
        sizes = ends - begins
        row, have = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        for k in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            live = int(np.searchsorted(-sizes, -k, "right"))
            at = ends[:live] - k
            c = patterns[at].astype(np.int64)
            r, h = row[:live], have[:live]
            run = np.searchsorted(self.starts, r, "right") - 1
            off = np.flatnonzero(self.heads[run] != c)
            if len(off):
                key = c[off] * np.int64(self.runs + 1) + run[off]
                below = np.searchsorted(self.by_key, key)
                above = below - 1
                ok_below = (below < self.runs) & (self.heads[self.by[np.minimum(below, self.runs - 1)]] == c[off])
                ok_above = (above >= 0) & (self.heads[self.by[np.maximum(above, 0)]] == c[off])
                up, down = self.by[np.maximum(above, 0)], self.by[np.minimum(below, self.runs - 1)]
                where = at[off] + 1
                gain_up = np.where(ok_above, np.minimum(self._extension(self.last_at[up], patterns, where), h[off]), -1)
                gain_down = np.where(ok_below, np.minimum(self._extension(self.first_at[down], patterns, where), h[off]), -1)
                use_up = gain_up >= gain_down
                run[off] = np.where(use_up, up, down)
                r[off] = np.where(use_up, self.ends[up], self.starts[down])
                h[off] = np.maximum(gain_up, gain_down)
            r[:] = np.where(h >= 0, r + self.step[run], r)
            h[:] = np.minimum(h + 1, self.depth)
            length[at], row_at[at] = h, r
        return length, row_at
