"""Regular expressions over bytes to minimal deterministic automata.

A small syntax (literals, escapes, classes, groups, alternation, ? * + {m,n})
becomes a position automaton with empty moves, subset construction makes it
deterministic over classes of bytes that no rule tells apart, and partition
refinement merges equal states into one transition array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

ANY = frozenset(range(256))
UNBOUNDED = -1


def parse(pattern: str, ignore_case: bool = False) -> tuple:
    """The syntax tree of ``pattern``: ("set", bytes), ("cat", [...]), ("alt", [...]), ("rep", node, low, high)."""
    at = 0

    def fold(chars: frozenset) -> frozenset:
        if not ignore_case:
            return chars
        return chars | {c + 32 for c in chars if 65 <= c <= 90} | {c - 32 for c in chars if 97 <= c <= 122}

    def escape() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def char_class() -> frozenset:
        nonlocal at
        negate = pattern[at] == "^"
        at += negate
        chars: set[int] = set()
        while pattern[at] != "]":
            c = pattern[at]
            at += 1
            low = escape() if c == "\\" else ord(c)
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                c = pattern[at]
                at += 1
                chars |= set(range(low, (escape() if c == "\\" else ord(c)) + 1))
            else:
                chars.add(low)
        at += 1
        return frozenset(ANY - chars if negate else fold(frozenset(chars)))

    def atom() -> tuple:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "(":
            node = alternatives()
            at += 1
            return node
        if c == "[":
            return ("set", char_class())
        if c == ".":
            return ("set", ANY)
        return ("set", fold(frozenset([escape() if c == "\\" else ord(c)])))

    def sequence() -> tuple:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            node = atom()
            while at < len(pattern) and pattern[at] in "?*+{":
                c = pattern[at]
                at += 1
                low, high = {"?": (0, 1), "*": (0, UNBOUNDED), "+": (1, UNBOUNDED)}.get(c, (0, 0))
                if c == "{":
                    end = pattern.index("}", at)
                    left, comma, right = pattern[at:end].partition(",")
                    low = int(left)
                    high = low if not comma else int(right) if right else UNBOUNDED
                    at = end + 1
                node = ("rep", node, low, high)
            parts.append(node)
        return ("cat", parts)

    def alternatives() -> tuple:
        nonlocal at
        options = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            options.append(sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    tree = alternatives()
    if at != len(pattern):
        raise ValueError(f"unreadable at {at}: {pattern}")
    return tree


def reversed_tree(node: tuple) -> tuple:
    if node[0] == "cat":
        return ("cat", [reversed_tree(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [reversed_tree(x) for x in node[1]])
    if node[0] == "rep":
        return ("rep", reversed_tree(node[1]), node[2], node[3])
    return node


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset, int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node: tuple, start: int) -> int:
        """Wire ``node`` from ``start``; returns its end."""
        kind = node[0]
        if kind == "set":
            here, end = self.state(), self.state()
            self.empty[start].append(here)
            self.moves[here] = (node[1], end)
            return end
        if kind == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in node[1]:
                self.empty[self.add(part, start)].append(end)
            return end
        _, body, low, high = node
        for _ in range(low):
            start = self.add(body, start)
        if high == UNBOUNDED:
            loop, end = self.state(), self.state()
            self.empty[start] += [loop]
            self.empty[self.add(body, loop)].append(loop)
            self.empty[loop].append(end)
            return end
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(body, start)
            self.empty[start].append(end)
        return end

    def closures(self) -> list[int]:
        """Per state, a bit set of the states reached by empty moves that read a byte or accept."""
        out = []
        for state in range(len(self.empty)):
            todo, seen = [state], {state}
            while todo:
                for x in self.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            out.append(sum(1 << x for x in seen if self.moves[x] is not None or x in self.ends))
        return out

    ends: dict[int, int] = {}


def _bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


@dataclass(frozen=True)
class Dfa:
    """classes: byte -> class, 256 bytes. table: states x classes. accepts: per
    state the bit mask of the rules it accepts. The first state is 0; dead is
    the state without a way out, or -1."""

    classes: bytes
    table: np.ndarray
    accepts: tuple[int, ...]
    dead: int

    def rows(self) -> list[list]:
        """Rows linked by reference: rows()[0][c] is the next row; the last item of a row is (mask, is_dead)."""
        out: list[list] = [[] for _ in range(len(self.table))]
        for i, row in enumerate(self.table.tolist()):
            out[i].extend(out[j] for j in row)
            out[i].append(self.accepts[i])
            out[i].append(i == self.dead)
        return out


def compile_rules(trees: list[tuple], anywhere: bool, absorb: bool = False) -> Dfa:
    """One minimal automaton for all rules.

    anywhere: a match may begin at every byte. absorb: one accepting state
    without a way out, for "does any rule match at all".
    """
    nfa = _Nfa()
    first = nfa.state()
    nfa.ends = {}
    if anywhere:
        loop = nfa.state()
        nfa.empty[first].append(loop)
        nfa.moves[loop] = (ANY, first)
    for bit, tree in enumerate(trees):
        begin = nfa.state()
        nfa.empty[first].append(begin)
        nfa.ends[nfa.add(tree, begin)] = 1 << bit
    sets = {m[0] for m in nfa.moves if m}
    keys = [tuple(b in s for s in sets) for b in range(256)]
    names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    classes = bytes(names[k] for k in keys)
    samples = [classes.index(i) for i in range(len(names))]
    closures = nfa.closures()
    ends = sum(1 << x for x in nfa.ends)
    arcs = [[(names[keys[samples[c]]], closures[m[1]]) for c in range(len(samples)) if samples[c] in m[0]] if m else [] for m in nfa.moves]
    start = closures[first]
    index, order, table, accepts = {start: 0}, [start], [], []
    at = 0
    while at < len(order):
        here = order[at]
        at += 1
        mask = 0
        for x in _bits(here & ends):
            mask |= nfa.ends[x]
        accepts.append(mask)
        if absorb and mask:
            table.append([at - 1] * len(samples))
            continue
        row = [0] * len(samples)
        for x in _bits(here):
            for c, there in arcs[x]:
                row[c] |= there
        for c, there in enumerate(row):
            if absorb and there & ends:
                there = ends
            if there not in index:
                index[there] = len(order)
                order.append(there)
            row[c] = index[there]
        table.append(row)
    return _minimal(classes, np.array(table), np.array(accepts))


def _minimal(classes: bytes, table: np.ndarray, accepts: np.ndarray) -> Dfa:
    """Refine the partition by accepted rules until successors agree."""
    block = np.unique(accepts, return_inverse=True)[1]
    weights = np.random.default_rng(7).integers(1, 1 << 63, table.shape[1] + 1, np.uint64) | np.uint64(1)
    while True:
        # Rows of successor blocks are told apart by a 64-bit weighted sum ...
        sums = block.astype(np.uint64) * weights[-1] + (block[table].astype(np.uint64) * weights[:-1]).sum(axis=1, dtype=np.uint64)
        again = np.unique(sums, return_inverse=True)[1]
        if again.max() == block.max():
            break
        block = again
    # ... and the outcome is checked: members of a block agree in all successors.
    model = np.zeros(block.max() + 1, np.int64)
    model[block] = np.arange(len(block))
    if (block[table] != block[table[model[block]]]).any() or (accepts != accepts[model[block]]).any():
        raise RuntimeError("states merged by a hash collision")
    renumber = {int(block[0]): 0}
    for b in block.tolist():
        renumber.setdefault(b, len(renumber))
    block = np.array([renumber[b] for b in block.tolist()])
    n = len(renumber)
    small, masks = np.zeros((n, table.shape[1]), np.int64), [0] * n
    small[block] = block[table]
    for b, mask in zip(block.tolist(), accepts.tolist(), strict=True):
        masks[b] = mask
    dead = next((i for i in range(n) if not masks[i] and (small[i] == i).all()), -1)
    return Dfa(classes, small, tuple(masks), dead)
