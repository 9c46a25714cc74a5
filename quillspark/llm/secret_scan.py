"""Secret scanning with combined deterministic automata.

All rules are compiled into one minimal automaton whose transition array reads
every byte of every text once and tells whether any rule can match. Texts with
a hit are read backwards by a second combined automaton that marks the bytes at
which each rule's matches begin; from the leftmost mark a rule's own automaton
runs to the longest end, and so on after it. Matches of a kind never overlap.

Defined results: null text counts as empty (no spans); repeated rows are
scanned one by one; extra columns are ignored; offsets are code points with
exclusive ends. A row needs memory in proportion to its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import automata
from quillspark.session import ship_code


@dataclass(frozen=True)
class Rule:
    """pattern: what a match is. hit: what a text must hold for one that counts.
    least: code points a match needs (group is the value after the separator)."""

    kind: str
    pattern: str
    hit: str
    ignore_case: bool = False
    least: int = 0


#: The base kinds, in their listed order, then the kinds added here.
_ASSIGN = "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=-]"
BASE = (
    Rule("assign", _ASSIGN + _VALUE + "+", _ASSIGN + _VALUE + "{6}", True, 6),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16}", False, 20),
    Rule("hex", "[0-9a-f]{24,}", "[0-9a-f]{24}", False, 24),
)
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{20,}", "gh[pousr]_[A-Za-z0-9]{20}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", "xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("private_key", "-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)


class Scanner:
    """The automata of a rule set; build once on the driver, read-only after."""

    def __init__(self, rules: tuple[Rule, ...] = BASE + ADDED):
        self.rules = rules
        trees = [automata.parse(r.pattern, r.ignore_case) for r in rules]
        self.hit = automata.compile_rules([automata.parse(r.hit, r.ignore_case) for r in rules], anywhere=True, absorb=True)
        self.begins = automata.compile_rules([automata.reversed_tree(t) for t in trees], anywhere=True)
        self.own = [automata.compile_rules([t], anywhere=False) for t in trees]
        # The value of an assignment begins where this prefix, run as far as it goes, ends.
        self.prefix = [automata.compile_rules([automata.parse(_ASSIGN, True)], anywhere=False) if r.kind == "assign" else None for r in rules]
        self._ready()

    def _ready(self) -> None:
        self.hit_row = self.hit.rows()[0]
        self.begin_row = self.begins.rows()[0]
        self.own_rows = [d.rows()[0] for d in self.own]
        self.prefix_rows = [d and d.rows()[0] for d in self.prefix]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.endswith(("_row", "_rows"))}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def may_match(self, data: bytes) -> bool:
        """The one pass over every byte."""
        row = self.hit_row
        for c in data.translate(self.hit.classes):
            row = row[c]
        return row[-2] != 0

    def _longest(self, dfa: automata.Dfa, row: list, data: bytes, at: int) -> int:
        """End of the longest match of an anchored automaton from ``at``."""
        classes, end = dfa.classes, at
        for i in range(at, len(data)):
            row = row[classes[data[i]]]
            if row[-2]:
                end = i + 1
            elif row[-1]:
                break
        return end

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """(start, kind, end) by start, then by the order of the rules."""
        data = text.encode("utf-8", "surrogatepass")
        if not self.may_match(data):
            return []
        marks: list[list[int]] = [[] for _ in self.rules]
        row, i = self.begin_row, len(data)
        for c in data.translate(self.begins.classes)[::-1]:
            row = row[c]
            i -= 1
            if row[-2]:
                mask = row[-2]
                for k in range(len(marks)):
                    if mask >> k & 1:
                        marks[k].append(i)
        found = []
        for k, rule in enumerate(self.rules):
            free = 0
            for at in reversed(marks[k]):
                if at < free:
                    continue
                end = self._longest(self.own[k], self.own_rows[k], data, at)
                free = end
                value = self._longest(self.prefix[k], self.prefix_rows[k], data, at) if self.prefix[k] else at
                if len(data[value:end].decode("utf-8", "surrogatepass")) >= rule.least:
                    found.append((at, k, end))
        found.sort()
        if len(data) == len(text):
            return [(a, self.rules[k].kind, b) for a, k, b in found]
        points, last, so_far = {}, 0, 0
        for n in sorted({n for a, _, b in found for n in (a, b)}):  # each byte is decoded once
            so_far += len(data[last:n].decode("utf-8", "surrogatepass"))
            points[n], last = so_far, n
        return [(points[a], self.rules[k].kind, points[b]) for a, k, b in found]


def find_spans(docs: DataFrame, scanner: Scanner | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for a, k, b in own.spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(body, "doc_id long, spans array<struct<kind: string, start: bigint, end: bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of find_spans(), in DataFrame expressions."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
