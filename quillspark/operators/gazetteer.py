"""The default name tagger: names that the store has seen already, found in any case.

Names become an Aho-Corasick automaton over words (Aho and Corasick, 1975), so a
match starts and ends at word bounds by itself and every text is read once, however
many names there are. The automaton is broadcast in waves of at most ``WAVE`` names.
Of overlapping names the leftmost counts, and of those that start together the longest.

Defined results: a name has two words at least, of letters; white space of any kind may
stand between them, no other sign. Null and empty texts and names find nothing.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import rules
from quillspark.functions.text import person_like
from quillspark.session import materialise, ship_code

WORD = re.compile(r"[^\W\d_]+")
#: Names of one automaton: about 100 bytes each in a task.
WAVE = 200_000
SPANS = "array<struct<start:int,stop:int>>"


class Automaton:
    """States hold (moves by word, state of the longest proper suffix, word counts of the names that end here, longest first)."""

    def __init__(self, names: list[str]) -> None:
        self.moves: list[dict[str, int]] = [{}]
        self.fails, self.ends = [0], [[]]
        for name in names:
            words = [w.lower() for w in WORD.findall(name)]
            if len(words) > 1:
                state = 0
                for w in words:
                    if w not in self.moves[state]:
                        self.moves[state][w] = len(self.moves)
                        self.moves.append({})
                        self.fails.append(0)
                        self.ends.append([])
                    state = self.moves[state][w]
                if len(words) not in self.ends[state]:
                    self.ends[state].append(len(words))
        todo = deque(self.moves[0].values())
        while todo:
            state = todo.popleft()
            for w, then in self.moves[state].items():
                self.fails[then] = self._step(self.fails[state], w)
                self.ends[then] = self.ends[then] + self.ends[self.fails[then]]
                todo.append(then)

    def _step(self, state: int, word: str) -> int:
        while state and word not in self.moves[state]:
            state = self.fails[state]
        return self.moves[state].get(word, 0)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, stop) of every name in the text, overlapping ones too."""
        out, state, starts, before = [], 0, [], 0
        for m in WORD.finditer(text):
            if starts and not text[before : m.start()].isspace():
                state, starts = 0, []
            state = self._step(state, m.group().lower())
            starts.append(m.start())
            before = m.end()
            out += [(starts[-n], before) for n in self.ends[state]]
        return out


def leftmost_longest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1][1]:
            out.append((start, stop))
    return out


def name_spans(docs: DataFrame, names: DataFrame, key: str, text: str = "text", name: str = "valor") -> DataFrame:
    """(key, spans): all places of ``names`` in each text, overlapping ones too; texts without any are left out."""
    spark = docs.sparkSession
    ship_code(spark)
    plain = F.lower(F.trim(F.regexp_replace(name, r"[^\p{L}]+", " ")))
    listed = materialise(names.select(plain.alias("name")).filter(F.contains("name", F.lit(" "))).distinct(), "names")
    waves = max(1, -(-listed.count() // WAVE))
    found = []
    for wave in range(waves):
        mine = listed.filter(F.pmod(F.xxhash64("name"), F.lit(waves)) == wave).select("name")
        shared = spark.sparkContext.broadcast(Automaton(sorted(r[0] for r in mine.collect())))  # WAVE names or so

        def body(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for batch in batches:
                spans = [automaton.spans(t) if t else [] for t in batch.column(1).to_pylist()]
                at = [i for i, s in enumerate(spans) if s]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([[{"start": a, "stop": b} for a, b in spans[i]] for i in at], kind)], [key, "spans"])

        found.append(docs.select(key, text).mapInArrow(body, f"`{key}` {docs.schema[key].dataType.simpleString()}, spans {SPANS}"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out if waves == 1 else out.groupBy(key).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def names_in(text: Column, spans: Column) -> Column:
    """The distinct names as they stand in the text: leftmost first, longest of those that start together."""
    ordered = F.array_sort(F.transform(F.array_distinct(spans), lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"))))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        own = F.substr(text, s["start"] + 1, -s["back"] - s["start"])
        taken = F.struct((-s["back"]).alias("free"), F.concat(acc["out"], F.array(own)).alias("out"))
        return F.when(s["start"] >= acc["free"], taken).otherwise(acc)

    return F.array_distinct(F.aggregate(ordered, start, add, lambda acc: acc["out"]))


def upper_names(docs: DataFrame, text: str = "text") -> DataFrame:
    """(valor): names in capitals of ``docs``, which need no gazetteer to be seen."""
    found = F.filter(F.regexp_extract_all(F.col(text), F.lit(f"({rules.UPPER_NAME})"), 1), person_like)
    return docs.select(F.explode(found).alias("valor")).distinct()


def tagger(names: DataFrame, name: str = "valor") -> Callable[[DataFrame], DataFrame]:
    """A tagger for ``plans.ingest``: finds ``names`` in (hash_sha256, text)."""

    def tag(docs: DataFrame) -> DataFrame:
        spans = name_spans(docs, names, "hash_sha256", "text", name)
        return docs.join(spans, "hash_sha256").select("hash_sha256", names_in(F.col("text"), F.col("spans")).alias("nomes"))

    return tag
