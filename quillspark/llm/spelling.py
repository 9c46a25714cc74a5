"""Spelling variants: words one edit apart, and the frequent form each belongs to.

Words are counted over all documents. The vocabulary is dealt by range into
shards, each a compact trie: edges hold strings, the children of a node stand
together, and the nodes are columns of one row. Shards are broadcast in waves of
bounded size. Every word is met with every shard: its distance-one Levenshtein
automaton is run over the trie depth-first. The automaton's single edit is placed
at the first difference, so an accepted neighbour is reached on one path only:
the walk follows the word itself and leaves it once, at each branch.

Defined results. A null text has no words; a row without an id counts with an
empty one. Runs are counted whole, however long; a word of a million letters
costs time in proportion to its length. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialise, ship_code

TRIE = "heads string, labels string, starts binary, child binary, counts binary"
NEAR = "word string, n_near long, best struct<rank: long, form: string>"


@dataclass(frozen=True)
class Spelling:
    """Letters of words, least length and count, the ratio from which a neighbour is a word's form, words of a shard and bytes of a wave."""

    letters: str = "A-Za-zÀ-ÿ"
    min_length: int = 6
    min_count: int = 5
    ratio: int = 5
    typo_every: int = 199
    shard_words: int = 50_000
    wave_bytes: int = 32 << 20


def word_counts(docs: DataFrame, how: Spelling) -> DataFrame:
    """(word, n) of the words that are long and frequent enough.

    An occurrence whose checksum is divisible by ``typo_every`` loses one letter:
    the planted misspellings that the contract asks for. Shorter runs than
    ``min_length`` can only become shorter, so they are not even cut out.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(f"([{how.letters}]{{{how.min_length},}})"), 1)).alias("run")
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run)
    words = words.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    words = words.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"), F.length("run").alias("long"))
    cut = (F.col("h") % F.col("long")).cast("int")
    word = F.when(F.col("h") % how.typo_every == 0, F.concat(F.substr("run", F.lit(1), cut), F.substr("run", cut + 2, F.col("long")))).otherwise(F.col("run"))
    counted = words.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= how.min_count) & (F.length("word") >= how.min_length))


class Trie(NamedTuple):
    """Nodes in level order; ``child[k]:child[k + 1]`` are the children of k, ``counts[k]`` is 0 where no word ends.

    The label of k is ``labels[starts[k]:starts[k + 1]]``; ``heads`` has its first letters, so a child is found by ``find``.
    """

    heads: str
    labels: str
    starts: memoryview | np.ndarray
    child: memoryview | np.ndarray
    counts: memoryview | np.ndarray


def common(a: str, b: str, start: int) -> int:
    """Where two words that agree before ``start`` differ first."""
    end = min(len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    while a[start] == b[start]:
        start += 1
    return start


def build_trie(words: list[str], counts: list[int]) -> Trie:
    """Trie of sorted distinct words."""
    labels, ends, child = [""], [0], []
    todo = [(0, len(words), 0)]
    if words and not words[0]:
        ends[0], todo[0] = counts[0], (1, len(words), 0)
    for low, high, depth in todo:  # grows while it is read: level order
        child.append(len(todo))
        while low < high:
            first = words[low]
            # the last word of this child: words are sorted, so those with the same letter stand together
            a, b = low, high - 1
            while a < b:
                middle = (a + b + 1) // 2
                a, b = (middle, b) if words[middle][depth] == first[depth] else (a, middle - 1)
            end = common(first, words[a], depth)
            own = len(first) == end
            labels.append(first[depth:end])
            ends.append(counts[low] if own else 0)
            todo.append((low + own, a + 1, end))
            low = a + 1
    child.append(len(todo))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in labels])]).astype(np.int32)
    return Trie("\0" + "".join(x[0] for x in labels[1:]), "".join(labels), starts, np.array(child, np.int32), np.array(ends, np.int64))


def find_exact(trie: Trie, node: int, skip: int, word: str, at: int) -> int:
    """The count of the word that ends where ``word[at:]`` leads from ``skip`` letters into the label of ``node``; 0 if none."""
    heads, labels, starts, child, counts = trie
    while True:
        low, high = starts[node] + skip, starts[node + 1]
        if not word.startswith(labels[low:high], at):
            return 0
        at += high - low
        if at == len(word):
            return counts[node]
        node = heads.find(word[at], child[node], child[node + 1])
        if node < 0:
            return 0
        skip = 0


def neighbours(trie: Trie, word: str) -> Iterator[tuple[str, int]]:
    """(neighbour, count) of every word of the trie at distance one."""
    heads, labels, starts, child, counts = trie
    size, node, at = len(word), 0, 0
    while True:
        # ``word[:at]`` leads to ``node``. Leave the word here: another letter in place of its next one, before it, or none.
        same = heads.find(word[at], child[node], child[node + 1]) if at < size else -1
        if at == size - 1 and counts[node]:
            yield word[:at], counts[node]
        for other in range(child[node], child[node + 1]):
            if other != same:
                letter = heads[other]
                if at < size and (n := find_exact(trie, other, 1, word, at + 1)):
                    yield word[:at] + letter + word[at + 1 :], n
                if n := find_exact(trie, other, 1, word, at):
                    yield word[:at] + letter + word[at:], n
                if at + 1 < size and letter == word[at + 1] and (n := find_exact(trie, other, 0, word, at + 1)):
                    yield word[:at] + word[at + 1 :], n
        if same < 0:
            return
        low, high = starts[same], starts[same + 1]
        label = labels[low:high]
        if not word.startswith(label, at):
            # The word leaves inside this edge, where there is one letter to go on with, or ends inside it.
            k = common(label, word[at : at + len(label)], 0)
            p = at + k
            if p < size and (n := find_exact(trie, same, k + 1, word, p + 1)):
                yield word[:p] + label[k] + word[p + 1 :], n
            if n := find_exact(trie, same, k + 1, word, p):
                yield word[:p] + label[k] + word[p:], n
            if p + 1 < size and (n := find_exact(trie, same, k, word, p + 1)):
                yield word[:p] + word[p + 1 :], n
            return
        node, at = same, at + len(label)


def trie_shards(words: DataFrame, how: Spelling) -> DataFrame:
    """One row of trie columns per shard of ``words`` (word, n)."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        counts: list[int] = []

        def shard() -> pa.RecordBatch:
            t = build_trie(held, counts)
            columns = [pa.array([t.heads]), pa.array([t.labels]), *[pa.array([x.tobytes()], pa.binary()) for x in (t.starts, t.child, t.counts)]]
            held.clear()
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, ["heads", "labels", "starts", "child", "counts"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            counts += batch.column(1).to_pylist()
            if len(held) >= how.shard_words:
                yield shard()
        if held:
            yield shard()

    parts = max(1, -(-words.count() // how.shard_words))
    return words.repartitionByRange(parts, "word").sortWithinPartitions("word").mapInArrow(body, TRIE)


def near_words(words: DataFrame, how: Spelling) -> DataFrame:
    """(word, n_near, best) of the words of ``words`` (word, n) that have neighbours; best is (-n, form) of the most frequent one."""
    spark = words.sparkSession
    shards = materialise(trie_shards(words, how).withColumn("bytes", F.length("heads") + F.length("labels") + F.length("starts") + F.length("child") + F.length("counts")).withColumn("shard", F.monotonically_increasing_id()), "shards")
    waves: list[list[int]] = []
    room = 0
    for shard, size in shards.select("shard", "bytes").orderBy("shard").collect():  # two numbers for each shard_words words
        if not waves or size > room:
            waves.append([])
            room = how.wave_bytes
        waves[-1].append(shard)
        room -= size
    found = []
    for wave in waves:
        tries = spark.sparkContext.broadcast(shards.filter(F.col("shard").between(wave[0], wave[-1])).select("heads", "labels", "starts", "child", "counts").toArrow())

        def body(batches: Iterator[pa.RecordBatch], tries: object = tries) -> Iterator[pa.RecordBatch]:
            loaded = [Trie(r["heads"], r["labels"], memoryview(r["starts"]).cast("i"), memoryview(r["child"]).cast("i"), memoryview(r["counts"]).cast("q")) for r in tries.value.to_pylist()]
            for batch in batches:
                words, sizes, best = [], [], []
                for word in batch.column(0).to_pylist():
                    hits = [(-n, form) for trie in loaded for form, n in neighbours(trie, word)]
                    if hits:
                        words.append(word)
                        sizes.append(len(hits))
                        best.append(dict(zip(("rank", "form"), min(hits), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(sizes, pa.int64()), pa.array(best, pa.struct([("rank", pa.int64()), ("form", pa.string())]))], ["word", "n_near", "best"])

        # hashed, since words of one prefix are work of one kind
        dealt = words.select("word").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "word")
        found.append(materialise(dealt.mapInArrow(body, NEAR), "near"))
        tries.destroy()
    out = found[0] if found else spark.createDataFrame([], NEAR)
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, root): every step follows twice as many forms, which rise in count, so few steps do."""
    forms = materialise(forms, "forms")
    while not forms.select(F.col("root").alias("word")).distinct().join(forms, "word", "left_semi").isEmpty():
        on = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        forms = materialise(forms.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
    return forms


def variants(docs: DataFrame, how: Spelling = Spelling()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of ``docs`` (doc_id, text)."""
    ship_code(docs.sparkSession)
    words = materialise(word_counts(docs, how), "words")
    joined = words.join(near_words(words, how), "word", "left")
    form = F.when(-F.col("best.rank") >= how.ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.rank")).alias("n")))
    known = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.getField("form").alias("form"), form.getField("n").alias("form_n")), "known")
    roots = _roots(known.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
