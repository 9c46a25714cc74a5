"""Toxicity scores of deobfuscated text.

Noisy channel: a token that mixes letters with digits or symbols, repeats a
letter, or is spelled with gaps is a lattice of characters. Viterbi finds the
letters most likely sent, by a character trigram model counted over all
documents and by the costs of the channel (leetspeak, gaps, repetition). A
sparse logistic model over the restored words then scores the text.

Tokens and spelled runs over LONGEST characters are read too: drawn-out letters
are shortened, glued words taken apart, and spelled-out sentences cut into words
by the character model.

The trigram table is bounded by the alphabet, not by the corpus. The classifier
is fitted on a bounded, hash-ordered sample of labelled rows (``max_rows``).
Labels, language, source and id never enter a score.

Defined results: null or empty text scores by the model's bias; repeated rows
score alike; an empty table or no usable label gives the constant model 0;
extra columns are ignored; a row needs memory in proportion to its own text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship_code

#: Fixed values of the channel: what a sign may stand for. Costs are negative log odds.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
GAPS = "-_.*~'’·^#,:;/\\ "
LEET_COST, GAP_COST, REPEAT_COST, LOST_COST = 0.7, 0.4, 0.3, 4.0
#: Letters that the character model keeps: Latin with its accents.
ALPHABET = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
EDGE = "^"
STRIP = ".,;:!?\"()[]{}|#$%&*<>«»“”„-_~=/\\'’"
FLOOR = 0.05
SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+])(?: (?:[^\W_]|[@$!|+])){2,}(?!\S)")
#: In what is longer than LONGEST: drawn-out signs, and the signs between its words.
DRAWN = re.compile(r"(.)\1{3,}", re.S)
GLUE = re.compile(r"(?:[^\w@$!|+(<€£]|_)+")
REPEATS = re.compile(r"(\w)\1\1")
MIXED = re.compile(r"[^\W\d_][-0-9@$!|+(<€£_.*~'’·^#]+[^\W\d_]|^[0-9@$!|+(<€£]{1,3}[^\W\d_]{2}|[^\W\d_]{2}[0-9@$€£]{1,2}$")
LONGEST = 40
BITS = 22


@dataclass(frozen=True)
class Settings:
    """max_rows: labelled rows the classifier may see. least_docs: documents a
    feature needs. l1: weight of the sparsity term. rounds: gradient steps.
    least_sure: toxic share at which one feature decides by itself."""

    max_rows: int = 8000
    least_docs: int = 3
    l1: float = 1e-4
    rounds: int = 300
    least_sure: float = 0.9


class CharModel:
    """log P(c | a, b) of a letter trigram model with a floor for unseen ones."""

    def __init__(self, counts: dict[str, int]):
        after: Counter[str] = Counter()
        for gram, n in counts.items():
            after[gram[:2]] += n
        size = len(ALPHABET) + 1
        self.known = {g: math.log((n + FLOOR) / (after[g[:2]] + FLOOR * size)) for g, n in counts.items()}
        self.unseen = {g: math.log(FLOOR / (n + FLOOR * size)) for g, n in after.items()}
        self.none = -math.log(size)

    def logp(self, pair: str, c: str) -> float:
        got = self.known.get(pair + c)
        return got if got is not None else self.unseen.get(pair, self.none)


def _arcs(token: str, at: int) -> list[tuple[str, float]]:
    """What the sign at a place may have been sent for ("" for nothing), with its cost."""
    c = token[at]
    again = at > 0 and token[at - 1] == c
    if c in ALPHABET:
        return [(c, 0.0), ("", REPEAT_COST)] if again else [(c, 0.0)]
    return [*((x, LEET_COST) for x in LEET.get(c, "")), ("", GAP_COST if c in GAPS else REPEAT_COST if again else LOST_COST)]


def _read(chain: tuple | None) -> str:
    out = []
    while chain is not None:
        chain, sign = chain
        out.append(sign)
    return "".join(reversed(out))


def restore(token: str, model: CharModel) -> str:
    """The letters most likely sent as ``token``: Viterbi over its lattice, exact, in linear time."""
    # state: the last two letters -> (cost, chain of letters)
    states: dict[str, tuple[float, tuple | None]] = {EDGE + EDGE: (0.0, None)}
    for at in range(len(token)):
        after: dict[str, tuple[float, tuple | None]] = {}
        arcs = _arcs(token, at)
        for pair, (cost, chain) in states.items():
            for letter, extra in arcs:
                if letter:
                    there, total, read = pair[1] + letter, cost + extra - model.logp(pair, letter), (chain, letter)
                else:
                    there, total, read = pair, cost + extra, chain
                if there not in after or total < after[there][0]:
                    after[there] = (total, read)
        states = after
    return _read(min(((cost - model.logp(pair, EDGE), chain) for pair, (cost, chain) in states.items()), key=lambda s: s[0])[1])


def segmented(letters: str, model: CharModel) -> list[str]:
    """The words most likely sent as a spelled-out sentence without gaps: Viterbi with word ends, in linear time."""
    # state: the last two letters -> (cost, chain of what was read; " " ends a word)
    states: dict[str, tuple[float, tuple | None]] = {EDGE + EDGE: (0.0, None)}
    for c in letters:
        arcs = [(c, 0.0)] if c in ALPHABET else [(x, LEET_COST) for x in LEET.get(c, "")]
        after: dict[str, tuple[float, tuple | None]] = {} if arcs else {p: (cost + LOST_COST, chain) for p, (cost, chain) in states.items()}
        for pair, (cost, chain) in states.items():
            starts = [(pair, cost, chain)]
            if pair[1] != EDGE:
                starts.append((EDGE + EDGE, cost - model.logp(pair, EDGE), (chain, " ")))
            for before, so_far, read in starts:
                for letter, extra in arcs:
                    there, total = before[1] + letter, so_far + extra - model.logp(before, letter)
                    if there not in after or total < after[there][0]:
                        after[there] = (total, (read, letter))
        states = after
    return _read(min(((cost - model.logp(pair, EDGE), chain) for pair, (cost, chain) in states.items()), key=lambda s: s[0])[1]).split()


def undressed(token: str) -> str:
    """Without the run of one sign at its end, if it is one of two or more."""
    if token and not (token[-1].isalnum() or token[-1] == "_"):
        rest = token.rstrip(token[-1])
        return rest if len(token) - len(rest) > 1 else token
    return token


def lattice_worthy(token: str) -> bool:
    return 3 <= len(token) <= LONGEST and (MIXED.search(token) is not None or REPEATS.search(token) is not None)


class Reader:
    """Distinct restored words of a text, with a bounded memo of tokens."""

    def __init__(self, model: CharModel):
        self.model = model
        self.memo: dict[str, str] = {}

    def word(self, token: str) -> str:
        bare = token.strip(STRIP)
        if bare.isalpha() and not REPEATS.search(bare):
            return bare if len(bare) <= LONGEST else ""
        # Signs inside or before letters may be letters; a run behind them is dressing.
        core = token.rstrip(".,;:?\"").rstrip("#%&*")
        core = undressed(core).lstrip("\"'«“„([{#%&*")
        if lattice_worthy(core):
            return restore(core, self.model)
        return bare if len(bare) <= LONGEST and any(map(str.isalpha, bare)) else ""

    def spelled(self, letters: str) -> list[str]:
        """Words of a run of single letters."""
        if len(letters) > LONGEST:
            letters = DRAWN.sub(r"\1\1\1", letters)
        return [restore(letters, self.model)] if len(letters) <= LONGEST else segmented(letters, self.model)

    def long_words(self, token: str) -> list[str]:
        """Words of a token over LONGEST characters."""
        whole = self.word(token)
        if whole:
            return [whole]
        token = DRAWN.sub(r"\1\1\1", token)
        if len(token) <= LONGEST:
            return [self.word(token)]
        out: list[str] = []
        for single, parts in groupby(filter(None, GLUE.split(token)), lambda p: len(p) == 1):
            if single:
                letters = "".join(parts)
                out += self.spelled(letters) if len(letters) > 2 else list(letters)
            else:
                for part in parts:
                    # Signs that may be letters part words only where the whole is too long for one.
                    out += [self.word(part)] if len(part) <= LONGEST else [self.joined(p) for p in re.split(r"\W+", part)]
        return out

    def joined(self, part: str) -> str:
        """One unbroken run of letters and digits of any length, restored as a whole."""
        if len(part) <= LONGEST:
            return self.word(part)
        if MIXED.search(part) is None and REPEATS.search(part) is None:
            return part if any(map(str.isalpha, part)) else ""
        return restore(part, self.model)

    def words(self, text: str) -> set[str]:
        low = text.lower()
        memo, tokens = self.memo, set(low.split())
        if len(memo) > 300_000:
            memo.clear()
        out = set()
        for t in tokens:
            if len(t) > LONGEST:
                out.update(self.long_words(t))
                continue
            w = memo.get(t)
            if w is None:
                w = memo[t] = self.word(t)
            out.add(w)
        for m in SPACED.finditer(low):
            out.update(self.spelled(m[0].replace(" ", "")))
        out.discard("")
        return out


def features(word: str) -> list[int]:
    """Hashed features of a word: itself and its beginnings."""
    keys = ["w" + word] + ["p" + word[:n] for n in range(4, 8) if len(word) > n]
    return [zlib.crc32(k.encode()) >> (32 - BITS) for k in keys]


def char_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): letter trigrams of all words of all documents, words weighted by frequency.

    Each task sums its own words first, so at most len(ALPHABET)**3 rows leave it.
    """

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: Counter[str] = Counter()
        for batch in batches:
            words: Counter[str] = Counter()
            for t in batch.column(0):
                words.update((t.as_py() or "").lower().split())
            for token, n in words.items():
                w = token.strip(STRIP)
                if len(w) <= LONGEST and w and not w.strip(ALPHABET):
                    marked = EDGE + EDGE + w + EDGE
                    for i in range(len(marked) - 2):
                        grams[marked[i : i + 3]] += n
        keep = [(g, n) for g, n in grams.items() if all(c in ALPHABET or c == EDGE for c in g)]
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in keep], pa.string()), pa.array([n for _, n in keep], pa.int64())], ["gram", "n"])

    return docs.select(text).mapInArrow(body, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@dataclass
class ToxicityModel:
    chars: CharModel
    weights: dict[int, float]
    bias: float
    sure: dict[int, float]

    def score(self, words: set[str], memo: dict[str, tuple[int, ...]]) -> float:
        hit: set[int] = set()
        for w in words:
            ids = memo.get(w)
            if ids is None:
                if len(memo) > 300_000:
                    memo.clear()
                ids = memo[w] = tuple(f for f in features(w) if f in self.weights)
            if ids:
                hit.update(ids)
        z = self.bias + sum(self.weights[f] for f in hit)
        summed = 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
        # A long text has room for many mild signs; one decisive word must not drown in it.
        return max(summed, max((self.sure.get(f, 0.0) for f in hit), default=0.0))


def fit(rows: list[np.ndarray], labels: np.ndarray, settings: Settings) -> tuple[dict[int, float], float, dict[int, float]]:
    """Sparse logistic regression by accelerated proximal steps over binary features."""
    if not len(rows) or labels.min() == labels.max():
        return {}, 40.0 if len(labels) and labels.min() == 1 else -40.0, {}
    flat = np.concatenate(rows)
    frequent = np.flatnonzero(np.bincount(flat, minlength=1 << BITS) >= settings.least_docs)
    place = np.full(1 << BITS, -1, np.int64)
    place[frequent] = np.arange(len(frequent))
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = place[flat]
    doc, col = doc[col >= 0], col[col >= 0]
    y, n, m = labels.astype(float), len(rows), len(frequent)
    w, bias = np.zeros(m), math.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    # Per-feature steps: a feature's curvature grows with the documents that hold it.
    share = np.bincount(col, minlength=m) / n
    per_doc = max(1.0, np.bincount(doc, minlength=n).mean())
    step = 1.0 / (0.25 * share * min(per_doc, 40.0) + 1e-3)
    ahead, old, t = w.copy(), w.copy(), 1.0
    for _ in range(settings.rounds):
        z = bias + np.bincount(doc, weights=ahead[col], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        g = np.bincount(col, weights=((p - y) / n)[doc], minlength=m)
        bias -= 0.5 * float((p - y).mean())
        moved = ahead - step * g
        w = np.sign(moved) * np.maximum(np.abs(moved) - step * settings.l1, 0)
        if float(g @ (w - old)) > 0:
            t = 1.0
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, old, t = w + (t - 1) / t_next * (w - old), w, t_next
    live = np.flatnonzero(np.abs(w) > 1e-6)
    toxic, held = np.bincount(col, weights=y[doc], minlength=m), np.bincount(col, minlength=m)
    share = (toxic - 1) / (held + 2)
    sure = {int(frequent[i]): float(share[i]) for i in live if w[i] > 0 and share[i] >= settings.least_sure}
    return {int(frequent[i]): float(w[i]) for i in live}, bias, sure


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ToxicityModel:
    """A model from all documents (characters) and a bounded sample of the labelled rows."""
    ship_code(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    chars = CharModel({r["gram"]: r["n"] for r in char_counts(docs, text).collect()})
    usable = labels.filter(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull() & ~held_out(F.col(doc_id)))
    sample = usable.select(F.col(doc_id).alias("id"), F.col(toxic).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(settings.max_rows)
    # At most max_rows ids and labels: small enough to send to every task.
    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id").select("text", "y")
    shared = sc.broadcast(chars)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            rows = [np.unique(np.array([f for w in reader.words(t.as_py() or "") for f in features(w)], np.int32)).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], ["f", "y"])

    got = chosen.mapInArrow(body, "f binary, y int").orderBy(F.xxhash64("f"), "f", "y").toArrow()
    rows = [np.frombuffer(x.as_py(), np.int32) for x in got.column("f")]
    weights, bias, sure = fit(rows, np.array(got.column("y").to_pylist(), np.int64), settings)
    return ToxicityModel(chars, weights, bias, sure)


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader, memo = Reader(own.chars), {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(reader.words(t.as_py() or ""), memo) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(body, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that score below ``threshold``."""
    place = docs.columns.index(text)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        reader, memo = Reader(own.chars), {}
        for batch in batches:
            keep = [own.score(reader.words(t.as_py() or ""), memo) < threshold for t in batch.column(place)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    ship_code(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(body, docs.schema)
