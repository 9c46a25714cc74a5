"""Line-first quality cleaning, as plain DataFrame expressions.

Every line is judged by itself (punctuation, navigation, boilerplate, symbols,
shouting, stutter); failing lines are removed; a document that loses too much
of its text is rejected, as is one that fails the base rules. There is no
Python in the plan and no shuffle: a document is one row, and repeats inside it
are found with hash sets over its own arrays.

Defined results: null or empty text has no words, so it fails the base rules;
extra columns pass through untouched unless they bear the name of a result
column, which then replaces them; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base measures.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document verdict.

    min_words, max_repeat_pct: base rules. symbol_pct: symbols per word at
    which a line counts as junk, in percent. shout_pct: words ending in ``!!``.
    bars: separators per ten words that make a line a menu. stutter_pct: words
    equal to the word before. boilerplate: a pattern of lines that carry a
    licence, a consent notice or a site's own chrome. max_lost_pct: share of
    word characters a document may lose before it is rejected.
    """

    min_words: int = 20
    max_repeat_pct: int = 30
    symbol_pct: int = 50
    shout_pct: int = 50
    bars: int = 3
    stutter_pct: int = 40
    max_lost_pct: int = 50
    boilerplate: str = (
        r"(?i)^[^a-z]*(licensed under|all rights reserved|copyright (\(c\)|[0-9]{4})|spdx-license-identifier|"
        r"cookie policy|we use cookies|accept (all )?cookies|privacy policy|terms of (use|service)|"
        r"enable javascript|sign in|log in|subscribe|share this|read more|skip to content|permission is hereby granted)"
    )


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once. Inside a lambda, an outer expression
    would otherwise be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words lying in a window of WINDOW words that the text holds twice or more.

    Words are hashed to 64 bits, windows again; a text without equal window
    hashes (nearly all) stops at a hash-set comparison. Else hashes sort with
    their positions, starts whose neighbour has the same hash are the repeated
    windows, and the union of [start, start + WINDOW) is a sum of capped gaps.
    """

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashed) - F.lit(WINDOW - 1)), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(-1, WINDOW - 1)]))

    def starts(ordered: Column) -> Column:
        # get() beyond either end gives null, which equals no hash.
        same = lambda s, k: F.coalesce(s["h"] == F.get(ordered, k)["h"], F.lit(False))
        marked = F.transform(ordered, lambda s, k: F.when(same(s, k - 1) | same(s, k + 1), s["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(ws: Column) -> Column:
        ordered = F.sort_array(F.transform(ws, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.aggregate(
            let(ordered, starts),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("n")),
            lambda acc: acc["n"],
        )

    none = F.lit(0).cast("long")
    repeated = let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), none).otherwise(covered(ws)))
    return F.when(F.size(words) <= WINDOW, none).otherwise(repeated)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_passes(line: Column, rules: LineRules) -> Column:
    """Whether one line stays. Lines without a word always stay: they hold nothing."""
    n = _count(line, WORD_CHAR + "+")
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    shouts = _count(line, r"!!(?=[\x20\x09-\x0D]|$)")
    bars = _count(line, r"(?:^|[\x20\x09-\x0D])[|>»•](?=[\x20\x09-\x0D]|$)")
    stutter = F.when(n < 5, F.lit(0)).otherwise(_count(line, r"(?:^|(?<=[\x20\x09-\x0D]))([^\x20\x09-\x0D]+)(?=[\x20\x09-\x0D]+\1(?:[\x20\x09-\x0D]|$))"))
    return (
        (n == 0)
        | (
            (symbols * 100 <= n * rules.symbol_pct)
            & (shouts * 100 <= n * rules.shout_pct)
            & (bars * 10 < n * rules.bars)
            & (stutter * 100 <= n * rules.stutter_pct)
            & ~line.rlike(rules.boilerplate)
        )
    )


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """``docs`` with the base measures, ``cleaned`` text, ``base_failed`` and ``kept``."""
    taken = {c.lower() for c in docs.columns}
    whole, cut = (next(n for k in range(len(taken) + 1) if (n := f"_{name}{k}") not in taken) for name in ("t", "w"))
    words = words_of(F.col(whole))
    lines = F.split(F.col(whole), "\n", -1)
    squeezed = F.regexp_replace(F.col(whole), WORD_GAP, "")
    kept_lines = F.filter(lines, lambda x: line_passes(x, rules))
    worded = F.filter(lines, lambda x: x.rlike(WORD_CHAR))
    out = docs.withColumn(whole, F.coalesce(F.col(text), F.lit(""))).withColumn(cut, words)
    out = out.withColumns(
        {
            "n_words": F.size(cut).cast("long"),
            "word_chars": F.length(squeezed).cast("long"),
            "n_symbols": (F.length(F.col(whole)) - F.length(F.translate(F.col(whole), SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": _repeat_words(F.col(cut)),
            "cleaned": F.array_join(kept_lines, "\n"),
        }
    )
    out = out.withColumn("kept_chars", F.length(F.regexp_replace("cleaned", WORD_GAP, "")).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_pct))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") * 100 >= F.col("word_chars") * (100 - rules.max_lost_pct)))
    return out.drop(whole, cut)
