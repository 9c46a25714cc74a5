"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a in [0, 1] and
normalised; a = 1 keeps the shares, a = 0 makes all sources equal. Bisection
finds the exponent that meets a target entropy, and the one below which a
source would be repeated too often; the larger one holds. The weights become
token budgets, and each budget is filled from permuted blocks of its source:
whole epochs first, then the blocks and documents that come first in the next
epoch's permutation until the budget is used up.

Nothing is collected but sums: each bisection job evaluates the 31 midpoints of
five levels over the table of source totals. A source may hold any share of the
rows: it is dealt into blocks of about BLOCK documents. Where a budget ends is
one place per source, found by running sums over stretches of its permutation,
then over blocks, then over the rows of one block; every row then tells by
itself how often it comes, and no text crosses the network.

Defined results: null source is a source of its own; null or empty texts have
no tokens and come with every whole epoch; null ids are told apart by text;
rows equal in source, id and text are separate documents that come equally
often; an empty table gives an empty result; extra columns are ignored by
``source_weights`` and kept by ``mix``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.session import materialise

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Documents of a block, and blocks of a stretch of a source's permutation.
BLOCK, RANGE = 1024, 4096
RESULT = ("mix_tokens", "mix_block", "mix_epoch", "mix_at")
LEVELS, ROUNDS = 5, 8
#: Sources up to this many are sent to every task (under 1 MB); more are joined with salt.
MOST_BROADCAST = 5000
SALTS = 16


@dataclass(frozen=True)
class Target:
    """entropy: share of the largest possible entropy that the weights should have.
    repeats: epochs that no source may exceed. budget: tokens of the mixture as a
    multiple of all tokens; None gives every source one epoch at least."""

    entropy: float = 0.95
    repeats: float = 4.0
    budget: float | None = 1.0
    seed: int = 17


def _sums(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """Per exponent: sum of p^a, sum of p^a ln p, largest and smallest p^(a-1)."""
    p, aggs = F.col("share"), []
    for i, a in enumerate(exponents):
        power, rate = F.pow(p, F.lit(a)), F.pow(p, F.lit(a - 1))
        aggs += [F.sum(power).alias(f"z{i}"), F.sum(power * F.log(p)).alias(f"l{i}"), F.max(rate).alias(f"m{i}"), F.min(rate).alias(f"s{i}")]
    row = totals.agg(*aggs).first()
    return [tuple(row[f"{k}{i}"] for k in "zlms") for i in range(len(exponents))]


def bisect(totals: DataFrame, holds: Callable[[float, tuple], bool]) -> tuple[float, float]:
    """The last exponent of [0, 1] at which a predicate holds that is true below
    it and false above, as an interval; (1, 1) if it holds everywhere."""
    if holds(1.0, _sums(totals, [1.0])[0]):
        return 1.0, 1.0
    low, width, steps = 0.0, 1.0, 1 << LEVELS
    for _ in range(ROUNDS):
        # The midpoints of five levels of bisection at once; those levels end beside the last true one.
        grid = [low + width * i / steps for i in range(1, steps)]
        last = max((i for i, x in enumerate(zip(grid, _sums(totals, grid), strict=True), 1) if holds(*x)), default=0)
        low, width = low + width * last / steps, width / steps
    return low, low + width


def exponent(totals: DataFrame, target: Target) -> float:
    """The exponent for sources of positive ``share``."""
    n = totals.count()
    if n < 2:
        return 1.0
    goal = target.entropy * math.log(n)

    def spread(a: float, sums: tuple) -> bool:
        z, l, _, _ = sums
        return math.log(z) - a * l / z >= goal

    def crowded(a: float, sums: tuple) -> bool:
        z, _, most, least = sums
        return (most / least if target.budget is None else target.budget * most / z) > target.repeats

    return max(bisect(totals, spread)[0], bisect(totals, crowded)[1])


def source_weights(rows: DataFrame, target: Target) -> DataFrame:
    """Per source: tokens, n_docs, share, weight, epochs. ``rows`` has source and n_tokens."""
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    totals = materialise(totals.withColumn("share", F.col("tokens") / F.lit(float(max(all_tokens, 1)))), "sources")
    some = totals.filter("share > 0")
    a = exponent(some, target)
    z, _, _, least = _sums(some, [a])[0]
    rate = F.pow("share", F.lit(a - 1))
    epochs = rate / F.lit(least or 1.0) if target.budget is None else rate * F.lit(target.budget / (z or 1.0))
    return totals.withColumns({
        "exponent": F.lit(a),
        "weight": F.when(F.col("share") > 0, F.pow("share", F.lit(a)) / F.lit(z or 1.0)).otherwise(0.0),
        "epochs": F.when(F.col("share") > 0, F.greatest(F.lit(0.0), epochs)).otherwise(1.0),
    })


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), lambda w: w != "")).cast("long")


def _block(h: str, n_docs: str, seed: int) -> Column:
    """The block of a row: blocks hold about BLOCK documents each."""
    return F.pmod(F.xxhash64(h, F.lit(seed + 1)), F.ceil(F.col(n_docs) / BLOCK).cast("long"))


def _block_place(source: str, block: str, epoch: Column, seed: int) -> Column:
    """Where a block stands in the permutation of an epoch; equal places are told apart by the block's number."""
    return F.xxhash64(source, block, epoch, F.lit(seed + 2))


def _row_place(h: str, epoch: Column) -> Column:
    return F.xxhash64(h, epoch)


def cuts(slim: DataFrame, weights: DataFrame, seed: int, sourced: Callable[[DataFrame, DataFrame, str], DataFrame]) -> DataFrame:
    """Per source with a partial last epoch, where it ends: (source, cut_place, cut_block, cut_row, cut_h).

    Sums go over ranges of a source's permutation, then over the blocks of a
    range, then over the rows of the one block in which the budget ends.
    """
    partial = weights.filter(F.col("epochs") > F.floor("epochs")).select(
        "source", "n_docs", F.floor("epochs").cast("int").alias("epoch"), ((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).alias("room"))
    dealt = sourced(slim, partial, "source").withColumn("block", _block("h", "n_docs", seed))
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.first("epoch").alias("epoch"), F.first("room").alias("room"), F.first("n_docs").alias("n_docs"))
    blocks = blocks.withColumn("place", _block_place("source", "block", F.col("epoch"), seed))
    # Places are spread evenly, so equal stretches of them hold about RANGE blocks.
    stretch = F.floor((F.col("place").cast("double") / 2.0**64 + 0.5) * F.ceil(F.col("n_docs") / (BLOCK * RANGE)))
    blocks = materialise(blocks.withColumn("range", stretch), "blocks")
    ranges = blocks.groupBy("source", "range").agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("rsource"), F.col("range").alias("rrange"), F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("above"))
    blocks = blocks.join(ranges, F.col("source").eqNullSafe(F.col("rsource")) & (F.col("range") == F.col("rrange")))
    inside = Window.partitionBy("source", "range").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.col("above") + F.coalesce(F.sum("n").over(inside), F.lit(0))).filter("before < room")
    ends = blocks.groupBy("source").agg(F.max(F.struct("place", "block", "before", "room", "epoch", "n_docs")).alias("end")).select("source", "end.*")
    ends = materialise(ends, "ends")
    # The rows of one block a source.
    rows = sourced(slim, ends, "source").filter(_block("h", "n_docs", seed) == F.col("block")).withColumn("row", _row_place("h", F.col("epoch")))
    order = Window.partitionBy("source").orderBy("row", "h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).filter("before < room")
    return rows.groupBy("source").agg(F.max(F.struct("place", "block", "row", "h")).alias("cut")).select(
        "source", F.col("cut.place").alias("cut_place"), F.col("cut.block").alias("cut_block"), F.col("cut.row").alias("cut_row"), F.col("cut.h").alias("cut_h"))


def mix(docs: DataFrame, target: Target = Target(), doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Rows of ``docs`` as often as their source's budget allows, with mix_* columns.

    mix_tokens are the row's words, mix_block its block, mix_epoch counts a
    source's passes; mix_at in [0, 1) is the row's place in the mixture: sorting
    by it takes blocks in the order of each pass's permutation and interleaves
    the sources in proportion to their weights. Columns of ``docs`` with these
    names give way to them.
    """
    quoted = lambda c: F.col(f"`{c}`")
    own = F.xxhash64(quoted(doc_id).cast("string"), quoted(text), F.lit(target.seed))
    # The row itself is kept whole in one column, so that no name in it can clash.
    kept = [c for c in docs.columns if c.lower() not in RESULT]
    rows = docs.select(F.struct(*[quoted(c) for c in kept]).alias("row"), quoted(source).alias("source"), own.alias("h"), quoted(text).alias("text"))
    slim = materialise(rows.select("source", _words(F.col("text")).alias("n_tokens"), "h"), "tokens")
    weights = materialise(source_weights(slim, target), "weights")
    small = weights.count() <= MOST_BROADCAST

    def sourced(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        """Give each row what is known of its source; one source may be a third of the rows."""
        right = right.withColumnRenamed("source", "its_source")
        if small:
            return left.join(F.broadcast(right), F.col(key).eqNullSafe(F.col("its_source"))).drop("its_source")
        right = right.withColumn("its_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = left.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)).cast("int"))
        return left.join(right, F.col(key).eqNullSafe(F.col("its_source")) & (F.col("salt") == F.col("its_salt"))).drop("its_source", "its_salt", "salt")

    ends = cuts(slim, weights, target.seed, sourced).withColumnRenamed("source", "csource")
    known = materialise(weights.join(ends, F.col("source").eqNullSafe(F.col("csource")), "left").select("source", "n_docs", "epochs", "cut_place", "cut_block", "cut_row", "cut_h"), "budgets")
    placed = sourced(rows, known, "source").withColumn("block", _block("h", "n_docs", target.seed))
    # Pass k is whole if k < floor(epochs); the last pass holds what is left of the budget.
    last = F.floor("epochs").cast("int")
    within = F.struct(_block_place("source", "block", last, target.seed).alias("place"), F.col("block"), _row_place("h", last).alias("row"), F.col("h")) <= F.struct(
        F.col("cut_place").alias("place"), F.col("cut_block").alias("block"), F.col("cut_row").alias("row"), F.col("cut_h").alias("h"))
    passes = last + F.when(F.col("cut_place").isNotNull() & within, 1).otherwise(0)
    out = placed.withColumn("passes", passes).filter("passes > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    share = F.least(_block_place("source", "block", F.col("epoch"), target.seed).cast("double") / 2.0**64 + 0.5, F.lit(1 - 2.0**-53))
    return out.select("row.*", _words(F.col("text")).alias("mix_tokens"), F.col("block").alias("mix_block"), F.col("epoch").alias("mix_epoch"), ((F.col("epoch") + share) / F.ceil("epochs")).alias("mix_at"))
