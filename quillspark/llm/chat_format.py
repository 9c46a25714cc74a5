"""Chat formatting by incremental rendering of a black-box template.

A template is any function from turns to a string. It is rendered for
successive prefixes of a conversation; what an output adds to the one before is
the new turn's span. Two probes that differ in one character of the new turn's
text locate the text inside that span, which gives the loss mask. An output
that does not begin with the one before is a template that rewrites history,
and is reported as such.

Conversations stream: rows are dealt by conversation, sorted by turn and read
one after another. A template renders whole prefixes, which takes memory for one
conversation and time that grows with the square of its length. Only a template
declared local with ``local()`` renders the last turns, so that a conversation
of any length needs little memory. Defined results: null text or role counts as empty;
a null conversation id is a conversation of its own; repeated turns stay, in
the order of (turn, role, text), nulls first; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship_code

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Fixed values of the default template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
LOOKBACK = 16
TURN_SCHEMA = "conv_id long, turn long, role string, formatted string, span_start long, text_start long, text_end long, loss boolean, rewritten boolean"


def escape(text: str) -> str:
    """Texts cannot hold a control string: every ``<|`` gets a backslash, backslashes double."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def local(lookback: int) -> Callable[[Template], Template]:
    """Declares that what a turn adds depends on at most ``lookback`` turns before it, and that no turn changes what came before."""

    def mark(template: Template) -> Template:
        template.lookback = lookback
        return template

    return mark


@local(LOOKBACK)
def marked_turns(turns: list[Turn]) -> str:
    """The default template: marked turns, roles on a line of their own."""
    return "".join(f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n{escape(text)}{CLOSE}\n" for role, text in turns)


def _step(template: Template, history: list[Turn], turn: Turn, before: str) -> tuple[str, int, int, int, bool]:
    """The output with ``turn`` after ``history``, where its part begins, its text's bounds in the output, whether history changed."""
    after = template([*history, turn])
    rewritten = not after.startswith(before)
    keep = len(os.path.commonprefix([before, after])) if rewritten else len(before)
    one, two = template([*history, (turn[0], "a")]), template([*history, (turn[0], "b")])
    start = len(os.path.commonprefix([one, two]))
    if start == len(one):  # the template does not show this text
        return after, keep, len(after), len(after), rewritten
    tail = len(one) - start - 1
    # Outputs that part may still agree by chance on signs of the text.
    return after, min(keep, start) if rewritten else keep, start, len(after) - tail, rewritten


def added(template: Template, history: list[Turn], turn: Turn) -> tuple[str, int, int, bool]:
    """What ``turn`` adds after ``history``: text, place of the turn's text in it, whether history changed."""
    after, keep, start, end, rewritten = _step(template, history, turn, template(history))
    return after[keep:], start - keep, end - keep, rewritten


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame, template: Template = marked_turns, lookback: int | None = None, trained_role: str = "assistant") -> DataFrame:
    """One row per turn: its part of the output, spans in the whole output, loss flag.

    The part that a turn adds may depend on all turns before it; on the
    ``lookback`` turns before it if that is given, or declared by the template.
    Where a turn rewrites history, its span begins where the outputs part.
    Rows come sorted by conversation and turn inside each partition.
    """

    window = getattr(template, "lookback", None) if lookback is None else lookback

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = body
        history: list[Turn] = []
        offset, before = 0, ""
        for batch in batches:
            out: list[list] = [[] for _ in range(9)]
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != current or current is body:
                    current, history, offset = conv, [], 0
                    before = template([])
                said = (role or "", text or "")
                if window is None:
                    before, offset, a, b, rewritten = _step(template, history, said, before)
                    piece, a, b = before[offset:], a - offset, b - offset
                else:
                    piece, a, b, rewritten = added(template, history, said)
                for column, value in zip(out, (conv, turn, said[0], piece, offset, offset + a, offset + b, role == trained_role, rewritten), strict=True):
                    column.append(value)
                offset += len(piece)
                history.append(said)
                if window is not None:
                    del history[: max(0, len(history) - window)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()], strict=True)],
                ["conv_id", "turn", "role", "formatted", "span_start", "text_start", "text_end", "loss", "rewritten"],
            )

    ship_code(conversations.sparkSession)
    return _sorted(conversations).mapInArrow(body, TURN_SCHEMA)


def read_turn(piece: str) -> Turn:
    """Role and text back from one turn of the default template's output."""
    inner = piece.removeprefix(OPEN).removesuffix("\n").removesuffix(CLOSE)
    head = re.match(r"(?:[^\\\n]|\\.)*", inner, flags=re.S)[0]
    return unescape(head), unescape(inner[len(head) + 1 :])


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from format_turns() rows in their order: what reads back."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = body
        state: list = []

        def done() -> list[list]:
            return [[current], [state[0]], [state[1].hexdigest()], [state[2]], [state[3].hexdigest()], [state[4]], [state[5]]]

        def pack(columns: list[list]) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"])

        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            names = ["conv_id", "formatted", "span_start", "text_start", "text_end", "loss", "rewritten"]
            for conv, piece, at, a, b, loss, rewritten in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if conv != current or current is body:
                    if state:
                        out = [x + y for x, y in zip(out, done(), strict=True)]
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                role, text = read_turn(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss:
                    under = unescape(piece[a - at : b - at])
                    state[2] += len(under)
                    state[3].update(under.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
                state[5] |= rewritten
            yield pack(out)
        if state:
            yield pack(done())

    return formatted.mapInArrow(body, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")
