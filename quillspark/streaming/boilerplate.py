"""Running boilerplate counts: a chunk's flag turns the moment its text stands in enough documents.

State lives per normalised hash: whether it is common, the documents seen so far (never more than the
threshold), and the chunks that were let through unflagged. When the threshold is reached those are emitted
again with their new flag and their state is dropped, so what a hash holds is bounded by the chunks of fewer
documents than the threshold. The latest flag of each chunk (``settled``) equals the batch operator's over the same
chunks, in whatever order they arrive.

Defined results: a chunk without a document or text is passed on by its form alone and counts for no hash;
a chunk that arrives twice is emitted twice and counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions import rules
from quillspark.functions.text import chunk_hash, form_like
from quillspark.session import ship_code

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "hash_normalizado string, chunk_id string, comum boolean"


class Counts(StatefulProcessor):
    """One hash: documents until there are ``least``, chunks that wait, and a timer that forgets a hash silent for ``keep_ms``."""

    def __init__(self, least: int, keep_ms: int | None) -> None:
        self.least, self.keep_ms = least, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.common = handle.getValueState("common", "comum boolean")
        self.documents = handle.getMapState("documents", "documento_id string", "n int")
        self.waiting = handle.getListState("waiting", "chunk_id string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat(list(rows))
        chunks, flag = came["chunk_id"].tolist(), self.common.exists()
        if not flag:
            for document in came["documento_id"].unique():
                self.documents.updateValue((document,), (1,))
            flag = sum(1 for _ in self.documents.keys()) >= self.least
            if flag:
                chunks = list(dict.fromkeys([r[0] for r in self.waiting.get()] + chunks))
                self.common.update((True,))
                self.documents.clear()
                self.waiting.clear()
            else:
                self.waiting.appendList([(c,) for c in chunks])
        if self.keep_ms is not None:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + self.keep_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield pd.DataFrame({"hash_normalizado": key[0], "chunk_id": chunks, "comum": flag})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.common, self.documents, self.waiting, self.timer):
            state.clear()
        yield pd.DataFrame({"hash_normalizado": pd.Series([], dtype=str), "chunk_id": pd.Series([], dtype=str), "comum": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass


def running_boilerplate(stream: DataFrame, least: int = rules.BOILERPLATE_DOCS, keep_ms: int | None = None) -> DataFrame:
    """(hash_normalizado, chunk_id, comum) of a stream (chunk_id, documento_id, texto): one row per arrival, and again for those that turn.

    ``keep_ms`` forgets a hash after so long without arrivals, which bounds the state and lets its count begin anew.
    """
    spark = stream.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKS:
        raise ValueError(f"set {PROVIDER} to {ROCKS}")
    ship_code(spark)
    hashed = stream.filter("documento_id IS NOT NULL AND texto IS NOT NULL").select(chunk_hash(F.col("texto")).alias("hash_normalizado"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("documento_id").cast("string").alias("documento_id"))
    return hashed.groupBy("hash_normalizado").transformWithStateInPandas(Counts(least, keep_ms), OUT, "Append", "None" if keep_ms is None else "ProcessingTime")


def settled(arrivals: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, eh_padronizado): the flag that ``chunks`` have after all ``arrivals``: common, or a blank form."""
    last = arrivals.groupBy("chunk_id").agg(F.bool_or("comum").alias("comum"))
    forms = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce(form_like(F.col("texto")), F.lit(False)).alias("formulario")).distinct()
    return forms.join(last, "chunk_id", "left").select("chunk_id", (F.coalesce("comum", F.lit(False)) | F.col("formulario")).alias("eh_padronizado"))
