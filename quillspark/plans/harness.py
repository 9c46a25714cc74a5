"""The metric harness: every question through every mode, with the time each search took.

A question names the documents that answer it. Latency is what a caller waits: from the
request to the last row of the answer, measured around the run, not estimated. Each mode
is warmed with one search that is not counted, so no mode pays for what the first one loads.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import retrieval as R
from quillspark.plans.engine import Request, SearchEngine

MODES = ("lexico", "vetorial", "hibrido")


@dataclass(frozen=True)
class Question:
    pergunta: str
    tipo: str
    relevantes: tuple[str, ...]


def measure(spark: SparkSession, search: SearchEngine, questions: list[Question], modes: tuple[str, ...] = MODES, limite: int = 10) -> DataFrame:
    """(modo, pergunta, tipo, recall, precision, latencia): one row for each mode and question; ``limite`` documents at most are judged of each."""
    runs, seen, wanted = [], [], []
    for mode in modes:
        for warm, question in [(True, questions[0]), *[(False, q) for q in questions]] if questions else []:
            request = Request([], [], question.pergunta, modo=mode, limite=limite, perfil="com_clearance", avaliar=False)
            began = time.perf_counter()
            hits = [r.documento_id for r in search.search(request).resultados.select("documento_id").collect()]
            took = time.perf_counter() - began
            if not warm:
                run = f"{mode}\t{question.pergunta}"
                runs.append((run, mode, question.pergunta, question.tipo, took))
                seen += [(run, d) for d in dict.fromkeys(hits)]
                wanted += [(run, d) for d in question.relevantes]
    pairs = "run string, documento_id string"
    scores = R.recall_precision(spark.createDataFrame(seen, pairs), spark.createDataFrame(wanted, pairs), ["run", "documento_id"])
    timed = spark.createDataFrame(runs, "run string, modo string, pergunta string, tipo string, latencia double")
    return timed.join(scores, "run", "left").select("modo", "pergunta", "tipo", "recall", "precision", "latencia")


def report(measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Means by mode, and by mode and kind of question."""
    return R.mode_report(measured, ["modo"]), R.mode_report(measured, ["modo", "tipo"])
