"""Text vectors: a hook for any model, and a default that needs none.

The default hashes words into a few hundred signed cells and scales the sum to
length one, so the cosine of two texts is that of their word counts, nearly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship_code

DIMENSIONS = 256
BATCH = 16
WORD = re.compile(r"[^\W_]+")
Embedder = Callable[[list[str]], np.ndarray]


def hashed(texts: list[str]) -> np.ndarray:
    """One vector a text; a text without words has zeros."""
    out = np.zeros((len(texts), DIMENSIONS))
    for row, text in zip(out, texts, strict=True):
        for word in WORD.findall(text.lower()):
            h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
            row[h % DIMENSIONS] += 1 if h >> 31 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedding(text: Column, embed: Embedder = hashed, batch: int = BATCH) -> Column:
    """A vector column; ``embed`` is shipped once per worker and sees ``batch`` texts at a time."""

    def body(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            vectors = [embed(texts[at : at + batch]) for at in range(0, len(texts), batch)]
            yield pd.Series([v for some in vectors for v in np.asarray(some, np.float32).tolist()], dtype=object)

    return F.pandas_udf(body, "array<float>")(text)


def with_embedding(rows: DataFrame, text: str, name: str = "embedding", embed: Embedder = hashed) -> DataFrame:
    """``rows`` with a vector of each text; null texts count as empty."""
    ship_code(rows.sparkSession)
    return rows.withColumn(name, embedding(F.col(text), embed))
