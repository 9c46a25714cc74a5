"""A bit map of bounded size over keys, to keep most rows from crossing the network.

A key that was not put in is seldom marked, one that was always is; a map of
very many keys fills up and then drops less. Marked rows still meet the keys themselves
in a join, so results never depend on the map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import ship_code

#: A map has about BITS_PER_KEY bits a key, but never more than 2**BITS.
BITS, BITS_PER_KEY = 27, 16


def hash_of(value: Column) -> Column:
    return F.xxhash64(value)


def bits_of(words: np.ndarray) -> int:
    return 64 * len(words)


def id_map(ids: DataFrame, column: str = "id") -> np.ndarray:
    """Words of 64 bits; at most 2**(BITS - 6) of them come to the driver (16 MB)."""
    bits = min(1 << BITS, 1 << max(6, (BITS_PER_KEY * ids.count()).bit_length()))
    cells = ids.select(F.pmod(hash_of(F.col(column)), F.lit(bits)).alias("cell"))
    bit = F.expr("shiftleft(1L, cast(cell % 64 AS int))")
    words = cells.groupBy(F.floor(F.col("cell") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def marked(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cells = hashes & (bits_of(words) - 1)
    return (words[cells >> 6] >> (cells & 63).astype(np.uint64)) & np.uint64(1) != 0


def where_marked(rows: DataFrame, key: Column, words: object, wanted: bool = True) -> DataFrame:
    """The rows whose key the broadcast map marks, or those whose key it does not mark."""
    place = len(rows.columns)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(list(range(place))).filter(pa.array(marked(words.value, batch.column(place).to_numpy()) == wanted))

    ship_code(rows.sparkSession)
    return rows.select("*", hash_of(key).alias("__hash")).mapInArrow(body, rows.schema)


def without(rows: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows whose ``key`` is not in the column ``gone``; only rows that the map of ``gone`` marks travel."""
    words = rows.sparkSession.sparkContext.broadcast(id_map(gone, gone.columns[0]))
    doubtful = where_marked(rows, key, words).withColumn("__key", key)
    left = doubtful.join(gone.select(F.col(gone.columns[0]).alias("__key")), "__key", "left_anti").select(*(F.col(f"`{c}`") for c in rows.columns))
    return where_marked(rows, key, words, False).unionByName(left)
