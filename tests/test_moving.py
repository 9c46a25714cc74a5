"""As-of join, running boilerplate counts and the SQL table function against plain code and the batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import documents as D
from quillspark.operators.asof import asof
from quillspark.plans.functions_sql import register_match_chunks
from quillspark.streaming import boilerplate as B


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_asof(spark, width):
    rng = random.Random(width)
    right = [(k, rng.randrange(100), rng.randrange(50)) for k in "abc" for _ in range(12)] + [("hot", i * 3, i) for i in range(200)] + [(None, 3, 1), ("a", None, 9)]
    left = [(i, rng.choice(["a", "b", "c", "hot", "none", None]), rng.choice([None, *range(110)])) for i in range(300)]
    a = spark.createDataFrame(left, "id long, k string, p long").withColumn("__extra", F.lit(1)).repartition(4)
    b = spark.createDataFrame(right, "k string, at long, page int").repartition(3)

    def want(k, p, first):
        marks = sorted((x, v) for q, x, v in right if q == k and k is not None and x is not None)
        if p is None or not marks:
            return None
        before = [m for m in marks if m[0] <= p]
        return before[-1][1] if before else max(v for x, v in marks if x == marks[0][0]) if first else None

    for first in (True, False):
        got = asof(a, b, "k", "p", "at", "page", width, first).collect()
        assert sorted((r.id, r.k, r.p, r.page) for r in got if r.id is not None).__len__() == 300
        assert {r.id: r.page for r in got} == {i: want(k, p, first) for i, k, p in left}
    assert asof(a.limit(0), b, "k", "p", "at", "page", width).collect() == []
    assert {r.page for r in asof(a, b.limit(0), "k", "p", "at", "page", width).collect()} == {None}


def test_running_counts_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    texts = ["o mesmo texto padrao em todo lugar " + str(i) for i in range(6)]
    rows = []
    for i in range(150):
        t = min(int(rng.expovariate(0.7)), 5)
        rows.append((f"c{i}", f"d{rng.randrange(9) if t < 3 else rng.randrange(4)}", texts[t].upper() if rng.random() < 0.3 else texts[t] + " "))
    rows += [("f1", "d1", "[CAMPO] [CAMPO] [CAMPO] [CAMPO] nome"), ("n1", None, texts[0]), ("n2", "d1", None)]
    rng.shuffle(rows)
    schema = "chunk_id string, documento_id string, texto string"
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    with pytest.raises(ValueError, match="stateStore"):
        B.running_boilerplate(spark.createDataFrame(rows, schema))
    spark.conf.set(B.PROVIDER, B.ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        running = B.running_boilerplate(stream)
        for _ in range(2):  # the second start finds nothing new
            running.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(B.PROVIDER)
    arrivals = spark.read.parquet(f"{tmp_path}/out")
    chunks = spark.createDataFrame(rows, schema)
    got = {r.chunk_id: r.eh_padronizado for r in B.settled(arrivals, chunks).collect()}
    batch = {r.chunk_id: bool(r.eh_padronizado) for r in D.mark_boilerplate(chunks.filter("documento_id IS NOT NULL AND texto IS NOT NULL"), "documento_id", "texto").collect()}
    assert {k: v for k, v in got.items() if k in batch} == batch and True in batch.values() and False in batch.values()
    assert got["f1"] and not got["n1"] and not got["n2"]
    assert arrivals.count() > 151 - 4  # chunks that turned came again


def test_match_chunks_from_sql(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"d{i % 3}", f"t{i}", i % 4 == 0, [float(i), 1.0] if i != 5 else None) for i in range(12)], "chunk_id string, documento_id string, texto string, eh_padronizado boolean, embedding array<float>")
    docs = spark.createDataFrame([("d0", "Niteroi", "Decreto"), ("d1", "Niteroi", "Portaria"), ("d2", "Rio", None)], "documento_id string, municipio string, tipo_documento string")
    register_match_chunks(spark, chunks, docs)
    ask = lambda *more: [r.chunk_id for r in spark.sql(f"SELECT * FROM match_chunks(array(1.0D, 0.0D), {', '.join(more)}) ORDER BY similaridade DESC, chunk_id").collect()]
    assert ask("3", "NULL", "NULL") == ["c11", "c10", "c9"]
    assert ask("4", "'Niteroi'", "NULL") == ["c10", "c9", "c7", "c6"]
    assert ask("9", "'Niteroi'", "'Portaria'") == ["c10", "c7", "c1"]
    assert ask("2", "'Rio'", "NULL", "true") == ["c11", "c8"]
