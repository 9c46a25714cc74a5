"""The inverted file against the exact scan, and the exact scan against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import vector_index as V


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 32))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.6 * rng.normal(size=32)]) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 32) for i in range(40)] + [(3000, None), (3001, []), (3002, [0.0] * 32), (3003, [float("nan")] * 32), (3004, [1.0, 2.0]), (3005, [None] + [1.0] * 31), (None, [1.0] * 32)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)


def queries_of(vectors, every=50):
    return vectors.filter(f"vec_id % {every} = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def as_dict(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append((r["id"], r["score"]))
    return out


def test_exact_top(spark, vectors):
    rows = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in vectors.filter("vec_id < 3000").collect()}
    got = as_dict(V.exact_top(queries_of(vectors), vectors, 10))
    assert len(got) == 31 and 3000 not in got
    for q, hits in got.items():
        want = sorted(((-round(float(v @ rows[q]), 6), k) for k, v in rows.items()))[:10]
        if q != 2000:  # forty equal vectors: ties by id
            assert {h[0] for h in hits} == {k for _, k in want}, q
        assert [h[1] for h in hits] == pytest.approx([-s for s, _ in want], abs=2e-6)
    assert [h[0] for h in got[2000]] == list(range(2000, 2010))


def test_recall_and_full_probe(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 100)
    model = V.train(vectors, lists=24, parts=8)
    index = V.VectorIndex(spark, f"file://{tmp_path}/v", model)
    index.add(vectors.filter("coalesce(vec_id, 0) % 2 = 0"))
    index.add(vectors.filter("vec_id % 2 = 1"))
    stored = spark.read.parquet(f"file://{tmp_path}/v/lists").select(F.explode("ids").alias("id"))
    assert stored.count() == 1540 and stored.distinct().count() == 1540
    asked, truth = queries_of(vectors), as_dict(V.exact_top(queries_of(vectors), vectors, 10))
    whole = as_dict(index.search(asked, vectors, 10, probe=24, shortlist=2000))
    assert whole == truth
    some = as_dict(index.search(asked, vectors, 10, probe=8, shortlist=60))
    assert sum(len({h[0] for h in truth[q]} & {h[0] for h in some[q]}) for q in truth) >= 0.9 * sum(map(len, truth.values()))
    one = [float(x) for x in vectors.filter("vec_id = 50").first().embedding]
    assert {r.vec_id for r in index.nearest(one, vectors, 10, 8, 60).collect()} >= {h[0] for h in some[50][:8]}


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert V.train(none) is None and V.exact_top(queries_of(none), none, 3).collect() == []
    blank = spark.createDataFrame([(1, None), (2, [])], none.schema)
    assert V.train(blank) is None
