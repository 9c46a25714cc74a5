"""Embedding near-dedup against all pairs in double precision."""

import math

import numpy as np
import pytest

from quillspark.llm import lattice_dedup as L
from quillspark.llm import queries


def brute(rows, threshold=0.9):
    """{row number: (n_links, component)} of [(id, vector)], by all pairs."""
    units = {}
    for i, (key, v) in enumerate(rows):
        if key is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.asarray(v, np.float64)
            units[i] = a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max())
    links, root = {i: 0 for i in range(len(rows))}, {k: k for k, _ in rows if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = list(units)
    for i in at:
        for j in at:
            if i < j and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                root[b] = a
    return {i: (links[i], None if k is None else find(k)) for i, (k, _) in enumerate(rows)}


def around(rng, centre, cosine):
    """A unit vector at ``cosine`` to ``centre``."""
    side = rng.normal(size=len(centre))
    side -= (side @ centre) * centre
    return cosine * centre + math.sqrt(1 - cosine * cosine) * side / np.linalg.norm(side)


def test_e8_decodes_to_the_nearest_point():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) * 2
    found = L.nearest_e8(x)
    assert (np.isclose(found % 1, 0).all(1) | np.isclose(found % 1, 0.5).all(1)).all() and (np.rint(found.sum(1)) % 2 == 0).all()
    mine = ((x - found) ** 2).sum(1)
    for step in L.neighbours():  # the Voronoi cell of E8 is cut out by its 240 shortest vectors
        assert (((x - found - step) ** 2).sum(1) >= mine - 1e-9).all()
    assert (np.isclose((L.neighbours() ** 2).sum(1), 2)).all() and len(np.unique(L.neighbours(), axis=0)) == 240


def test_links_of_all_kinds(spark):
    rng = np.random.default_rng(5)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.normal(size=64))
    rows = [unit() for _ in range(400)]
    for c in (0.905, 0.92, 0.95, 0.97, 0.99, 0.89, 0.85):
        for _ in range(20):
            rows += [a := unit(), around(rng, a, c)]
    hot = unit()
    rows += [around(rng, hot, rng.uniform(0.985, 0.9999)) for _ in range(300)]  # a tight group
    rows += [around(rng, hot, rng.uniform(0.86, 0.97)) for _ in range(60)]  # its border
    second = around(rng, hot, 0.9)
    rows += [around(rng, second, rng.uniform(0.99, 0.9999)) for _ in range(150)]  # another, linked in part
    same = [float(x) for x in unit()]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    data += [(5000 + i, same) for i in range(80)] + [(6000, [2 * x for x in same])]
    data += [(7000, None), (7001, []), (7002, [0.0] * 64), (7003, [float("nan")] + [1.0] * 63), (7004, [None] + [1.0] * 63), (7005, [float("inf")] * 64), (7006, [1e200] + [0.0] * 63), (7007, [1e-200] + [0.0] * 63), (7008, [1.0, 2.0]), (7009, [2.0, 4.0]), (7010, [1.0] + [0.0] * 63), (None, same), (5000, same)]
    df = spark.createDataFrame([(k, v, "x", 1.0) for k, v in data], "vec_id long, embedding array<double>, digest string, cell double")
    got = {}
    for r in L.near_duplicates(df.repartition(5)).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    want = {}
    for i, (n, c) in brute(data).items():
        want.setdefault(data[i][0], []).append((n, c, data[i][0] is None or data[i][0] == c))
    assert got.keys() == want.keys() and all(len(got[k]) == len(want[k]) for k in want)
    found = sum(n for v in got.values() for n, _, _ in v)
    there = sum(n for v in want.values() for n, _, _ in v)
    pairs = [(got[k][0][0], want[k][0][0]) for k in want]
    assert all(g <= w for g, w in pairs), "a link below the threshold"
    assert found >= 0.995 * there
    plain = [k for k, (v,) in ((k, v) for k, v in want.items() if len(v) == 1) if v[0] and k is not None and k < 540]
    assert sum(got[k][0][0] for k in plain) >= 0.95 * sum(want[k][0][0] for k in plain)  # pairs just above the threshold too
    for k in [*range(5001, 5080), 6000, *range(7000, 7011), None, 5000]:
        assert sorted(got[k]) == sorted(want[k]), k


def test_empty_and_query(spark):
    assert L.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op11_lattice_dedup(spark, sf).collect()}
    assert got == {rows[i][0]: v for i, v in want.items()}


def test_thresholds_below_the_bound_of_tight_groups():
    with pytest.raises(ValueError, match="thresholds"):
        L.Lattice(threshold=0.99)
