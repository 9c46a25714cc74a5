"""The stored text index against the scan and against plain counting."""

import math
import random
import re
from collections import Counter

import pytest

from quillspark.functions import portuguese
from quillspark.functions import text as T
from quillspark.operators import retrieval as R
from quillspark.operators import text_index as I

WORDS = "alfa beta gama delta epsilon decreto decretos portaria de da rio rios".split()


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [(i, " ".join(rng.choices(WORDS, weights, k=rng.randrange(0, 60)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "raro raro Ação-raro"), (7, "raro"), (None, "raro alfa"), (n + 3, "alfa beta " * 3000)]


def as_set(df):
    return sorted((r[0] is not None, r[0], r[1]) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, 1.0) for k, t in corpus()], "doc_id long, text string, score double").repartition(6)


def index_of(spark, docs, folder, monkeypatch, window, **more):
    monkeypatch.setattr(I, "WINDOW", window)
    made = I.TextIndex(spark, f"file://{folder}", **more)
    made.append(docs)
    return made


@pytest.mark.parametrize("window", [7, 1024])
def test_scores_equal_the_scan(spark, docs, tmp_path, monkeypatch, window):
    monkeypatch.setattr(I, "PROBE", 3)
    index = index_of(spark, docs, tmp_path / "i", monkeypatch, window, buckets=4)
    for terms in (["alfa"], ["raro", "beta"], ["rios", "epsilon", "nenhum"], ["nenhum"]):
        want = as_set(R.bm25(docs, terms))
        assert as_set(index.scores(terms)) == want
        assert as_set(R.top_k(index.scores(terms, k=5), 5, "doc_id")) == as_set(R.top_k(R.bm25(docs, terms), 5, "doc_id"))
    assert as_set(index.scores(["alfa", "rio"], all_terms=True)) == as_set(R.bm25(docs, ["alfa", "rio"], all_terms=True))
    assert index.n_docs == len(corpus()) and index.scores([]).collect() == []
    again = I.TextIndex(spark, f"file://{tmp_path}/i", buckets=4)
    assert as_set(again.scores(["rio"])) == as_set(R.bm25(docs, ["rio"]))


def test_early_stop_opens_few_windows(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "PROBE", 2)
    index = index_of(spark, docs, tmp_path / "i", monkeypatch, 5, buckets=4)
    found, full = index.scores(["gama", "delta"], k=3), index.scores(["gama", "delta"])
    assert found.count() < full.count() / 2
    assert as_set(R.top_k(found, 3, "doc_id")) == as_set(R.top_k(full, 3, "doc_id"))
    files = index.blocks(["gama"]).inputFiles()
    assert files and all(f"bucket={index.bucket_of('gama')}/" in f for f in files)


def test_queries(spark, docs, tmp_path, monkeypatch):
    index = index_of(spark, docs, tmp_path / "i", monkeypatch, 50, buckets=4)
    rows = docs.select("doc_id", T.tokens(docs.text).alias("w"), docs.text.alias("l"))
    for query in ("alfa rio", '"alfa beta"', '"beta gama" -delta', "raro or epsilon -alfa", '"alfa beta gama" or "raro raro"', "-alfa", '-"alfa beta"', "alfa-beta"):
        want = sorted((r[0] is not None, r[0]) for r in rows.filter(T.parse_query(query)(rows.w, rows.l)).select("doc_id").collect())
        assert [x[:2] for x in as_set(index.scores([], query=query))] == want, query


def test_segments(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "WINDOW", 20)
    index = I.TextIndex(spark, f"file://{tmp_path}/i", buckets=4, files=2)
    assert index.scores(["alfa"]).collect() == [] and index.vocabulary().collect() == []
    for part in range(3):
        index.append(docs.filter(f"coalesce(doc_id, 0) % 3 = {part}"))
    want, words = as_set(R.bm25(docs, ["alfa", "raro"])), as_set(index.vocabulary())
    assert len(index.live) == 3 and as_set(index.scores(["alfa", "raro"])) == want
    index.merge()
    assert len(index.live) == 1 and as_set(index.scores(["alfa", "raro"])) == want and as_set(index.vocabulary()) == words
    phrase = '"alfa beta"'
    rows = docs.select("doc_id", T.tokens(docs.text).alias("w"), docs.text.alias("l"))
    assert index.scores([], query=phrase).count() == rows.filter(T.parse_query(phrase)(rows.w, rows.l)).count()
    assert index.blocks(["alfa"]).count() < 40
    # a segment without its commit row is not seen
    with pytest.raises(Exception, match="."):
        index.append(docs.selectExpr("doc_id", "IF(doc_id = 300, raise_error('lost'), text) AS text"))
    assert as_set(I.TextIndex(spark, f"file://{tmp_path}/i", buckets=4, files=2).scores(["alfa", "raro"])) == want


def test_merge_of_windows_with_few_terms(spark, tmp_path, monkeypatch):
    """Windows that are not full are joined, full ones kept; most of them have no term in most of the buckets."""
    monkeypatch.setattr(I, "WINDOW", 4)
    texts = ["um dois dois", "tres", "quatro um", "", "cinco seis sete um", "oito", "dois um um dois", "nove um", "dez dois um", "onze"]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    index = I.TextIndex(spark, f"file://{tmp_path}/i", buckets=16)
    for a, b in ((0, 1), (1, 2), (2, 6), (6, 8), (8, 10)):
        index.append(docs.filter(f"doc_id BETWEEN {100 + a} AND {99 + b}").coalesce(1))
    words = as_set(index.vocabulary())
    index.merge()
    assert len(index.live) == 1 and index.n_docs == len(texts) and as_set(index.vocabulary()) == words
    for terms in (["um"], ["dois", "onze"], ["tres"], ["nove", "um"]):
        assert as_set(index.scores(terms)) == as_set(R.bm25(docs, terms))
    for phrase in ("um dois", "dois um", "um um", "seis sete um"):
        want = [100 + i for i, t in enumerate(texts) if f" {phrase} " in f" {t} "]
        assert sorted(r.doc_id for r in index.scores([], query=f'"{phrase}"').collect()) == want
    assert sorted(r.doc_id for r in index.scores([], query="-um").collect()) == [101, 103, 105, 109]
    windows = index.blocks([""]).select("n", "docs", "dls").collect()
    assert max(r.n for r in windows) < 2 * I.WINDOW and all(sorted(r.docs) == list(range(r.n)) for r in windows) and sum(r.n for r in windows) == len(texts)
    index.append(docs.limit(1))
    index.merge()
    assert len(index.live) == 1 and index.n_docs == len(texts) + 1


def test_stored_rows_follow_windows_not_terms(spark, tmp_path):
    """What an append or a merge sorts, moves and writes is a row for each bucket of a window, however many terms there are."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 37 + j * 13) % 997}" for j in range(200))) for i in range(60)], "doc_id long, text string").coalesce(2)
    index = I.TextIndex(spark, f"file://{tmp_path}/i", buckets=2)
    for part in range(3):
        index.append(docs.filter(f"doc_id % 3 = {part}"))
    index.merge()
    (live,) = index.live
    assert spark.read.parquet(f"file://{tmp_path}/i/segments/{live.segment}").count() <= 3 * (live.windows + 1)
    assert as_set(index.scores(["w13", "w26"])) == as_set(R.bm25(docs, ["w13", "w26"]))


def test_stems_and_stop_words(spark, docs, tmp_path, monkeypatch):
    index = index_of(spark, docs, tmp_path / "i", monkeypatch, 64, buckets=4, analyser=portuguese.analyse)
    stems = [(k, [s for s in portuguese.analyse(re.findall(r"\w+", (t or "").lower())) if s]) for k, t in corpus()]
    mean, n = sum(len(w) for _, w in stems) / len(stems), len(stems)
    df = Counter(s for _, w in stems for s in set(w))
    want = []
    for k, w in stems:
        tf = w.count("decret")
        if tf:
            want.append((k is not None, k, math.log(1 + (n - df["decret"] + 0.5) / (df["decret"] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))))
    for word in ("decreto", "decretos", "decretado"):
        got = as_set(index.scores([word]))
        assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
        assert all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, sorted(want), strict=True))
    assert index.scores(["de"]).collect() == [] and as_set(index.scores([], query="decretado de")) == as_set(index.scores(["decreto"]))
