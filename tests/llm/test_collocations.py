"""Collocation mining against plain counting, with many shards and ranges."""

import random
import re
from collections import Counter

from quillspark.llm import collocations as C
from quillspark.llm import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=2000):
    """[(lang, rank, phrase, a, l, r, n, score)] of [(lang, text)]."""
    out = []
    for lang in sorted({x or "und" for x, _ in rows}):
        f, n = Counter(), 0
        for text in (t or "" for x, t in rows if (x or "und") == lang):
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                f.update(tuple(words[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(words) - k + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {}
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(a, covered.get(p[i : i + k], 0))
        best = []
        for p, a in found.items():
            if 100 * covered.get(p, 0) >= 80 * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -score) for i, (score, a, p, left, right) in enumerate(sorted(best)[:top])]
    return out


def as_rows(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def odd_rows():
    rng = random.Random(6)
    words = ["the", "of", "New", "york", "a b", "ÉTÉ", "é", "x-y", "city\tHall", "<b>", " ", "𝄞"]
    rows = [(rng.choice(["en", "fr", None]), " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",\n", "  "]) for _ in range(rng.randrange(60)))) for _ in range(150)]
    rows += [("en", None), (None, None), ("de", ""), ("de", " \n\t.,"), ("en", "new york city hall " * 800), ("x y", "a b c d " * 9)] + [("fr", "the of the of")] * 20
    return rows


def test_shards_and_ranges(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, x, "k") for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string").repartition(5)
    want = sorted(brute(rows, 5))
    assert len(want) > 50
    assert as_rows(C.collocations(df, C.Mining(min_count=5))) == want
    assert as_rows(C.collocations(df, C.Mining(min_count=5, shard_words=40, range_bytes=1000))) == want
    assert as_rows(C.collocations(df, C.Mining(min_count=5, shard_words=3000, range_bytes=300, top=10))) == sorted(brute(rows, 5, 10))
    assert as_rows(C.collocations(df.limit(0))) == []


def test_slices(monkeypatch):
    monkeypatch.setattr(C, "SLICE", 7)
    text = b"Ab cd.ef  averyverylongword gh\tij,,kl \n mn"
    assert [w for piece in C.tokens(text) for w in piece if w] == [b"ab", b"cd", b"\n", b"ef", b"averyverylongword", b"gh", b"ij", b"\n", b"\n", b"kl", b"\n", b"mn"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert as_rows(queries.op13_collocations(spark, sf)) == sorted(brute(rows, 30))
