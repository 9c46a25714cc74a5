"""Spelling variants against plain counting and all pairs of words."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st

from quillspark.llm import queries
from quillspark.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
    return out - {word}


def brute(rows):
    """{word: (form, root, n, n_near, form_n)} of [(doc_id, text)]."""
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    count = {w: n for w, n in count.items() if n >= 5 and len(w) >= 6}
    alphabet = sorted({c for w in count for c in w})
    near = {w: [x for x in one_edit(w, alphabet) if x in count] for w in count}
    form = {}
    for w in count:
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 5 * count[w] else None
    out = {}
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None)
    return out


def as_dict(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@given(st.sets(st.text("abé", max_size=7), max_size=40), st.text("abé", min_size=1, max_size=7))
def test_trie_walk(words, word):
    held = sorted(words)
    trie = S.build_trie(held, [i + 1 for i in range(len(held))])
    found = list(S.neighbours(trie, word))
    assert sorted(found) == sorted((w, held.index(w) + 1) for w in one_edit(word, "abé") & words)


def test_long_words():
    words = sorted(["a" * 200_000, "a" * 200_001, "a" * 200_000 + "b", "a" * 199_999 + "cd"])
    trie = S.build_trie(words, [5, 6, 7, 8])
    assert {len(w) for w, _ in S.neighbours(trie, "a" * 200_000)} == {200_001} and len(list(S.neighbours(trie, "a" * 200_000))) == 2


def test_variants_on_odd_rows(spark):
    rng = random.Random(4)
    base = ["straße", "overview", "Überzug", "naïveté", "common", "abcdefg", "élèves"]
    rows = [(i, " ".join(rng.choice(base) for _ in range(40))) for i in range(300)]
    for word in base:  # chains of rarer and rarer variants
        rows += [(1000 + i, f"{word}s {word[:-1]}x. {word}s") for i in range(12)] + [(2000 + i, f"{word}sx") for i in range(6)]
    rows += [(None, None), (1, None), (2, ""), (3, " \n"), (4, "x" * 30_000)] * 2 + [(9, "y" * 5000), (9, "OVERVIEW overvieW ĀoverviewŸ")] * 7
    df = spark.createDataFrame([(k, t, "b", 3) for k, t in rows], "doc_id long, text string, word string, n int").repartition(6)
    want = brute(rows)
    assert as_dict(S.variants(df)) == want and len({v[1] for v in want.values()}) < len(want) - 8
    assert as_dict(S.variants(df, S.Spelling(shard_words=7, wave_bytes=600))) == want  # many shards, many waves
    assert as_dict(S.variants(df.limit(0))) == {}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert as_dict(queries.op12_spelling(spark, sf)) == brute(rows)
