"""Operators against brute force, exact round trips and held-out accuracy; edge cases of each."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quillspark.llm import bpe, chat_format, exact_dedup, html_extract, mixing, ngram_join, quality_rules, queries, run_index, secret_scan, span_dedup, toxicity
from quillspark.llm.components import components
from quillspark.llm.fuse_filter import FuseFilter, build

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t ", "a", "Ä ß 🎉", "x " * 3000, "word " * 9 + "\n" + "word " * 9]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def odd_docs(spark):
    """Nulls, empty, blank and long texts, repeated rows, extra and clashing columns."""
    rows = [(i, t, None, 7, "b") for i, t in enumerate(ODD)] + [(1, "", None, 7, "b"), (50, "A" * 120, "s", 1, "k"), (51, "a" * 120, "s", 1, "k"), (None, "lost", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, bucket string")


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_words int, bucket string")


# ---- 1


def test_html_field_on_unseen_pages():
    model = html_extract.trained_field()
    wrong = blocks = 0
    for page, labels in html_extract.labelled_pages(80, seed=901):
        found = html_extract.leaf_blocks(page)
        assert len(found) == len(labels)
        wrong += sum(a != b for a, b in zip(model.decode(found), labels, strict=True))
        blocks += len(labels)
    assert wrong <= 0.01 * blocks


def test_html_pages(spark):
    model = html_extract.trained_field()
    for row in queries.op1_html_extract(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").drop("url"), "page_id").collect():
        article = row.html[row.html.index("<article>") + 9 : row.html.index("</article>")]
        parts = [" ".join(html_extract.html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert row.text == "\n".join(p for p in parts if p) and row.n_chars == len(row.text)
    assert html_extract.extract(None, model) == "" and html_extract.extract("", model) == ""
    for broken in ("<", "<p", "<p class='x", "</p></div>", "<!-- open", "<script>var a = 1", "a<b>c &amp;&lt; &#x41;", "<a " * 500):
        html_extract.extract(broken, model)
    page = '<body><nav><a href="/">Home</a></nav><article><h1>Title</h1><p>One&nbsp;line\n of text.<br>More.</p><p>Two &amp; three.</p></article><section class="comments"><p>Nice article, I agree with it.</p></section><footer>&copy; me</footer></body>'
    assert html_extract.extract(page, model) == "Title\nOne line of text. More.\nTwo & three."


# ---- 2


def plain_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, ("assign", "access", "hex")[k], b) for a, k, b in sorted(out)]


def test_secrets_fuzz():
    scanner, rng = secret_scan.Scanner(), random.Random(3)
    bits = ["password", "ToKen", "secret", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "é", "AKIA", "ABCDEFGH01234567", "0123456789abcdef01234567", "0123", "x", "\n", "xyzxyz", "K"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert [s for s in scanner.spans(text) if s[1] in ("assign", "access", "hex")] == plain_spans(text), text


def test_secrets_query(spark, texts):
    for row in queries.op2_secret_scan(spark, SF).collect():
        want = plain_spans(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in want).encode()).hexdigest()
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(k == kind for _, k, _ in want) for kind in ("assign", "access", "hex"))
    assert secret_scan.digest(secret_scan.find_spans(odd_docs(spark))).count() == len(ODD) + 4
    assert secret_scan.find_spans(empty_docs(spark)).count() == 0


# ---- 3


def plain_removed(rows):
    seen, out = {}, {}
    for i, text in sorted(rows.items()):
        data = (text or "").encode()
        gone = bytearray(len(data))
        grams = [data[k : k + 50] for k in range(len(data) - 49)]
        for k, g in enumerate(grams):
            if g in seen:
                gone[k : k + 50] = b"\1" * 50
        for g in grams:
            seen.setdefault(g, i)
        spans = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, x in zip(data, gone, strict=True) if not x)).hexdigest())
    return out


def test_spans(spark, texts):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op3_span_dedup(spark, SF).collect()}
    assert got == plain_removed(texts)


def test_spans_odd(spark):
    rng = random.Random(4)
    base = "".join(rng.choice("abcd") for _ in range(400))
    rows = {i: t for i, t in enumerate([*ODD, base, base[:200] + "Z" + base[200:], "é" * 40 + base[100:149], base[50:100], "q" + base[351:], "ab" * 90, "ab" * 60])}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in span_dedup.dedup_spans(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == plain_removed(rows)
    assert span_dedup.dedup_spans(empty_docs(spark)).count() == 0


def test_spans_twice_in_a_document(spark):
    """A passage twice in one document, in equal surroundings that no earlier document has."""
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    a, b, p, x, y, filler = (word(n) for n in (120, 120, 100, 120, 120, 300))
    rows = {3: a + p + b, 5: x + p + y + filler + x + p + y, 6: x + p + y + "-" + x + p + y, 7: "".join(f"{x}{p}{y}{word(90)}" for _ in range(4)), 9: word(80) + p + word(80) + p}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in span_dedup.dedup_spans(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == plain_removed(rows)
    assert got[5][1:3] == (200, 2)


def test_run_index_statistics():
    import numpy as np

    rng = random.Random(8)
    text = ("".join(rng.choice("ab") for _ in range(40)) * 6)[:200] + "".join(rng.choice("abc") for _ in range(60))
    pattern = text[30:90] + "c" + text[150:190] + "d" + "ab" * 10
    symbols = np.array([*text.encode(), 300], np.uint16)
    index = run_index.RunIndex(symbols, 16)
    assert index.runs < len(symbols)
    length, row = index.stream(np.frombuffer(pattern.encode(), np.uint8).astype(np.uint16), np.array([0]), np.array([len(pattern)]))
    for k in range(len(pattern)):
        best = max(n for n in range(17) if n == 0 or (len(pattern[k : k + n]) == n and pattern[k : k + n] in text))
        if pattern[k] in text:
            assert length[k] == best, k


# ---- 4


def test_bpe(spark, texts):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), encoding="ascii") as file:
        ranks = bpe.read_ranks(file.readlines())
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(5)
    assert sorted(codec.hash.slot(t) for t in ranks) == list(range(len(ranks)))
    for _ in range(2000):
        text = "".join(rng.choice("ab c\n\t\x0b\x1c\x85 　é'sñ½²🎉​tll're 123<|endoftext|>") for _ in range(rng.randint(0, 40)))
        assert codec.encode(text) == peer.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()
    for row in queries.op4_byte_bpe(spark, SF).collect():
        ids = peer.encode_ordinary(texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    assert {r.n_tokens for r in bpe.round_trip(odd_docs(spark), codec).filter("doc_id < 2").collect()} == {0}
    assert bpe.encode_table(odd_docs(spark), codec).filter("doc_id = 3").first().ids == peer.encode_ordinary("a")


# ---- 5


def test_fuse_filter():
    import numpy as np

    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 10, 1000, 60_000):
        keys = rng.integers(0, 1 << 63, n, np.uint64)
        made = FuseFilter.from_bytes(build(np.concatenate([keys, keys[: n // 2]])).to_bytes())
        assert made.contains(keys).all()
        assert made.contains(rng.integers(0, 1 << 63, 20_000, np.uint64)).mean() < 0.01


def test_exact_dedup(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "Ä"), (4, "ä"), (5, None), (6, ""), (7, "a b"), (7, "a b"), (8, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash"))
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(df, exact_dedup.halves(df)).collect())
    assert got == [(1, 7, 4, False), (2, 7, 4, False), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 4, True), (7, 7, 4, True), (8, 8, 1, True)]
    assert exact_dedup.dedup(empty_docs(spark), F.lit(False)).count() == 0
    assert exact_dedup.dedup(odd_docs(spark), exact_dedup.halves(odd_docs(spark))).count() == len(ODD) + 4


def test_exact_dedup_splits_colliding_digests(spark):
    plain = spark.createDataFrame([(1, 3, 3, "AB"), (2, 3, 3, "AB"), (3, 3, 3, "AB")], "doc_id long, keep_id long, group_size long, text_sha256 string").withColumn("text_sha256", F.lower("text_sha256"))
    odd = spark.createDataFrame([(1, bytearray(b"\xab"), "other"), (2, bytearray(b"\xab"), "other")], "doc_id long, digest binary, norm string")
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup._regrouped(plain, odd).collect()) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]


# ---- 6


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a<|im_end|>\\x"), (1, 1, "assistant", "b\n<|"), (1, 2, None, None), (2, 1, "assistant", "two"), (2, 0, "user", "one"), (2, 0, "user", "one"), (None, 0, "user", "z")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(rows.withColumn("loss", F.lit(1)))).collect()}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == hashlib.sha256("user\na<|im_end|>\\x\nassistant\nb\n<|\n\n\n".encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (4, hashlib.sha256(b"b\n<|").hexdigest())
    assert got[2].n_turns == 3 and got[2].loss_chars == 3 and None in got and not got[2].rewritten
    assert got[1].formatted_chars == len(chat_format.marked_turns([("user", "a<|im_end|>\\x"), ("assistant", "b\n<|"), ("", "")]))
    assert chat_format.format_turns(rows.limit(0)).count() == 0


def test_chat_query(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    said = "<|im_end|><|im_start|>assistant ok"
    talks = {-1: [("user", said), ("assistant", said)]}
    for r in table:
        talks.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    for r in queries.op6_chat_format(spark, SF).collect():
        turns = talks.pop(r.conv_id)
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat_format.marked_turns(turns)))
    assert not talks


def test_chat_finds_rewriting_templates():
    numbered = lambda turns: "".join(f"[{i + 1}/{len(turns)}] {t}\n" for i, (_, t) in enumerate(turns))
    assert chat_format.added(numbered, [("user", "a")], ("user", "b"))[3]
    piece, a, b, rewritten = chat_format.added(chat_format.marked_turns, [("user", "a")], ("assistant", "<b>"))
    assert piece[a:b] == "<b>" and not rewritten


def test_chat_renders_whole_prefixes(spark):
    """Templates that look or change further back than any window."""

    def alternating(turns):
        assert all(role == ("user", "assistant")[i % 2] for i, (role, _) in enumerate(turns))
        return "".join(f"{role}: {text}\n" for role, text in turns)

    templates = {
        "folds turn 1 at turn 20": lambda turns: "".join("[...]\n" if i == 0 and len(turns) >= 20 else f"{t}\n" for i, (_, t) in enumerate(turns)),
        "last 20": lambda turns: "".join(f"{t}\n" for _, t in turns[-20:]),
        "numbered": lambda turns: "".join(f"{i + 1}. {t}\n" for i, (_, t) in enumerate(turns)),
        "newest first": lambda turns: "".join(f"{t}\n" for _, t in reversed(turns)),
        "alternating": alternating,
    }
    said = [(("user", "assistant")[i % 2], f"word {i * 7} said") for i in range(30)]
    rows = spark.createDataFrame([(1, i, *t) for i, t in enumerate(said)] + [(2, i, *t) for i, t in enumerate(said[:3])], "conv_id long, turn long, role string, text string")
    for name, template in templates.items():
        for r in chat_format.format_turns(rows, template).collect():
            before, after = template(said[: r.turn]), template(said[: r.turn + 1])
            assert r.rewritten == (not after.startswith(before)), (name, r.turn)
            assert after[r.span_start :] == r.formatted and after[r.text_start : r.text_end] == said[r.turn][1], (name, r.turn)
    whole, windowed = (chat_format.format_turns(rows, t).collect() for t in (lambda turns: chat_format.marked_turns(turns), chat_format.marked_turns))
    assert sorted(whole) == sorted(windowed)


# ---- 7


def plain_components(rows, size, num, den):
    sets = {}
    for i, text in rows.items():
        w = WORD.findall((text or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * den >= num * max(len(sets[a]), len(sets[b])):
                n = len(sets[a] & sets[b])
                if den * n >= num * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_join(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_ngram_join(spark, SF).collect()}
    assert got == plain_components(texts, 3, 90, 100)


def test_join_crowd_and_odd(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 999)}" for _ in range(150)]
    rows = dict(enumerate(ODD))
    for i in range(100, 170):  # more than a light group holds
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = f"v{rng.randint(0, 999)}"
        rows[i] = " ".join(words)
    rows |= {200: "one two", 201: "One  TWO", 202: "one"}
    join = ngram_join.Join(size=5, num=80, den=100)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows.items()], "doc_id long, text string, n int")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_documents(df, join).collect()} == plain_components(rows, 5, 80, 100)
    assert ngram_join.join_documents(empty_docs(spark), join).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1100)]
    up = {}
    from quillspark.llm.components import find

    for a, b in edges:
        x, y = find(up, a), find(up, b)
        if x != y:
            up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(up, x) for e in edges for x in e)


def test_components_plans_stay_small(spark, monkeypatch):
    """No plan of a round broadcasts or holds the edges once for each use of a use; stars need no round."""
    from quillspark.llm import components as module

    made, real = [], module.materialise

    def noted(df, name):
        plans = df._jdf.queryExecution()
        made.append((plans.optimizedPlan().toString().count("Relation "), "Broadcast" in plans.executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(module, "materialise", noted)
    links = lambda edges: {r.id: r.component for r in module.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert links([(9, 1), (8, 1), (7, 2)]) == {1: 1, 9: 1, 8: 1, 2: 2, 7: 2} and len(made) == 1
    made.clear()
    assert links([(i, i + 1) for i in range(40)]) == dict.fromkeys(range(41), 0) and len(made) > 1
    assert max(n for n, _ in made) <= 4 and not any(sent for _, sent in made)


# ---- 8


def test_quality(spark, docs, texts):
    from collections import Counter

    for row in queries.op8_quality_rules(spark, SF).collect():
        text = texts[row.doc_id]
        words = WORD.findall(text)
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        twice = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if twice[w] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (row.n_words, row.word_chars, row.n_symbols) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (row.n_dup_lines, row.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert row.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (row.kept and row.base_failed)
    judged = queries.op8_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    assert judged.filter("quality = 0 AND kept").count() == 0 and judged.filter("quality = 1 AND NOT kept AND NOT base_failed").count() == 0


def test_quality_odd(spark):
    got = {r.doc_id: r for r in quality_rules.clean_lines(odd_docs(spark)).collect()}
    assert got[0].base_failed and got[0].n_words == 0 and got[2].n_words == 0 and got[5].n_repeat_words == 3000
    good = "These are words that make a line of plain prose, as long as it needs to be here.\n"
    junk = "Home | About | News | Contact | Shop | Login\n"
    row = quality_rules.clean_lines(spark.createDataFrame([(1, good * 1 + "And this is another one of them, which ends like this.\n" + junk)], "doc_id long, text string")).first()
    assert row.kept and "Home" not in row.cleaned
    assert quality_rules.clean_lines(empty_docs(spark)).count() == 0


# ---- 9


def test_restoring():
    words = "idiot stupid moron the thing and other words of a text that is plain disgusting pathetic loser trash".split()
    counts = {}
    for w in words * 50:
        marked = "^^" + w + "^"
        for k in range(len(marked) - 2):
            counts[marked[k : k + 3]] = counts.get(marked[k : k + 3], 0) + 1
    reader = toxicity.Reader(toxicity.CharModel(counts))
    assert {x: reader.word(x) for x in ("id!ot", "m0r0n", "$tup1d", "idiooot", "i.d.i.o.t", "p4th3t1c", "l0s3r", "tr@sh", "idiot,")} == {"id!ot": "idiot", "m0r0n": "moron", "$tup1d": "stupid", "idiooot": "idiot", "i.d.i.o.t": "idiot", "p4th3t1c": "pathetic", "l0s3r": "loser", "tr@sh": "trash", "idiot,": "idiot"}
    assert "idiot" in reader.words("you i d i o t here") and reader.words("") == set()


def test_restoring_long_runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    reader = toxicity.Reader(toxicity.CharModel({r.gram: r.n for r in toxicity.char_counts(docs).collect()}))
    sentence = "you are such an idiot and the people of this town will not forget what was said here"
    for sign in " .":  # the beginnings of a word are features too
        spelled = reader.words(sign.join(sentence.replace(" ", "")))
        assert {"people", "town"} <= spelled and any(w.startswith("idiot") for w in spelled)
    for sign in ".-/":
        assert {"idiot", "people", "forget"} <= reader.words(sign.join(sentence.split()))
    assert reader.words("idi" + "o" * 60 + "t") == reader.words("idiooot") == {"idiot"}
    assert reader.words("x " * 3000) <= {"x", "xx", "xxx"} and reader.words("7" * 90) == reader.words("777")
    assert reader.words("c o w") == {"c", "o", "w", "cow"}
    assert len(max(reader.words("ab" * 5000), key=len)) == 10000


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out]
    right = sum(r.predicted == r.toxic for r in held)
    assert right >= 0.93 * len(held) and sum(r.predicted and not r.toxic for r in held) <= 1


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd_docs(spark), labels)
    assert {r.score < 0.01 for r in toxicity.score(odd_docs(spark), model).collect()} == {True}
    kept = toxicity.keep_clean(odd_docs(spark), model)
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(ODD) + 4


# ---- 10


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a"] * 12 + ["b"] * 4 + ["c", None]), "w " * rng.randint(1, 30)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    target = mixing.Target(entropy=0.9, repeats=2.5, budget=1.0)
    import math
    from collections import Counter

    tokens = Counter()
    for _, s, t in rows:
        tokens[s] += t.count("w")
    total = sum(tokens.values())

    def weights(a):
        raw = {s: (n / total) ** a for s, n in tokens.items()}
        return {s: r / sum(raw.values()) for s, r in raw.items()}

    def search(holds):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(weights(mid)) else (low, mid)
        return low

    spread = search(lambda w: -sum(x * math.log(x) for x in w.values()) >= 0.9 * math.log(len(w)))
    crowd = search(lambda w: max(w[s] * total / tokens[s] for s in w) > 2.5)
    want = weights(max(spread, crowd))
    got = mixing.mix(df, target).collect()
    used = Counter()
    for r in got:
        used[r.source] += r.mix_tokens
    for s, w in want.items():
        assert abs(used[s] - w * total) <= 30, (s, used[s], w * total)
    copies = Counter(r.doc_id for r in got)
    for s in want:
        mine = [copies.get(i, 0) for i, src, _ in rows if src == s]
        assert max(mine) - min(mine) <= 1 and max(mine) <= 3
    assert all(0 <= r.mix_at < 1 for r in got)
    every = mixing.mix(df, mixing.Target(entropy=0.98, repeats=1.5, budget=None))
    assert every.select("doc_id").distinct().count() == 3000 and max(Counter(r.doc_id for r in every.collect()).values()) <= 2


def test_mixing_odd(spark):
    assert mixing.mix(empty_docs(spark)).count() == 0
    got = mixing.mix(odd_docs(spark), mixing.Target(budget=None))
    assert set(odd_docs(spark).columns) <= set(got.columns) and got.filter("doc_id = 0").count() >= 1


# ---- pipeline


def test_pipeline(spark, texts):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = corpus_pipeline.drop_copies(spark, docs, SF)
    assert after.columns == docs.columns
    last = {}
    for i, t in texts.items():
        last[(t or "").translate(LOWER)] = max(i, last.get((t or "").translate(LOWER), i))
    kept = {r.doc_id for r in after.collect()}
    assert kept == set(last.values())
    near = corpus_pipeline.drop_near_copies(spark, after, SF)
    want = {i for i, (_, c) in plain_components({i: texts[i] for i in kept}, 5, 80, 100).items() if i == c}
    assert {r.doc_id for r in near.collect()} == want
    mixed = corpus_pipeline.mix_sources(spark, near, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == want


def test_pipeline_odd(spark):
    import corpus_pipeline

    for frame in (odd_docs(spark), empty_docs(spark)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[1:]:
            docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        docs.count()


# ---- further cases of the join


def got_components(spark, rows, size=3, num=90):
    """rows: (doc_id, text) pairs, ids may repeat."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return ngram_join.join_documents(df, ngram_join.Join(size=size, num=num, den=100)).collect()


@pytest.mark.parametrize("members", [30, 300, 3000])
def test_join_crowds(spark, members):
    """Edits of one text, edits of edits, and texts that share most of a passage: components are those of all pairs."""
    rng = random.Random(members)
    length = 60 if members > 1000 else 150
    base = [f"w{rng.randint(0, 9999)}" for _ in range(length)]
    rows, last = {}, base
    for i in range(members):
        words = list(last if i % 3 == 2 else base)
        for _ in range(rng.randint(0, 3 if i % 5 else 12)):
            words[rng.randrange(length)] = f"v{rng.randint(0, 99999)}"
        last = words
        rows[i] = " ".join(words)
    got = {r.doc_id: r.component_id for r in got_components(spark, list(rows.items()))}
    assert got == fast_components(rows, 3, 90)


def fast_components(rows, size, num):
    """All pairs, by counting shared shingles."""
    import numpy as np

    from quillspark.llm.components import find

    place = {}
    sets = [sorted({place.setdefault(tuple(w[k : k + size]), len(place)) for k in range(len(w) - size + 1)}) for w in (t.split() for t in rows.values())]
    held = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        held[i, s] = 1
    n, ids, up = held.sum(axis=1), list(rows), {}
    for at in range(0, len(sets), 500):
        both = held[at : at + 500] @ held.T
        for i, j in zip(*np.nonzero(100 * both >= num * (n[at : at + 500, None] + n[None, :] - both)), strict=True):
            x, y = find(up, ids[at + i]), find(up, ids[j])
            if x != y:
                up[max(x, y)] = min(x, y)
    return {i: find(up, i) for i in rows}


def test_join_repeated_and_null_ids(spark):
    one, two, three = ("alpha beta gamma delta epsilon " * 1).strip(), "one two three four five six seven", "completely other words stand in here"
    rows = [(1, one), (2, one + " zeta"), (5, one), (5, two), (7, two), (7, two), (9, three), (None, three), (None, one), (11, None)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in got_components(spark, rows))
    # 5 has two texts, so 1 and 7 are joined through it; rows without an id link with nothing.
    assert got == sorted([(1, 1), (2, 2), (5, 1), (5, 1), (7, 1), (7, 1), (9, 9), (-1, -1), (-1, -1), (11, 11)])


def test_join_hot_tokens(spark, monkeypatch):
    """Tokens held by many documents are dealt into salts, with the same result."""
    monkeypatch.setattr(ngram_join, "HOT_BITS", 2)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4096)
    rng = random.Random(77)
    base = [f"w{rng.randint(0, 999)}" for _ in range(100)]
    rows = {}
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(100)] = f"v{rng.randint(0, 9999)}"
        rows[i] = " ".join(words)
    assert {r.doc_id: r.component_id for r in got_components(spark, list(rows.items()))} == fast_components(rows, 3, 90)


def test_parity_maps_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(6)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 900, np.uint64)
        a, b = np.unique(pool[rng.integers(0, 900, rng.integers(1, 700))]), np.unique(pool[rng.integers(0, 900, rng.integers(1, 700))])
        x, y = ngram_join.parity_map(a), ngram_join.parity_map(b)
        while len(x) != len(y):
            x, y = (ngram_join.fold(x), y) if len(x) > len(y) else (x, ngram_join.fold(y))
        apart = len(np.setxor1d(a, b))
        bits = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
        assert bits <= apart and (apart - bits) % 2 == 0


# ---- further cases of toxicity


def enumerated(token, model):
    """The cheapest reading of a lattice, by trying all of them."""
    from itertools import product

    best = None
    for path in product(*(toxicity._arcs(token, i) for i in range(len(token)))):
        text = "".join(letter for letter, _ in path)
        marked = toxicity.EDGE * 2 + text
        cost = sum(extra for _, extra in path) - sum(model.logp(marked[i : i + 2], marked[i + 2]) for i in range(len(text))) - model.logp(marked[-2:], toxicity.EDGE)
        if best is None or cost < best[0]:
            best = (cost, text)
    return best[1]


def test_restore_equals_enumeration():
    rng = random.Random(12)
    grams = {a + b + c: rng.randint(1, 400) for a in "^abeilost" for b in "^abeilost" for c in "^abeilost" if rng.random() < 0.5}
    model = toxicity.CharModel(grams)
    for _ in range(400):
        token = "".join(rng.choice("abeilost01345!|$@-_.7  ") for _ in range(rng.randint(1, 9)))
        assert toxicity.restore(token, model) == enumerated(token, model), token


def test_restore_of_long_tokens():
    words = ["idiot", "stupid", "other", "plain", "words"] * 50
    counts = {}
    for w in words:
        marked = "^^" + w + "^"
        for i in range(len(marked) - 2):
            counts[marked[i : i + 3]] = counts.get(marked[i : i + 3], 0) + 1
    reader = toxicity.Reader(toxicity.CharModel(counts))
    for n in (41, 60, 4000):
        assert "idiot" in reader.words("idi" + "o" * n + "t"), n
        assert "idiot" in reader.words("i" + "." * n + "d.i.o.t"), n
    long = "st" + "0" * 30 + "p" * 30 + "1d"
    assert reader.words(long * 100)


def test_toxicity_tables(spark):
    """Empty tables, labels of one kind, and rows without a label or id."""
    labels = spark.createDataFrame([(0, 1), (2, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    for docs in (empty_docs(spark), odd_docs(spark)):
        model = toxicity.train(docs, labels)
        assert toxicity.score(docs, model).count() == docs.count()
        assert toxicity.keep_clean(docs, model).columns == docs.columns
    nothing = toxicity.train(odd_docs(spark), labels.limit(0))
    assert {r.score for r in toxicity.score(odd_docs(spark), nothing).collect()} == {toxicity.score(odd_docs(spark), nothing).first().score}


# ---- further cases of the mixture


def plain_mixture(rows, target, block, seed):
    """{row number: passes} by sorting blocks and rows; rows: (number, source, tokens, h) with hashes from ``block``."""
    import math

    tokens, docs = {}, {}
    for _, source, n, _ in rows:
        tokens[source] = tokens.get(source, 0) + n
        docs[source] = docs.get(source, 0) + 1
    total = sum(tokens.values())
    some = {s: n / total for s, n in tokens.items() if n}
    goal = target.entropy * math.log(len(some))

    def weights(a):
        z = sum(p**a for p in some.values())
        return {s: p**a / z for s, p in some.items()}

    def holds(a):
        return -sum(w * math.log(w) for w in weights(a).values()) >= goal

    def epochs(a):
        return {s: target.budget * total * w / tokens[s] for s, w in weights(a).items()}

    def last(test):  # the largest exponent at which a predicate holds that is true below
        if test(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(80):
            low, high = ((low + high) / 2, high) if test((low + high) / 2) else (low, (low + high) / 2)
        return low

    a = max(last(holds), last(lambda x: max(epochs(x).values()) > target.repeats))
    passes = {}
    for source in tokens:
        e = epochs(a).get(source, 1.0)
        whole, room, before = math.floor(e), (e - math.floor(e)) * tokens[source], 0
        mine = [r for r in rows if r[1] == source]
        places = block(source, whole, docs[source], seed, mine)
        for number, _, n, _ in mine:
            passes[number] = whole
        for number, n in places:
            if before >= room:
                break
            passes[number] += 1
            before += n
    return passes


def test_mixture_query_against_sorting(spark):
    """The registered query: how often each document comes, against blocks and rows sorted one by one."""
    target = mixing.Target()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    hashed = docs.select("doc_id", "source", mixing._words(F.col("text")).alias("n"), F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(target.seed)).alias("h")).collect()
    rows = [(r.doc_id, r.source, r.n, r.h) for r in hashed]

    def block(source, epoch, n_docs, seed, mine):
        frame = spark.createDataFrame([(number, source, n, h, n_docs) for number, source, n, h in mine], "number long, source string, n long, h long, n_docs long")
        placed = frame.withColumn("block", mixing._block("h", "n_docs", seed))
        return [(r.number, r.n) for r in placed.select("number", "n", "block", mixing._block_place("source", "block", F.lit(epoch), seed).alias("p"), mixing._row_place("h", F.lit(epoch)).alias("q"), "h").orderBy("p", "block", "q", "h").collect()]

    want = plain_mixture(rows, target, block, target.seed)
    got = {i: 0 for i in want}
    for r in queries.op10_source_mixing(spark, SF).collect():
        got[r.doc_id] += 1
        assert 0 <= r.mix_at < 1 and r.mix_epoch < want[r.doc_id]
    assert got == want


def test_mixture_keeps_clashing_names(spark):
    names = ["tokens", "weight", "epochs", "__n", "before", "room", "n_blocks", "row", "h", "block", "passes", "epoch", "a.b", "Mix_At"]
    rows = [(i, ("x", "y", None)[i % 3], f"w{i} " * (1 + i % 7), *range(len(names))) for i in range(60)] + [(None, "x", "lost one", *range(len(names))), (None, "x", "lost two", *range(len(names))), (3, "x", None, *range(len(names)))]
    frame = spark.createDataFrame(rows, ["doc_id", "source", "text", *names])
    mixed = mixing.mix(frame, mixing.Target(entropy=0.98, repeats=1.5, budget=None))
    assert mixed.columns == ["doc_id", "source", "text", *names[:-1], "mix_tokens", "mix_block", "mix_epoch", "mix_at"]
    got = mixed.collect()
    assert {(r.doc_id, r.text) for r in got} == {(r[0], r[2]) for r in rows}
    assert all(tuple(r)[3 : 2 + len(names)] == tuple(range(len(names) - 1)) for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame.repartition(7), mixing.Target(entropy=0.98, repeats=1.5, budget=None)).collect()))


def test_mixture_of_many_sources(spark, monkeypatch):
    """More sources than are sent to every task: the salted join gives the same rows."""
    frame = spark.createDataFrame([(i, f"s{i % 23}", "word " * (1 + i % 11)) for i in range(400)], "doc_id long, source string, text string")
    plain = sorted(map(tuple, mixing.mix(frame).collect()))
    monkeypatch.setattr(mixing, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, mixing.mix(frame).collect())) == plain


# ---- further cases of pages


def test_html_hidden_parts_and_names():
    model = html_extract.trained_field()
    page = '<body><nav><ul><li><a href="/">Home</a></li></ul></nav><article{}><h1>Title here</h1><p>A sentence of some length stands here. And one more.</p></article><footer>&copy; me</footer></body>'
    text = "Title here\nA sentence of some length stands here. And one more."
    for attribute in (' class="content overflow-hidden"', ' aria-hidden="false"', ' data-x="hidden"', " data-hidden", " title='hidden'"):
        assert html_extract.extract(page.format(attribute), model) == text, attribute
    for attribute in (" hidden", ' hidden=""', ' aria-hidden="true"', ' style="color:red; display: none"', " style='visibility:hidden'"):
        assert html_extract.extract(page.format(attribute), model) == "", attribute
    inner = '<body><article><h1>Title here</h1><p>Text <noscript>no</noscript><svg><text>no</text></svg><span style="display:none">no</span>here <button>no</button>stays on. It does.</p></article></body>'
    assert html_extract.extract(inner, model) == "Title here\nText here stays on. It does."


def test_html_is_read_in_linear_time():
    import time

    model = html_extract.trained_field()
    for page in ("<b>" * 100_000, "<a " * 100_000, "<p><b>" * 50_000, "<b>" * 50_000 + "<p>x</p>" * 50_000, '<a "' * 100_000, "</b>" * 100_000, "<!--" * 100_000):
        began = time.thread_time()
        html_extract.extract(page, model)
        assert time.thread_time() - began < 5, page[:12]


def test_html_odd_tables(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>A long line of text, which ends here. And here.</p>", None), (4, "u", "<article><h1>T</h1><p>One, two. Three four.</p></article>", "x"), (4, "u", "<article><h1>T</h1><p>One, two. Three four.</p></article>", "x"), (5, "u", "<article><h1>Long</h1>" + "<p>Some words that stand here, again. And again.</p>" * 20000 + "</article>", "x")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns[:4] == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == len(rows) and [r.text for r in found if r.page_id in (1, 2)] == ["", ""]
    assert [r.text for r in found if r.page_id == 4] == ["T\nOne, two. Three four."] * 2
    assert all(r.n_chars == len(r.text) for r in found) and next(r for r in found if r.page_id == 5).text.count("\n") == 20000
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- further cases of chats


@pytest.mark.parametrize("turns", [20, 200])
def test_chat_templates_of_whole_histories(spark, turns):
    """A template that wants roles to alternate from the first turn on, over long talks."""

    def strict_roles(said):
        assert all(role == ("user", "assistant")[i % 2] for i, (role, _) in enumerate(said)), "roles must alternate"
        return "".join(f"<{role}>{text}</{role}>" for role, text in said)

    said = [(("user", "assistant")[i % 2], f"word {i * 7} said") for i in range(turns)]
    rows = spark.createDataFrame([(1, i, *t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string")
    got = chat_format.format_turns(rows, strict_roles).collect()
    assert "".join(r.formatted for r in got) == strict_roles(said) and not any(r.rewritten for r in got)
    whole = strict_roles(said)
    assert [whole[r.text_start : r.text_end] for r in got] == [t for _, t in said]


# ---- further cases of spans


def test_spans_repeated_rows_nulls_and_names(spark):
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p = word(120)
    rows = [(3, p), (3, p), (5, word(60) + p + word(70)), (None, p + word(30)), (None, None), (9, p), (11, "x" * 49), (12, "x" * 49)]
    frame = spark.createDataFrame([(i, t, "k", 1, 2, 3) for i, t in rows], "doc_id long, text string, bucket string, salt int, src int, data int")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed) for r in span_dedup.dedup_spans(frame).collect())
    # A null id is the smallest one, so it holds the passage first.
    assert got == sorted([(3, 120, 120), (3, 120, 120), (5, 250, 120), (-1, 150, 0), (-1, 0, 0), (9, 120, 120), (11, 49, 0), (12, 49, 0)])


def test_spans_passage_in_many_surroundings(spark, monkeypatch):
    """One passage in 2,000 different surroundings, with its anchors held by more documents than may share a source."""
    monkeypatch.setattr(span_dedup, "HOT", 500)
    rng = random.Random(22)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    p = word(90)
    rows = {i: word(rng.randint(0, 120)) + (p if i % 3 else p[:70]) + word(rng.randint(0, 120)) for i in range(2000)}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in span_dedup.dedup_spans(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == plain_removed(rows)


# ---- the map of ids


def test_rows_without_keys(spark, monkeypatch):
    """The same rows stay whether the map is sparse or full."""
    from quillspark.llm import idmap

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(500)] + [(None, "n")], "doc_id long, text string")
    gone = spark.createDataFrame([(i,) for i in range(0, 500, 3)], "doc_id long")
    want = sorted(t for i, t in [(i, f"t{i}") for i in range(500) if i % 3] + [(None, "n")])
    assert sorted(r.text for r in idmap.without(rows, F.col("doc_id"), gone).collect()) == want
    monkeypatch.setattr(idmap, "BITS", 6)
    assert sorted(r.text for r in idmap.without(rows, F.col("doc_id"), gone).collect()) == want


def test_pipeline_run(spark, texts):
    """All stages by run(): toxic rows go, tokens of what stays are those of the tokenizer."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    scored = {r.doc_id: r.predicted for r in queries.op9_toxicity(spark, SF).collect()}
    assert clean == {i for i, p in scored.items() if not p}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), encoding="ascii") as file:
        ranks = bpe.read_ranks(file.readlines())
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= clean
    last = {}
    for i in clean:
        t = (texts[i] or "").translate(LOWER)
        last[t] = max(i, last.get(t, i))
    kept = set(last.values())
    assert {r.doc_id for r in out} == {i for i, (_, c) in plain_components({i: texts[i] for i in kept}, 5, 80, 100).items() if i == c}
    for r in out[:40]:
        assert (r.n_tokens, r.decoded_sha256) == (len(peer.encode_ordinary(texts[r.doc_id])), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


# ---- further odd cases


def test_bpe_long_pieces_and_empty_tables(spark):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), encoding="ascii") as file:
        ranks = bpe.read_ranks(file.readlines())
    peer = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    for text in ("ab" * 3000, "é" * 2000 + " ab", "x" * 257 + " short " + "x" * 257, " " * 3000, "=" * 1000 + "\n" * 1000):
        assert codec.encode(text) == peer.encode_ordinary(text) and codec.decode(codec.encode(text)) == text.encode()
    assert all(len(k) <= bpe.MEMO_CHARS for k in codec.memo)
    assert bpe.round_trip(empty_docs(spark), codec).count() == 0 and bpe.encode_table(empty_docs(spark), codec).count() == 0


def test_quality_names_and_long_texts(spark):
    long = "\n".join(f"line {i} has some plain words, which end here." for i in range(20000))
    rows = [(1, long, 5, "w"), (2, None, 6, None), (2, "", None, "v"), (None, "a b", 7, "u")]
    got = quality_rules.clean_lines(spark.createDataFrame(rows, "doc_id long, text string, _t0 int, _w0 string"))
    assert got.columns[:4] == ["doc_id", "text", "_t0", "_w0"]
    found = {(r.doc_id, r.text and r.text[:3]): r for r in got.collect()}
    assert found[(1, "lin")].n_words == 9 * 20000 and found[(1, "lin")]._t0 == 5 and found[(1, "lin")]._w0 == "w"
    assert found[(2, None)].n_words == 0 and found[(2, "")].n_words == 0 and found[(None, "a b")].n_words == 2


def test_secrets_of_odd_rows(spark):
    secret = "password = hunter22x"
    rows = [(i, t, "s", 1, "b") for i, t in enumerate(ODD)] + [(1, secret, "s", 1, "b"), (1, secret, "s", 1, "b"), (None, "x " * 50000 + secret, None, None, None)]
    got = secret_scan.digest(secret_scan.find_spans(spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, bucket string"))).collect()
    assert len(got) == len(rows) and sorted(r.n_assign for r in got) == [0] * len(ODD) + [1, 1, 1]
    assert {r.base_sha256 for r in got if r.doc_id == 1 and r.n_assign} == {hashlib.sha256(b"assign:0:20").hexdigest()}
    assert next(r.base_sha256 for r in got if r.doc_id is None) == hashlib.sha256(b"assign:100000:100020").hexdigest()


def test_spans_in_small_shares(spark, texts, monkeypatch):
    """The whole fixture with sources cut small, anchors hot early, and shares of a few kilobytes."""
    for name, value in (("TOGETHER", 4096), ("HOT", 6), ("SOURCE_BLOCK", 64), ("MOST_SEEN", 3)):
        monkeypatch.setattr(span_dedup, name, value)
    got = {r.doc_id: tuple(r)[1:] for r in queries.op3_span_dedup(spark, SF).collect()}
    assert got == plain_removed(texts)
