"""Work that grows with a text's length, not with its square."""

import random
import re
import time

from quillspark.llm import secret_scan, toxicity


def test_spans_of_long_texts_with_wide_letters():
    scanner = secret_scan.Scanner()
    unit = "é𝄞 password=abcdef12 AKIA" + "B" * 20 + " "
    few = scanner.spans(unit * 3)
    assert [(k, (unit * 3)[a:b]) for a, k, b in few if k in ("assign", "access")][:2] == [("assign", "password=abcdef12"), ("access", "AKIA" + "B" * 20)]
    began = time.time()
    many = scanner.spans(unit * 20_000)
    assert len(many) == len(few) // 3 * 20_000 and time.time() - began < 20
    assert many[-1][0] - few[-1][0] == len(unit) * (20_000 - 3)


def test_runs_of_one_sign():
    rng = random.Random(8)
    for _ in range(20_000):
        token = "".join(rng.choice("ab_@@!é9 ²") for _ in range(rng.randrange(9)))
        assert toxicity.undressed(token) == re.sub(r"(\W)\1+$", "", token)
    began = time.time()
    for token in ("a" + "@" * 300_000 + "b", "@" * 300_000, "a" + "@!" * 150_000):
        toxicity.undressed(token)
    assert time.time() - began < 1
