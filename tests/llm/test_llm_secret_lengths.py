"""Very long strings in linear time, and all four classes against every window on its own."""

import math
import random
import re
import time

import pytest

from parselab.llm import secret_scan
from parselab.llm.secret_scan import Entropy

RULE = Entropy()
ALLOWED = re.compile("|".join(f"(?:{p})" for p in RULE.allowed))
MILLION = 1_000_000
LONG = {
    "letters": "ACGT" * (MILLION // 4),
    "dashes": "-" * MILLION,
    "hex": "".join(random.Random(1).choices("0123456789abcdef", k=MILLION)),
    "base64url": "".join(random.Random(2).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", k=MILLION)),
    "dots": "a." * (MILLION // 2),
    "plus": "1+" * (MILLION // 2),
    "at": "a@" * (MILLION // 2),
    "keywords": "token=abcdefgh1 " * (MILLION // 16),
    "colons": "https://a.b/c?" * (MILLION // 14),
}


@pytest.mark.parametrize("name", LONG)
def test_a_million_characters(name):
    start = time.process_time()
    base, spans = secret_scan.all_spans(LONG[name], RULE, ALLOWED)
    assert time.process_time() - start < 6  # below two seconds on an idle machine; square work would take hours
    assert (len(spans) > 0) == (name in ("hex", "base64url", "keywords"))


def test_a_million_characters_are_masked(spark):
    rows = [(1, LONG["base64url"], 5), (2, "x " + LONG["letters"], 6)]
    found = secret_scan.redacted(spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")).collect()
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in found}
    assert len(texts[1][0]) < 20_000 and texts[1][1] == len(texts[1][0])
    assert texts[2] == (rows[1][1], 6)


def bits(window):
    return -sum(window.count(c) / len(window) * math.log2(window.count(c) / len(window)) for c in set(window))


def plain(text):
    """Characters that each class finds, window by window; no candidate here is let be or overlaps a base span."""
    found = {"hex": set(), "base64": set(), "lower": set(), "upper": set()}
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        runs = [("hex", r, 3.0) for p in ("[0-9a-f]{20,}", "[0-9A-F]{20,}") for r in re.finditer(p, m[0])]
        runs = [(k, r, b) for k, r, b in runs if re.search("[0-9]", r[0]) and re.search("[A-Za-z]", r[0])]
        for kind, p in (("lower", "[0-9a-z]{20,}"), ("upper", "[0-9A-Z]{20,}")):
            runs += [(kind, r, 3.4) for r in re.finditer(p, m[0]) if not any(re.fullmatch(n, r[0]) for n in RULE.names)]
        runs.append(("base64", re.match(".*", m[0]), 3.9))
        for kind, r, least in runs:
            for i in range(len(r[0]) - 19):
                w = r[0][i : i + 20]
                if kind == "base64" and not all(re.search(c, w) for c in ("[0-9]", "[a-z]", "[A-Z]")):
                    continue
                if kind in ("lower", "upper") and not (re.search("[0-9]", w) and re.search("[G-Zg-z]", w)):
                    continue
                if bits(w) >= least:
                    at = m.start() + r.start() + i
                    found[kind].update(range(at, at + 20))
    return found


def test_classes_equal_every_window():
    rng = random.Random(4)
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ab01", "AZaz09+/=_-"]
    for _ in range(400):
        text = " ".join("".join(rng.choices(rng.choice(alphabets), k=rng.randrange(15, 31))) for _ in range(4))
        if rng.random() < 0.5:
            text = text.replace(" ", rng.choice("-_=/"), 1)
        spans = secret_scan.entropy_spans(text, RULE, re.compile(r"(?!)"))
        found = {k: {c for a, z, kind in spans if kind == f"entropy_{k}" for c in range(a, z)} for k in ("hex", "base64", "lower", "upper")}
        assert found == plain(text)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("https://h.io/cb?access=9f86d081884c7d659a2feaa0c1d2", "entropy_hex:23:51"),
        ("https://h.io/9f86d081884c7d659a2feaa0c1d2", ""),
        ("1https://h.io/9f86d081884c7d659a2feaa0c1d2", ""),
        ("mail a9f86d081884c7d659a2feaa0c1d2@example.org now", ""),
        ("a9f86d081884c7d659a2feaa0c1d2@localhost", "entropy_hex:0:29"),
    ],
)
def test_let_be(text, expected):
    assert secret_scan.joined(secret_scan.all_spans(text, RULE, ALLOWED)[1]) == expected
