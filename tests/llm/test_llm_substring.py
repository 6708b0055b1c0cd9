"""Factors and kept words against all windows of all documents."""

import random
import re
from hashlib import sha256

import pytest

from parselab.llm import exchange, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, kept string, block int"


def plain(rows, width=13):
    """(doc_id, n_words, n_removed, digest of the kept words) of each row."""
    cut = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    order = {d: float("inf") if d is None else d for d, _ in cut}
    for d, words in cut:
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            least[w] = min(least.get(w, float("inf")), order[d])
    out = []
    for d, words in cut:
        gone = set()
        for i in range(len(words) - width + 1):
            if least[tuple(words[i : i + width])] < order[d]:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA).repartition(parts)


def found(spark, rows, **options):
    made = substring.parse(table(spark, rows), **options).select("doc_id", "n_words", "n_removed", "kept_sha256")
    return sorted((tuple(r) for r in made.collect()), key=repr)


def corpus(seed):
    """Documents from few words, with shared passages of 11 to 16 words, copies, near copies and a line in a third of all."""
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passages = [some(n) for n in (11, 12, 13, 13, 14, 16, 40)]
    line, page = some(15), some(120)
    rows = []
    for i in range(90):
        words = some(rng.randrange(0, 60))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        if i % 3 == 0:
            words += line + some(rng.randrange(3))
        if i % 7 == 0:
            words = list(page)
            words[rng.randrange(120)] = "edit"
        rows.append((rng.randrange(10**12), rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += [(rng.randrange(10**12), rows[5][1]) for _ in range(8)] + rows[:3]
    return rows + [(7, None), (8, ""), (9, "\x85 \xa0 " * 20), (None, rows[0][1]), (None, rows[0][1]), (1, "a " * 400), (2, "a " * 30)]


@pytest.mark.parametrize("size", [300, 3_000, 8_000_000])
def test_parse_equals_all_windows(spark, size):
    rows = corpus(size)
    assert found(spark, rows, block_bytes=size) == plain(rows)


def test_short_windows_and_empty_table(spark):
    rows = [(3, "a b c d"), (1, "x a b y"), (2, "c d a b")]
    assert found(spark, rows, width=2) == plain(rows, 2)
    assert found(spark, []) == []


def test_factors_name_their_reference(spark):
    rng = random.Random(1)
    passage = [f"p{i}" for i in range(20)]
    texts = {1: ["x"] * 3 + passage[:15], 2: ["y"] + passage, 3: [str(rng.random()) for _ in range(5)] + passage + ["z"]}
    df = table(spark, [(d, " ".join(w)) for d, w in texts.items()])
    rows = {r["doc_id"]: r for r in substring.parse(df, texts=True, block_bytes=50).collect()}
    assert [tuple(f) for f in rows[2]["factors"]] == [(1, 15, 1, 3)]
    # Up to the end of the first reference, then what goes on across that boundary.
    assert [tuple(f) for f in rows[3]["factors"]] == [(5, 15, 1, 3), (8, 17, 2, 4)]
    assert rows[1]["factors"] == [] and rows[3]["kept"] == " ".join(texts[3][:5] + ["z"]) and rows[2]["kept"] == "y p15 p16 p17 p18 p19"


def test_byte_planes():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 1000):
        values = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (exchange.unpack(exchange.pack(values), n) == values).all()
        small = values >> np.uint64(50)
        assert (exchange.numbers(exchange.planes(small), n) == small).all()
    assert exchange.pack(np.zeros(4, np.uint64)) == b"" and (exchange.unpack(b"", 4) == 0).all()
