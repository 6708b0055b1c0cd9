"""Decontamination: tiles against a plain tiling, edge cases."""

import time

import numpy as np
import pytest

from parselab.llm import decontaminate
from parselab.llm.common import mapped

RULE = decontaminate.Rule()


def plain_tiles(item, doc, least):
    """Mark the longest common stretch of unmarked tokens, first places first, until none is long enough."""
    free_i, free_d, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while (
                    i + n < len(item) and j + n < len(doc) and free_i[i + n] and free_d[j + n] and item[i + n] == doc[j + n]
                ):
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return sorted(tiles)
        tiles.append(n)
        free_i[i : i + n] = [False] * n
        free_d[j : j + n] = [False] * n


def test_tiles():
    """Repeated tokens included: the greedy choice is the same, tile by tile."""
    r = np.random.default_rng(6)
    for case in range(600):
        item = r.integers(1, 40 if case % 2 else 4, r.integers(3, 40)).tolist()
        doc = []
        for _ in range(r.integers(0, 6)):
            a = int(r.integers(0, len(item)))
            doc += item[a : a + int(r.integers(1, 15))] + r.integers(1, 60, r.integers(0, 4)).tolist()
        least = int(r.integers(1, 5))
        assert sorted(decontaminate.tile(item, [doc] if doc else [], least)) == plain_tiles(item, doc, least)


def test_tiles_of_several_runs():
    assert sorted(decontaminate.tile([1, 2, 3, 4, 5, 6], [[1, 2, 3], [4, 5, 6, 1]], 2)) == [3, 3]
    assert decontaminate.tile([1, 2], [], 1) == [] and decontaminate.tile([], [[1]], 1) == []


@pytest.mark.parametrize(("run", "seconds"), [(4_000, 1.0), (100_000, 10.0)])
def test_repeated_words_take_no_cubic_time(run, seconds):
    item = [1] * 200 + list(range(2, 52))
    start = time.process_time()
    assert decontaminate.tile(item, [[1] * run], 5) == [200]
    assert time.process_time() - start < 2 * seconds  # the bound, with room for a busy machine


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
OTHER = [f"o{k}" for k in range(300)]


def test_leaks(spark):
    whole, moved = " ".join(ITEM), " ".join(ITEM[10:] + ["x"] + ITEM[:10])
    docs = [
        (1, " ".join(OTHER[:50]) + " " + whole.upper() + ". end"),
        (2, "start " + moved),
        (3, " ".join(OTHER)),
        (4, " ".join(ITEM[:7])),  # a third of the item
        (5, None),
        (6, ""),
        (None, whole),
        (7, whole),
        (7, whole),
        (8, " ".join(OTHER * 200) + " " + whole),
        (9, " ".join(reversed(ITEM))),
    ]
    items = [(10, whole), (11, None), (12, "too short"), (13, ""), (10, whole), (14, " ".join(f"q{k}" for k in range(30)))]
    df = spark.createDataFrame([(*d, "no", 1) for d in docs], "doc_id bigint, text string, item_id string, run int")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.leaks(df, benchmark).collect()
    assert sorted(repr(r.doc_id) for r in found) == sorted(map(repr, [1, 2, None, 7, 8]))
    assert all(r.item_id == 10 and r.n_words == len(ITEM) and r.n_covered == len(ITEM) for r in found)
    assert {r.doc_id: r.n_tiles for r in found}[2] == 2
    kept = decontaminate.without_leaks(df, benchmark)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 9]
    for a, b in ((df.where("false"), benchmark), (df, benchmark.where("false"))):
        assert decontaminate.leaks(a, b).count() == 0
    assert decontaminate.without_leaks(df, benchmark.where("false")).count() == len(docs)


def test_full_bit_table_loses_nothing(spark):
    rule = decontaminate.Rule(filter_bits=64)
    docs = spark.createDataFrame([(k, " ".join(OTHER[k : k + 20])) for k in range(40)], "doc_id bigint, text string")
    items = spark.createDataFrame([(k, " ".join(OTHER[k : k + 20])) for k in range(0, 40, 7)], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, rule).collect()}
    assert found == {(d, i) for d in range(40) for i in range(0, 40, 7) if 20 - abs(d - i) >= 12}


def test_short_items_and_equal_ids(spark):
    """Items of one to four tokens are found whole; two texts under one id, and an item without id, are items of their own."""
    docs = [(1, "one two three four five"), (2, "TWO, three! four"), (3, "two-three"), (4, " ".join(ITEM)), (5, None), (None, "x one y"), (1, "one two three four five")]
    items = [(1, "One"), (2, "two three"), (3, "three four five six"), (4, "two three four"), (5, "..."), (6, None)]
    items += [(7, "five one"), (8, " ".join(ITEM)), (8, " ".join(OTHER[:30])), (None, " ".join(ITEM))]
    df = spark.createDataFrame([(*d, "no") for d in docs], "doc_id bigint, text string, item string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id, r.n_words, r.n_covered) for r in decontaminate.leaks(df, benchmark).collect()}
    n = len(ITEM)
    assert found == {
        (1, 1, 1, 1), (None, 1, 1, 1), (1, 2, 2, 2), (2, 2, 2, 2), (3, 2, 2, 2), (1, 4, 3, 3), (2, 4, 3, 3), (4, 8, n, n), (4, None, n, n)
    }
    assert sorted(r.doc_id for r in decontaminate.without_leaks(df, benchmark).collect()) == [5]


def test_stock_phrases_lose_no_pair(spark):
    """A phrase that most documents and items share makes no pair by itself, and hides none."""
    stock = OTHER[:12]
    items = [(k, " ".join(stock + [f"i{k}_{n}" for n in range(10)])) for k in range(12)]
    docs = [(100 + k, " ".join(["z"] + stock + [f"d{k}_{n}" for n in range(30)])) for k in range(40)]
    docs += [(200 + k, f"lead {t} tail") for k, t in items]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert found == {(200 + k, k) for k in range(12)}


def test_documents_come_in_small_batches(spark, monkeypatch):
    def guarded(df, per_batch, schema, done=None):
        def run(part):
            assert part.num_rows <= 512
            return per_batch(part)

        return mapped(df, run, schema, done)

    monkeypatch.setattr(decontaminate, "mapped", guarded)
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.range(3000).selectExpr(
        "id AS doc_id", f"CASE WHEN id % 1000 = 7 THEN 'see {item} there' WHEN id = 9 THEN 'a brief item' ELSE concat('text ', id) END AS text"
    ).coalesce(1)
    items = spark.createDataFrame([(1, item), (2, "brief item")], "item_id bigint, text string")
    kept = decontaminate.without_leaks(docs, items)
    assert {r["doc_id"] for r in docs.exceptAll(kept).collect()} == {7, 9, 1007, 2007}
    assert kept.count() == 2996
