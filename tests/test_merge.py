import random

import numpy as np
import pytest

from parselab.operators import merge
from parselab.plans import runs


def pairs_by_hand(vectors, threshold):
    unit = [v / n if (n := np.linalg.norm(v)) else v for v in np.asarray(vectors, dtype=float)]
    return {
        (i, j): float(unit[i] @ unit[j])
        for i in range(len(unit))
        for j in range(i + 1, len(unit))
        if unit[i] @ unit[j] > threshold
    }


def vector_table(spark, vectors):
    return spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "pos long, vector array<double>"
    )


@pytest.mark.parametrize("block_rows", [1000, 7, 10, 3])
def test_pairs_are_exact(spark, block_rows):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    vectors = np.concatenate([c + rng.normal(scale=0.25, size=(20, 8)) for c in centres] + [np.zeros((2, 8))])
    vectors = np.concatenate([vectors, np.repeat(vectors[:1], 15, axis=0)])  # copies in one group
    found = merge.similar_pairs(vector_table(spark, vectors), 0.9, block_rows=block_rows).collect()
    expected = pairs_by_hand(vectors, 0.9)
    assert {(r["i"], r["j"]) for r in found} == set(expected)
    assert len(found) == len(expected)
    assert all(abs(r["sim"] - expected[r["i"], r["j"]]) < 1e-9 for r in found)


def test_threshold_is_strict(spark):
    vectors = [[1.0, 0.0], [0.6, 0.8], [2.0, 0.0]]
    assert {(r["i"], r["j"]) for r in merge.similar_pairs(vector_table(spark, vectors), 0.6).collect()} == {(0, 2)}


def test_no_types(spark):
    assert merge.similar_pairs(vector_table(spark, []).limit(0), 0.9).collect() == []


def by_hand(titles, counts, pairs):
    """The plan and the rewritten labels, one step after the other."""
    plan = {}
    for i, j in sorted(pairs):
        one, two = titles[i], titles[j]
        loser, winner = (two, one) if counts.get(one, 0) > counts.get(two, 0) else (one, two)
        plan[loser] = winner
    end = {t: t for t in titles}
    for source, target in plan.items():
        end = {t: target if now == source else now for t, now in end.items()}
    return plan, end


def spark_plan(spark, titles, counts, pairs):
    types = spark.createDataFrame(list(enumerate(titles)), "pos long, title string")
    rows = spark.createDataFrame(list(counts.items()), "title string, rows long")
    table = spark.createDataFrame([(i, j, 0.95) for i, j in pairs], "i long, j long, sim double")
    return merge.merge_plan(merge.pair_counts(table, types, rows))


def check(spark, titles, counts, pairs):
    plan, end = by_hand(titles, counts, pairs)
    found = spark_plan(spark, titles, counts, pairs)
    assert {r["from_type"]: r["to_type"] for r in found.collect()} == plan
    assert [r["from_type"] for r in found.orderBy("seq").collect()] == list(plan)
    once = {r["from_type"]: r["to_type"] for r in merge.resolve_plan(found).collect()}
    assert {t: once.get(t, t) for t in titles} == end
    root = {r["from_type"]: r["to_type"] for r in merge.resolve_plan(found, "intended").collect()}
    assert not set(root.values()) & set(plan)
    return plan, end, root


def test_stale_chain(spark):
    """Y -> Z stands in the plan before X -> Y: applied once, X ends at a type that is gone."""
    plan, end, root = check(spark, ["Y", "Z", "X"], {"X": 1, "Y": 2, "Z": 2}, [(0, 1), (0, 2)])
    assert plan == {"Y": "Z", "X": "Y"}
    assert end["X"] == "Y"
    assert root["X"] == "Z"


@pytest.mark.parametrize("seed", range(6))
def test_random_plans(spark, seed):
    rng = random.Random(seed)
    titles = [f"T{k}" for k in range(14)]
    counts = {t: rng.randint(1, 5) for t in titles if rng.random() < 0.8}
    pairs = [(i, j) for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.2]
    check(spark, titles, counts, pairs)


def test_equal_titles(spark):
    found = spark_plan(spark, ["S", "S"], {"S": 3}, [(0, 1)])
    assert [(r["from_type"], r["to_type"]) for r in found.collect()] == [("S", "S")]
    assert [(r["from_type"], r["to_type"]) for r in merge.resolve_plan(found).collect()] == [("S", "S")]
    assert merge.resolve_plan(found, "intended").collect() == []


def test_a_circle_is_an_error(spark):
    found = spark_plan(spark, ["A", "B", "A"], {"A": 3, "B": 3}, [(0, 1), (1, 2)])
    with pytest.raises(ValueError, match="circle"):
        merge.resolve_plan(found, "intended")


def test_whole_merge(spark, rows):
    vectors = {"A": [1.0, 0.0], "B": [0.99, 0.05], "C": [0.0, 1.0]}
    types = spark.createDataFrame(
        [(n, t, "d", ["e"], v) for n, (t, v) in enumerate(vectors.items())],
        "pos long, title string, description string, examples array<string>, vector array<double>",
    )
    labels = spark.createDataFrame(
        [("A", 1)] * 2 + [("B", 2)] * 3 + [("C", 3)] + [("Invalid_Label", 0)], "Error_Type string, Error_Number int"
    )
    done = runs.merge_types(types, labels)
    assert rows(done["plan"], "from_type", "to_type") == [("A", "B")]
    assert rows(done["types"], "title") == [("B",), ("C",)]
    assert rows(done["labels"])[:2] == [("B", 1), ("B", 1)]
    assert rows(done["effect"]) == [("A", 2, 0, 2), ("B", 3, 5, 0), ("C", 1, 1, 0), ("Invalid_Label", 1, 1, 0)]


def test_nothing_to_merge(spark, rows):
    types = spark.createDataFrame(
        [(0, "A", [1.0, 0.0]), (1, "B", [0.0, 1.0])], "pos long, title string, vector array<double>"
    )
    labels = spark.createDataFrame([("A", 1), ("B", 2)], "Error_Type string, Error_Number int")
    for mode in ("observed", "intended"):
        done = runs.merge_types(types, labels, mode=mode)
        assert rows(done["labels"]) == rows(labels)
        assert rows(done["types"], "title") == [("A",), ("B",)]


def test_sweep_counts_zero(spark, rows):
    pairs = spark.createDataFrame([(0, 1, 0.86), (0, 2, 0.92)], "i long, j long, sim double")
    assert rows(merge.threshold_sweep(pairs, [0.85, 0.9, 0.95])) == [(0.85, 2), (0.9, 1), (0.95, 0)]


def test_embedder(spark):
    def client():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "pos int, embed_text string")
    found = merge.call_embedder(df, client).orderBy("pos").collect()
    assert [r["vector"] for r in found] == [[2.0, 1.0], [3.0, 1.0]]


@pytest.mark.parametrize("threshold", [0.85, 0.90, 0.95])
def test_planted_near_copies(spark, threshold):
    """Near copies at the published thresholds; no pair is lost, however the vectors lie in blocks."""
    g = np.random.default_rng(9)
    base = g.standard_normal((40, 64))
    rows = np.concatenate([base] + [base + s * g.standard_normal((40, 64)) for s in (0.05, 0.2, 0.35, 0.6)])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    cosine = unit @ unit.T
    expected = {(i, j) for i, j in zip(*np.nonzero(cosine > threshold), strict=True) if i < j}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)], "pos long, vector array<double>")
    found = merge.similar_pairs(df, threshold, block_rows=16).collect()
    assert {(r["i"], r["j"]) for r in found} == expected and len(found) == len(expected) > 0
    assert all(abs(r["sim"] - cosine[r["i"], r["j"]]) < 1e-9 for r in found)


@pytest.mark.parametrize("block_rows", [7, 2048])
def test_plan_and_counts_without_a_shuffle_of_pairs(spark, rows, block_rows):
    """The same as by joins of the pairs, also where places and titles are given twice."""
    g = np.random.default_rng(11)
    data = [(k, f"Type {k % 50}", g.standard_normal(5).tolist()) for k in range(60)]
    types = spark.createDataFrame([*data, *data[:3], (4, "Other", data[4][2])], "pos long, title string, vector array<double>")
    counts = spark.createDataFrame([(f"Type {k}", int(g.integers(1, 4))) for k in range(40)], "title string, rows long")
    joined = merge.pair_counts(merge.similar_pairs(types, 0.6), types, counts)
    names = ["i", "j", "type_1", "count_1", "type_2", "count_2"]
    counted = merge.counted_pairs(types, counts, 0.6, block_rows)
    assert rows(counted, *names) == rows(joined, *names) and counted.columns == joined.columns
    folded, plan = merge.similar_plan(types, counts, 0.6, block_rows), merge.merge_plan(joined)
    assert rows(folded, "from_type", "seq") == rows(plan, "from_type", "seq")
    last = {r["from_type"]: r["to_type"] for r in folded.collect()}
    assert all(last[r["from_type"]] == r["to_type"] for r in plan.collect() if "Type 4" not in (r["from_type"], r["to_type"]) and "Other" not in (r["from_type"], r["to_type"]))


def test_plan_of_pairs_takes_no_exchange_of_pairs(spark):
    types = spark.createDataFrame([(k, f"T{k}", [1.0, k / 100]) for k in range(40)], "pos long, title string, vector array<double>")
    counts = spark.createDataFrame([], "title string, rows long")
    plan = merge.counted_pairs(types, counts, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan.split("FlatMapGroupsInArrow")[0]
