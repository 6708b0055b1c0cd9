import hashlib
from collections import Counter, defaultdict

import pytest

from parselab.operators import seeds
from parselab.plans import runs

LABELS = [(n, f"log {n}", "t <*>", f"Type {k}", k) for n, k in enumerate([0] * 5 + [1] * 40 + [3] * 2 + [7] * 12)]
LABEL_SCHEMA = "row_id long, Original_Log string, Correct_Template string, Error_Type string, Error_Number int"


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(LABELS, LABEL_SCHEMA)


def turns(rows, n, seed=42):
    """Slots by hand: one stratum after the other, an empty one loses its turn."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[4]].append(row[0])
    for members in groups.values():
        members.sort(key=lambda k: hashlib.md5(f"{seed}|{k}".encode()).hexdigest())
    order = sorted(groups)
    return {
        slot: groups[order[slot % len(order)]][slot // len(order)]
        for slot in range(n)
        if slot // len(order) < len(groups[order[slot % len(order)]])
    }


@pytest.mark.parametrize("n", [1, 3, 4, 17, 200])
def test_round_robin(labels, n):
    found = {r["slot"]: r["row_id"] for r in seeds.round_robin(labels, n, "row_id").collect()}
    assert found == turns(LABELS, n)


def test_failed_rows_can_stay_out(labels):
    found = seeds.round_robin(labels, 30, "row_id", include_failed=False).collect()
    assert {r["slot"]: r["row_id"] for r in found} == turns([r for r in LABELS if r[4]], 30)


def test_other_strata(labels):
    by_type = seeds.round_robin(labels, 8, "row_id", strata_by="Error_Type").collect()
    assert Counter(r["Error_Type"] for r in by_type) == {"Type 0": 2, "Type 1": 2, "Type 3": 2, "Type 7": 2}


def test_shuffle_is_a_permutation(labels):
    found = seeds.stratified_shuffle(labels, "row_id").collect()
    by_stratum = defaultdict(list)
    for row in found:
        by_stratum[row["Error_Number"]].append(row["rank"])
    assert {k: sorted(v) for k, v in by_stratum.items()} == {
        k: list(range(1, n + 1)) for k, n in Counter(r[4] for r in LABELS).items()
    }


def test_summaries_of_seeds(spark, rows):
    chosen = spark.createDataFrame(
        [(1, " a ", "t", "T", 1), (2, "b", "t", "T", 1), (3, "c", "t", "T", 1), (4, None, "t", "T", 1), (5, "d", "t", "T", 1)],
        LABEL_SCHEMA,
    )
    texts = spark.createDataFrame(
        [(1, "a", "t ", "first"), (2, "a\n", "t", "last"), (3, "b", "t", None), (4, "nan", "t", "lost"), (5, "d", "other", "x")],
        "seq long, original_log string, correct_template string, error_summary string",
    )
    observed = seeds.attach_summaries(chosen, texts, "seq")
    assert rows(observed, "row_id", "error_summary") == [(1, "last"), (2, "nan"), (3, ""), (4, "lost"), (5, "")]
    intended = seeds.attach_summaries(chosen, texts, "seq", "intended")
    assert rows(intended, "row_id", "error_summary") == [(1, "last"), (2, ""), (3, ""), (4, ""), (5, "")]
    assert rows(observed, "Original_Log")[0] == (" a ",)


def test_stats(spark, rows):
    df = spark.createDataFrame([(1, "x"), (1, ""), (2, "")], "Error_Number int, error_summary string")
    assert set(rows(seeds.seed_stats(df))) == {(None, 3, 1, 2), (1, 2, 1, 1), (2, 1, 0, 1)}


def test_whole_selection(spark, labels):
    texts = labels.selectExpr(
        "row_id", "Original_Log AS original_log", "Correct_Template AS correct_template", "'why' AS error_summary"
    )
    found = runs.select_seeds(labels, texts, 9, include_failed=False)
    assert found.count() == 8  # the small stratum loses a turn
    assert {r["error_summary"] for r in found.collect()} == {"why"}
    with pytest.raises(ValueError, match="Error_Number"):
        runs.select_seeds(labels.drop("Error_Number"), texts, 9)


@pytest.mark.parametrize("n", [1000, 1001, 50_000])
def test_no_window_over_a_whole_stratum(labels, n):
    plan = seeds.round_robin(labels, n, "row_id")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert any("bucket" in line for line in windows)
    assert not any("hash" in line and "bucket" not in line for line in windows)
