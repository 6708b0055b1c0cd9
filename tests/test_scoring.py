import random

import pytest
from pyspark.sql import functions as F

from parselab.operators import scoring
from parselab.plans import runs

SCORED = "system string, row_id long, Prediction string, EventTemplate string, outcome string"


def scored(spark, rows):
    return spark.createDataFrame(rows, SCORED)


def test_score(spark):
    df = spark.createDataFrame(
        [(1, "c", "t <*>", 'x\nTEMPLATE: " t <*> "'), (2, "c", " t ", "TEMPLATE: t"), (3, "c", None, "TEMPLATE: t"), (4, "c", "t", None)],
        "row_id long, Content string, EventTemplate string, response string",
    )
    found = {r["row_id"]: (r["outcome"], r["gold_missing"], r["tier"]) for r in scoring.score(df).collect()}
    assert found == {1: ("same", False, 1), 2: ("same", False, 1), 3: ("diff", True, 1)}


def test_empty_run(spark, rows):
    none = scored(spark, []).limit(0)
    assert rows(scoring.accuracy(none)) == [(0, 0, 0.0)]
    assert rows(scoring.run_summary(none, "i", "o")) == [("success", 0, 0, 0.0, "i", "o")]
    assert rows(scoring.grouping_accuracy(none)) == [(0, 0, 0.0)]


def groups_by_hand(rows):
    pred, gold = {}, {}
    for n, (p, g) in enumerate(rows):
        pred.setdefault(p, set()).add(n)
        gold.setdefault(g, set()).add(n)
    return sum(pred[p] == gold[g] for p, g in rows)


@pytest.mark.parametrize("seed", range(4))
def test_grouping_accuracy(spark, seed):
    rng = random.Random(seed)
    given = [(f"p{(g * 2 + rng.choice([0, 0, 0, 1])) % 9}", f"g{g}") for g in (rng.randint(0, 7) for _ in range(60))]
    df = scored(spark, [("s", n, p, g, "diff") for n, (p, g) in enumerate(given)])
    (row,) = scoring.grouping_accuracy(df).collect()
    assert (row["rows"], row["correct"]) == (60, groups_by_hand(given))


def test_grouping_is_perfect_for_gold(spark):
    df = scored(spark, [("s", n, f"t{n % 3}", f"t{n % 3}", "same") for n in range(9)])
    assert scoring.grouping_accuracy(df, ["system"]).first()["grouping_accuracy"] == 100.0


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_running_accuracy(spark, chunk):
    outcomes = [random.Random(n).choice(["same", "diff"]) for n in range(50)]
    kept = [n for n in range(50) if n % 13]
    df = scored(spark, [("s", n, "", "", outcomes[n]) for n in kept])
    found = scoring.running_accuracy(df, batch_size=4, chunk=chunk).orderBy("batch_id").collect()
    for row in found:
        upto = [n for n in kept if n < (row["batch_id"] + 1) * 4]
        right = sum(outcomes[n] == "same" for n in upto)
        assert (row["processed"], row["correct"]) == (len(upto), right)


def test_leaked_logs_leave(spark, rows):
    logs = spark.createDataFrame([("Disk  FULL",), ("disk ok",), (None,)], "Content string")
    tuning = spark.createDataFrame([(" disk full\n",)], "Content string")
    assert rows(scoring.decontaminate(logs, tuning)) == sorted([("disk ok",), (None,)], key=repr)


def test_inconsistent(spark, rows):
    df = scored(spark, [("s", 1, "a", "t", ""), ("s", 2, "b", "t", ""), ("s", 3, "c", "u", "")])
    assert rows(scoring.inconsistent_templates(df)) == [("t", 2, 2)]


def test_whole_run(spark, tmp_path, rows):
    logs = spark.range(40).selectExpr(
        "id AS row_id", "concat('log ', id) AS Content", "'log <*>' AS EventTemplate", "'more' AS extra"
    )
    from parselab.operators import prompts

    asked = prompts.with_request_id(prompts.parse_prompts(logs))
    replies = asked.filter("row_id % 4 <> 3").selectExpr(
        "request_id", "CASE WHEN row_id % 4 = 0 THEN 'no idea' ELSE 'TEMPLATE: log <*>' END AS response"
    )
    summary = runs.score_logs(logs, replies, str(tmp_path))
    assert rows(summary, "processed", "correct") == [(30, 20)]
    back = spark.read.parquet(str(tmp_path / "outcomes"))
    assert rows(back.groupBy("outcome").agg(F.count(F.lit(1)))) == [("diff", 10), ("same", 20)]
    sampled = runs.score_logs(logs, replies, str(tmp_path / "s"), sample_size=8)
    assert sampled.first()["processed"] <= 8
    with pytest.raises(ValueError, match="EventTemplate"):
        runs.score_logs(logs.drop("EventTemplate"), replies, str(tmp_path))


def test_batches_of_large_row_numbers(spark, rows):
    base = 2**53
    scored = spark.range(base, base + 12).selectExpr("id AS row_id", "'s' AS system", "'same' AS outcome")
    found = scoring.running_accuracy(scored, batch_size=1)
    assert rows(found, "batch_id", "processed") == [(base + k, k + 1) for k in range(12)]


def test_passages(spark, rows):
    passage = "one two three four five six seven"
    documents = [(1, f"x{passage}y z"), (2, passage.upper()), (3, f"a {passage}"), (3, f"a {passage}"), (4, None), (5, "")]
    held = scoring.passage_leaks(
        spark.createDataFrame(documents, "doc_id long, text string"),
        spark.createDataFrame([(7, passage), (8, "too short"), (9, None), (7, passage)], "item_id long, text string"),
    )
    assert rows(held) == [(1, 7), (3, 7)]
