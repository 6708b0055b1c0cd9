import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parselab.functions import fixed, templates
from parselab.operators import augment, prompts
from parselab.plans import runs

SEED_SCHEMA = (
    "seed_id long, Original_Log string, Correct_Template string, error_summary string, Error_Type string, Error_Number int"
)


@pytest.fixture
def chosen(spark):
    rows = [(n, f"log {n}", "log <*>", "why", "T", 1) for n in range(12)]
    return spark.createDataFrame(rows, SEED_SCHEMA)


@pytest.fixture
def document(spark):
    return spark.createDataFrame([("#### A. T {odd}",)], "document string")


def responder(asked, round_no):
    """One variant per round; seeds below 4 fall silent after the first, seed 11 never answers."""
    text = F.concat("Original_Log", F.lit(f" v{round_no}"))
    one = F.concat(F.lit('["'), text, F.lit('"]'))
    two = F.concat(F.lit('[{"example": "'), text, F.lit('", "template": "'), "Correct_Template", F.lit('"}]'))
    reply = F.when(F.col("strategy") == 1, one).otherwise(two)
    silent = (F.col("seed_id") == 11) | (F.lit(round_no > 0) & (F.col("seed_id") < 4))
    return asked.select("request_id", F.when(silent, "").otherwise(reply).alias("response"))


def test_rounds_until_full_or_silent(spark, chosen, document):
    made = augment.generate_variants(augment.assign_strategy(chosen), responder, document, 5)
    counts = Counter(r["seed_id"] for r in made.collect())
    assert counts == {**{n: 1 for n in range(4)}, **{n: 5 for n in range(4, 11)}}
    texts = [r["input"] for r in made.filter("seed_id = 7").orderBy("place").collect()]
    assert texts == [f"log 7 v{n}" for n in range(5)]


def test_tasks_of_the_rounds_stay_small(spark, chosen, document, monkeypatch):
    """Tasks grow in number with the seeds, not in size, however small their rows are in a shuffle."""
    monkeypatch.setattr(augment, "SEEDS", 2)
    asked_parts = []

    def reply(asked, round_no):
        asked_parts.append(asked.rdd.getNumPartitions())
        return responder(asked, round_no)

    made = augment.generate_variants(augment.assign_strategy(chosen), reply, document, 5)
    assert made.rdd.getNumPartitions() == 6 and asked_parts[:5] == [6] * 5  # the last round asks for nothing
    assert Counter(r["seed_id"] for r in made.collect()) == {**{n: 1 for n in range(4)}, **{n: 5 for n in range(4, 11)}}


def test_equal_prompts_share_one_reply(spark, document, rows):
    """Equal seeds get the same variants, one row each; the responder sees each prompt once."""
    twins = spark.createDataFrame([(n, "user 5 login", "user <*> login", "why", "T", 1) for n in (1, 2)], SEED_SCHEMA)
    asked_rows = []

    def reply(asked, round_no):
        asked_rows.append(asked.count())
        two = F.lit('["user 6 login", "user 7 login"]')
        return asked.select("request_id", two.alias("response")).unionByName(
            asked.select("request_id", F.lit("~ later text").alias("response"))
        )

    made = augment.generate_variants(twins.withColumn("strategy", F.lit(1)), reply, document, 2)
    expected = [(s, p, f"user {5 + p} login") for s in (1, 2) for p in (1, 2)]
    assert rows(made, "seed_id", "place", "input") == expected and asked_rows[0] == 1
    keyed = prompts.with_request_id(twins.select("seed_id", F.lit("p").alias("prompt")))
    replies = spark.createDataFrame([(None,), ("b",), ("a",)], "response string").select(
        F.md5(F.lit("p")).alias("request_id"), "response"
    )
    assert rows(prompts.attach_responses(keyed, replies), "seed_id", "response", "answered") == [(1, "a", True), (2, "a", True)]


def test_tuning_set(spark, chosen, document, rows):
    broken = chosen.unionByName(spark.createDataFrame([(99, "x", None, "", "T", 1)], SEED_SCHEMA))
    observed = runs.tuning_set(broken, responder, document, 2)
    assert rows(augment.augment_totals(observed)) == [(13, 4 + 7 * 2, 31)]
    assert rows(observed.filter("seed_id = 99"), "input", "output") == [("x", "nan")]
    intended = runs.tuning_set(broken, responder, document, 2, "intended")
    assert intended.filter("seed_id = 99").count() == 0
    ordered = observed.orderBy("origin", "seed_id", "place").collect()
    assert [r["origin"] for r in ordered] == ["original"] * 13 + ["variant"] * 18
    assert {r["instruction"] for r in ordered} == {fixed.INSTRUCTION}


def test_prompts_by_strategy(spark, chosen, document):
    by_hand = chosen.limit(3).withColumn("strategy", (F.col("seed_id") + 1).cast("int"))
    asked = {r["strategy"]: r["prompt"] for r in prompts.augment_prompts(by_hand, document, 4, 9).collect()}
    assert "specializing in variable substitution" in asked[1] and "generate 4 new" in asked[1]
    assert asked[2].endswith("Original Log: log 1\nTemplate: log <*>\nError Explanation: why\nError Type: T")
    assert "T {odd}" in asked[3] and "(1-9)" in asked[3] and "Error Number: 1\n\nTask:" in asked[3]


def test_topup_lists_what_there_is(spark, chosen, document):
    variants = spark.createDataFrame(
        [(0, 0, 1, "b"), (0, 0, 0, "a"), (0, 1, 0, "c"), (1, 0, 0, "x"), (1, 0, 1, "y"), (1, 0, 2, "z"), (1, 1, 0, "w")],
        "seed_id long, round int, pos int, input string",
    )
    strategy = chosen.limit(3).withColumn("strategy", F.lit(3))
    asked = {r["seed_id"]: r["prompt"] for r in prompts.topup_prompts(strategy, variants, document, 4).collect()}
    assert set(asked) == {0, 2}
    assert "versions:  \n- a\n- b\n- c  \n\nGenerate 1 new" in asked[0]
    assert "generate 4 additional" in asked[2] and "versions:  \n  \n" in asked[2]


def test_strategies_are_spread(spark):
    df = augment.assign_strategy(spark.range(3000).withColumnRenamed("id", "seed_id"))
    counts = {r["strategy"]: r["count"] for r in df.groupBy("strategy").count().collect()}
    assert set(counts) == {1, 2, 3} and min(counts.values()) > 900


LOGS = [
    ("open file a.txt (3) [x]", "open file <*> (<*>) [x]"),
    ("open file b.txt (4) [x]", "open file <*> (<*>) [x]"),
    ("open file c.txt (4) [x]", "open file <*> (<*>) [x]"),
    ("no match", "open file <*> (<*>) [x]"),
    ("<*>", "plain"),
    ("took 5ms\nnext", "took <*>"),
    ("a\\E1", "a\\E<*>"),
]


def test_slot_values(spark, rows):
    df = spark.createDataFrame(LOGS, "Content string, EventTemplate string")
    found = rows(augment.slot_values(df), "template", "slot", "value", "rows")
    assert found == sorted(
        [
            ("open file <*> (<*>) [x]", 1, "a.txt", 1),
            ("open file <*> (<*>) [x]", 1, "b.txt", 1),
            ("open file <*> (<*>) [x]", 1, "c.txt", 1),
            ("open file <*> (<*>) [x]", 2, "3", 1),
            ("open file <*> (<*>) [x]", 2, "4", 2),
            ("took <*>", 1, "5ms\nnext", 1),
            ("a\\E<*>", 1, "1", 1),
        ],
        key=repr,
    )


def test_substitutes_match_their_template(spark):
    df = spark.createDataFrame(LOGS, "Content string, EventTemplate string")
    seeds = spark.createDataFrame(
        [(n, "", t) for n, t in enumerate(["open file <*> (<*>) [x]", "took <*>", "plain", "unseen <*>"])],
        "seed_id long, Original_Log string, Correct_Template string",
    )
    made = augment.substitute_variables(seeds, augment.slot_values(df), 6)
    found = made.withColumn("ok", templates.matches(F.col("input"), F.col("output"))).collect()
    assert Counter(r["seed_id"] for r in found) == {0: 6, 1: 6}
    assert all(r["ok"] for r in found)
    assert {re.search(r"\((.)\)", r["input"])[1] for r in found if r["seed_id"] == 0} <= {"3", "4"}


@pytest.mark.parametrize(
    ("log", "template", "ok"),
    [
        ("a 1 b", "a <*> b", True),
        ("a  b", "a <*> b", False),
        ("xa 1 b", "a <*> b", False),
        ("a.c", "a.c", True),
        ("abc", "a.c", False),
        ("f(1)+[2]", "f(<*>)+[<*>]", True),
        ("\\d{2}", "\\d{<*>}", True),
        ("a b", "<*><*>", True),
        ("a", "<*><*>", False),
    ],
)
def test_template_match(spark, log, template, ok):
    df = spark.createDataFrame([(log, template)], "l string, t string")
    assert df.select(templates.matches(F.col("l"), F.col("t"))).first()[0] is ok


def test_distinct_keeps_the_first(spark, rows):
    df = spark.createDataFrame(
        [(1, "a", "t1", 0, 1), (1, "a", "t2", 0, 0), (1, "b", "t3", 1, 0), (2, "a", "t4", 0, 0)],
        "seed_id long, input string, output string, round int, pos int",
    )
    assert rows(augment.distinct_variants(df), "seed_id", "input", "output") == [
        (1, "a", "t2"),
        (1, "b", "t3"),
        (2, "a", "t4"),
    ]


def test_model_step(spark):

    def client():
        def answer(prompt):
            if prompt == "bad":
                raise RuntimeError("down")
            return prompt.upper()

        return answer

    asked = spark.createDataFrame([(1, "good"), (2, "bad")], "n int, prompt string")
    found = {r["n"]: (r["response"], r["error"]) for r in prompts.call_model(asked, client).collect()}
    assert found == {1: ("GOOD", None), 2: (None, "down")}


def test_equal_prompts_are_asked_once(spark, rows):
    asked = prompts.with_request_id(spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "n int, prompt string"))
    requests = prompts.distinct_requests(asked)
    assert requests.count() == 2
    replies = requests.filter("prompt = 'p'").selectExpr("request_id", "'r' AS response")
    assert rows(prompts.attach_responses(asked, replies), "n", "response", "answered") == [
        (1, "r", True),
        (2, "r", True),
        (3, None, False),
    ]
