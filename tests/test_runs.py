"""The stages after scoring, one after the other, over stored replies."""

import pytest
from pyspark.sql import functions as F

from parselab.functions import fixed
from parselab.operators import prompts, scoring, taxonomy
from parselab.plans import runs
from parselab.session import sizing
from parselab.sources import files


@pytest.fixture
def diff(spark):
    rows = [(n, f"log {n}", f"TEMPLATE: log {n}", "log <*>") for n in range(30)] + [(30, "log 30", None, "log <*>")]
    return spark.createDataFrame(
        rows, "row_id long, Content string, `Think-Process` string, EventTemplate string"
    )


def test_stages(spark, diff, tmp_path, rows):
    asked = prompts.with_request_id(prompts.error_prompts(diff.na.drop()))
    replies = asked.select(
        "request_id", F.concat(F.lit("Look.\n\nerror_summary: kept the number of "), "Content").alias("response")
    )
    path = str(tmp_path / "summaries")
    found = runs.explain_errors(diff, replies, path)
    runs.explain_errors(diff.limit(5), replies, path)
    assert found.count() == 30
    assert spark.read.parquet(path).count() == 35
    intended = runs.explain_errors(diff, replies, path + "2", "intended")
    assert rows(intended, "error_summary")[0] == ("kept the number of log 0",)

    prompt, figures = runs.taxonomy_request(found, "row_id", "a-reasoner", sample_size=7)
    assert rows(figures, "total", "valid", "sampled") == [(30, 30, 7)]
    text = prompt.first()["prompt"]
    assert text.count("- error_summary: kept the number of log") == 7

    document = spark.createDataFrame([("#### A. Number kept\n- x\n#### B. Other\n- y\n",)], "text string")
    types = taxonomy.read_taxonomy(document)
    asked = prompts.with_request_id(prompts.classify_prompts(diff.na.drop(), types))
    replies = asked.select(
        "request_id", F.when(F.col("row_id") % 3 == 0, '{"label": 1}').otherwise('{"label": 9}').alias("response")
    )
    labelled = runs.label_rows(diff, replies, types, str(tmp_path / "labels"))
    counts = rows(labelled.groupBy("Error_Type", "Error_Number").count())
    assert counts == [("Invalid_Label", 0, 20), ("Number kept", 1, 10)]

    chosen = runs.select_seeds(labelled, found, 4, include_failed=False, order="row_id")
    assert {r["Error_Type"] for r in chosen.collect()} == {"Number kept"}
    assert all(r["error_summary"].endswith(r["Original_Log"]) for r in chosen.collect())


def test_a_filter_does_not_extract_twice(spark):
    df = spark.createDataFrame([(1, "c", "t", "TEMPLATE: t")], "row_id int, Content string, EventTemplate string, response string")
    wrong = scoring.score(df).filter("outcome = 'diff'")
    plan = wrong._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("final template") == scoring.score(df)._jdf.queryExecution().optimizedPlan().toString().count("final template")


def test_sizing():
    for size, part in ((100 * 1024**4, 1024**3), (10 * 1024**3, 128 * 1024**2)):
        made = sizing(size, 16, part)
        assert int(made["spark.sql.shuffle.partitions"]) * part == size
        assert made["spark.sql.files.maxPartitionBytes"] == str(part)
    assert sizing(1, 8)["spark.sql.shuffle.partitions"] == "8"
