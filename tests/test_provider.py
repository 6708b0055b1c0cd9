"""The model step: system texts, calls in flight, waits, and runs that go on where another one stopped."""

import json
import threading
import time
from collections import Counter

import pytest

from parselab.operators import augment, prompts, provider

ASKED = "n int, system_prompt string, prompt string"


def test_same_prompt_under_two_system_texts(spark, rows):
    asked = prompts.with_request_id(
        spark.createDataFrame([(1, "a", "p"), (2, "b", "p"), (3, "a", "p"), (4, None, "p"), (5, "", "p")], ASKED)
    )
    assert asked.select("request_id").distinct().count() == 3  # no system text is an empty one
    assert prompts.distinct_requests(asked).count() == 3
    replied = prompts.call_model(prompts.distinct_requests(asked), lambda: lambda system, prompt: f"{system}:{prompt}")
    found = prompts.attach_responses(asked, replied).filter("n <= 3")
    assert rows(found, "n", "response") == [(1, "a:p"), (2, "b:p"), (3, "a:p")]


def test_separator_keeps_texts_apart(spark):
    asked = prompts.with_request_id(spark.createDataFrame([(1, "ab", "c"), (2, "a", "bc")], ASKED))
    assert asked.select("request_id").distinct().count() == 2


@pytest.mark.parametrize("k", [1, 6])
def test_calls_in_flight(spark, k):
    def slow_client():
        lock, running, peak = threading.Lock(), [0], [0]

        def answer(prompt):
            with lock:
                running[0] += 1
                peak[0] = max(peak[0], running[0])
            time.sleep(0.02)
            with lock:
                running[0] -= 1
            return str(peak[0])

        return answer

    asked = spark.range(60).selectExpr("id", "cast(id AS string) AS prompt").coalesce(1)
    found = [int(r["response"]) for r in prompts.call_model(asked, slow_client, in_flight=k).collect()]
    assert max(found) == k and len(found) == 60


def test_waits_grow(spark):
    def client():
        times = []

        def answer(prompt):
            times.append(time.monotonic())
            if len(times) < 4:
                raise RuntimeError("busy")
            return " ".join(f"{b - a:.3f}" for a, b in zip(times, times[1:]))

        return answer

    asked = spark.createDataFrame([("p",)], "prompt string")
    (found,) = prompts.call_model(asked, client, wait=0.1).collect()
    first, second, third = map(float, found["response"].split())
    assert 0.05 <= first and 0.1 <= second and 0.2 <= third


def logging_client(log, stops_at=None):
    """Writes a line per call; a request that is ``stops_at`` ends the task, as a killed process would."""

    def make():
        def answer(system, prompt):
            if prompt == stops_at:
                raise SystemExit("stopped")
            with open(log, "a") as out:
                out.write(prompt + "\n")
            if prompt.endswith("9"):
                raise ValueError("no answer")
            return f"{system} {prompt}"

        return answer

    return make


def test_a_stopped_run_goes_on(spark, tmp_path):
    log = tmp_path / "calls"
    asked = prompts.with_request_id(
        spark.createDataFrame([(i, "s", f"p{i % 200}") for i in range(300)], ASKED)
    )
    ordered = [r["prompt"] for r in prompts.distinct_requests(asked).orderBy("request_id").collect()]
    store = provider.ReplyStore(spark, f"file://{tmp_path}/store", buckets=4)
    with pytest.raises(Exception):
        provider.answer(asked, store, logging_client(str(log), ordered[120]), portion_rows=50, in_flight=3, attempts=1)
    done = store.rows().count()
    assert 90 <= done < 120  # the portions before the one that stopped
    first = Counter(log.read_text().split())
    kept = {r["prompt"] for r in store.rows().join(prompts.distinct_requests(asked), "request_id").collect()}

    again = provider.ReplyStore(spark, f"file://{tmp_path}/store", buckets=4)
    found = provider.answer(asked, again, logging_client(str(log)), retry_failed=False, portion_rows=50, in_flight=3, attempts=1)
    replies = {r["request_id"]: (r["response"], r["error"]) for r in found.collect()}
    assert len(replies) == 200 and sum(e is not None for _, e in replies.values()) == 20
    second = Counter(log.read_text().split())
    second.subtract(first)
    assert {p for p, n in second.items() if n} == set(ordered) - kept
    assert all(second[p] == 1 for p in set(ordered) - kept)

    # All answered: nothing is asked. Failed ones are asked again where that is wanted.
    before = log.read_text()
    provider.answer(asked, again, logging_client(str(log)), retry_failed=False)
    assert log.read_text() == before
    provider.answer(asked, again, logging_client(str(log)), attempts=1)
    assert len(log.read_text().split()) == len(before.split()) + 20


def test_empty_requests(spark, tmp_path):
    store = provider.ReplyStore(spark, f"file://{tmp_path}/store", buckets=4)
    asked = prompts.with_request_id(spark.createDataFrame([], ASKED))
    assert provider.answer(asked, store, logging_client(str(tmp_path / "calls"))).count() == 0


def test_stored_side_is_not_shuffled(spark, tmp_path):
    store = provider.ReplyStore(spark, f"file://{tmp_path}/store", buckets=4)
    asked = prompts.with_request_id(spark.createDataFrame([(i, "s", f"p{i}") for i in range(100)], ASKED))
    store.append(asked.selectExpr("request_id", "prompt AS response", "cast(NULL AS string) AS error"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = prompts.attach_responses(asked, store.replies())
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # the requests
        missing = store.missing(asked)._jdf.queryExecution().executedPlan().toString()
        assert missing.count("Exchange") == 1
        assert joined.filter("answered").count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_rounds_of_variants_over_a_store(spark, rows, tmp_path):
    """A second run over the same store asks nothing."""
    log = str(tmp_path / "calls")

    def client():
        def answer(system, prompt):
            with open(log, "a") as out:
                out.write("call\n")
            source = "one" if "log one" in prompt else "two"
            made = 2 if "- log" in prompt else 1  # the second round names what there is
            return json.dumps([f"log {source} {k}" for k in range(made)])

        return answer

    seeds = spark.createDataFrame(
        [(1, 1, "log one", "log <*>", "why", "T", 1), (2, 1, "log two", "log <*>", "why", "T", 1)],
        "seed_id long, strategy int, Original_Log string, Correct_Template string, error_summary string, Error_Type string, Error_Number int",
    )
    document = spark.createDataFrame([("doc",)], "document string")
    store = provider.ReplyStore(spark, f"file://{tmp_path}/store", buckets=4)
    ask = provider.responder(store, client, in_flight=2)
    expected = [(1, 1, "log one 0"), (1, 2, "log one 0"), (2, 1, "log two 0"), (2, 2, "log two 0")]
    for _ in range(2):
        made = augment.generate_variants(seeds, ask, document, 2)
        assert rows(made, "seed_id", "place", "input") == expected
    assert len(open(log).read().split()) == 4
