import hashlib

import pytest

from parselab.operators import ranking


def ordered(keys, seed=42):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_rank_over_all(spark, digits):
    found = ranking.ranked(spark.range(500), "id", digits=digits).orderBy("rank").collect()
    assert [r["id"] for r in found] == ordered(range(500))
    assert [r["rank"] for r in found] == list(range(1, 501))


def test_rank_in_a_large_stratum(spark):
    df = spark.range(600).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS s")
    for stratum in ("hot", "s3"):
        found = ranking.ranked(df, "id", ["s"], digits=1).filter(f"s = '{stratum}'").orderBy("rank").collect()
        members = [r["id"] for r in df.filter(f"s = '{stratum}'").collect()]
        assert [r["id"] for r in found] == ordered(members)


def test_seed_changes_the_order(spark):
    one, two = [
        [r["id"] for r in ranking.first_n(spark.range(100), "id", 10, seed).collect()] for seed in (1, 2)
    ]
    assert one == ordered(range(100), 1)[:10] and two == ordered(range(100), 2)[:10] and one != two


def test_sample_of_a_small_table(spark):
    assert ranking.sample_rows(spark.range(5), "id", 10).count() == 5
    assert ranking.sample_rows(spark.range(5), "id", None).count() == 5


@pytest.mark.parametrize(
    ("rows", "sample_size", "cap", "size"),
    [(400, 500, 200, 200), (501, 500, 200, 500), (150, 500, 200, 150), (400, None, 300, 300), (10, 4, 300, 4), (0, 4, 3, 0)],
)
def test_capped_size(spark, rows, sample_size, cap, size):
    found = ranking.capped_sample(spark.range(rows), "id", sample_size, cap).orderBy("position").collect()
    assert [r["id"] for r in found] == ordered(range(rows))[:size]


def test_volume_cap(spark):
    found = ranking.volume_cap(spark.range(300), "id", spark.range(70)).collect()
    assert {r["id"] for r in found} == set(ordered(range(300))[:70])
    assert ranking.volume_cap(spark.range(30), "id", spark.range(70)).count() == 30
    assert ranking.volume_cap(spark.range(30), "id", spark.range(0)).count() == 0


def test_frequent_types(spark, rows):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)] * 2, "t string")
    assert set(rows(ranking.frequent_types(df, "t", 2))) == {("a",), ("b",)}


def test_samples_are_not_merged_in_one_task(spark):
    found = ranking.first_n(spark.range(500), "id", 60)
    assert "TakeOrdered" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["id"] for r in found.collect()} == set(ordered(range(500))[:60])


@pytest.mark.parametrize("n", [0, 1, 37, 500, 600])
def test_max_samples(spark, n):
    df = spark.range(500).selectExpr("id % 3 AS a", "id AS b")
    found = ranking.max_samples(df, ["a", "b"], n)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert sorted(tuple(r) for r in found.collect()) == sorted((i % 3, i) for i in range(500))[:n]


def test_cutoff_before_the_shuffle(spark):
    """Few rows beyond the first n pass the bound, and the first n all do; ties and nulls included."""
    df = spark.range(200_000).selectExpr("if(id % 1000 = 7, null, id * 7919 % 100003) AS a", "cast(id % 3 AS string) AS b", "id")
    keys = df.select("a", "b")
    below = ranking.cutoff(keys, 2000, sampled=20_000)
    assert below is not None
    kept = df.filter(below)
    assert 2000 <= kept.count() < 6000
    first = [r["id"] for r in df.orderBy("a", "b", "id").limit(2000).collect()]
    assert [r["id"] for r in ranking.max_samples(df, ["a", "b", "id"], 2000).orderBy("a", "b", "id").collect()] == first
    assert ranking.cutoff(keys, 100_000) is None  # hardly larger than n
    assert ranking.max_samples(df.limit(0), ["a"], 5).count() == 0
