"""Passages of one to six words."""

from parselab.operators import passages as passage_search
from parselab.operators import scoring


def test_short_passages(spark, rows):
    words = "one two three four five six seven eight".split()
    passages = [(k, " ".join(words[:k])) for k in range(1, 8)] + [(9, None), (10, "no such")]
    texts = [(k, "x" + " ".join(words[:k]) + "y") for k in range(1, 9)] + [(20, None), (21, ""), (22, "ONE two")]
    found = scoring.passage_leaks(
        spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, text string")
    )
    assert rows(found) == sorted(
        ((i, k) for i, t in texts for k, p in passages if t is not None and p is not None and p in t), key=repr
    )


def test_automaton_in_pieces_and_without_cross_join(spark, rows):
    texts = [(i, f"ab{'c' * i} xyz {i}") for i in range(12)] + [(50, None), (51, "")]
    passages = [(k, t) for k, t in enumerate(["a", "b", "abc", "bc", "cc", "z 1", "xyz 11", "", None, "é", "abc", "c xyz"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame(passages, "item_id long, text string")
    expected = sorted(((i, k) for i, t in texts for k, p in passages if t and p and p in t), key=repr)
    for size in (4_000_000, 5, 1):
        assert rows(passage_search.passage_leaks(docs, items, piece_chars=size)) == expected
    plan = passage_search.passage_leaks(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert passage_search.passage_leaks(docs, items.limit(0)).count() == 0
