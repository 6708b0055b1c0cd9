import pytest

from parselab.functions import replies
from parselab.operators import augment, labels
from pyspark.sql import functions as F


@pytest.fixture
def types(spark):
    return spark.createDataFrame([(1, "One"), (2, "Two")], "number int, title string")


@pytest.mark.parametrize(
    ("reply", "expected"),
    [
        ('{"label": 2, "error_type": "Own"}', ("Own", 2)),
        ('{"label": 2, "error_type": ""}', ("Two", 2)),
        ('{"label": 2, "error_type": null}', ("Two", 2)),
        ('{"label": 2, "error_type": 0}', ("Two", 2)),
        ('{"label": 2, "error_type": false}', ("Two", 2)),
        ('{"label": 2, "error_type": []}', ("Two", 2)),
        ('{"label": 2, "error_type": {}}', ("Two", 2)),
        ('{"label": 2, "error_type": "0"}', ("0", 2)),
        ('{"label": 2, "error_type": "[]"}', ("[]", 2)),
        ('{"label": 2, "error_type": 5}', ("5", 2)),
        ('{"label": 1.0}', ("One", 1)),
        ('{"label": true}', ("One", 1)),
        ('{"label": 1.5}', ("Invalid_Label", 0)),
        ('{"label": "2"}', ("Invalid_Label", 0)),
        ('{"label": null}', ("Invalid_Label", 0)),
        ('{"label": [2]}', ("Invalid_Label", 0)),
        ('{"error_type": "x"}', ("Invalid_Label", 0)),
        ('{"label": 12345678901234567890}', ("Invalid_Label", 0)),
        ('a {"label": 2} {"label": 3} b', ("JSON_Parse_Error", 0)),
        ('{"label": 2}, {"label": 3}', ("JSON_Parse_Error", 0)),
        ("{'label': 2}", ("JSON_Parse_Error", 0)),
        ("{}", ("JSON_Parse_Error", 0)),
        ("} then {", ("JSON_Parse_Error", 0)),
        ("no braces", ("No_JSON_Found", 0)),
        ("only { one", ("No_JSON_Found", 0)),
        (" \n ", ("Empty_Response", 0)),
        (None, ("No_Response", 0)),
    ],
)
def test_label(spark, types, reply, expected):
    df = spark.createDataFrame([(reply, True)], "response string, answered boolean")
    (row,) = labels.parse_label(df, types).collect()
    assert (row["Error_Type"], row["Error_Number"]) == expected


def test_failed_call(spark, types):
    df = spark.createDataFrame([(None, False)], "response string, answered boolean")
    (row,) = labels.parse_label(df, types).collect()
    assert (row["Error_Type"], row["Error_Number"]) == ("API_Error", 0)


def variants(spark, strategy, reply, **options):
    df = spark.createDataFrame(
        [(1, strategy, "src", "t <*>", reply)],
        "seed_id long, strategy int, Original_Log string, Correct_Template string, response string",
    )
    return [tuple(r)[2:] for r in augment.parse_variants(df, **options).orderBy("pos").collect()]


def test_substitution_keeps_strings_only(spark):
    assert variants(spark, 1, 'x ["a b", 5, " \'c\' ", null, "src", ["d"]] y') == [("a b", "t <*>"), ("c", "t <*>")]


@pytest.mark.parametrize("reply", ['["a", b]\n```json\n/* c */\n long line ', '["a"] and ["b"]\n long line '])
def test_substitution_falls_back_to_lines(spark, reply):
    assert variants(spark, 1, reply)[1:] == [("long line", "t <*>")]


def test_empty_reply(spark):
    for strategy in (1, 2, 3):
        assert variants(spark, strategy, "") == []
        assert variants(spark, strategy, None) == []
        assert variants(spark, strategy, "[]") == []


def test_rewrite(spark):
    reply = '[{"example": " a ", "template": "b"}, {"example": "src", "template": "b"}, {"example": "c"}, 1]'
    assert variants(spark, 2, reply) == [("a", "b")]


def test_wrong_type_fails_the_whole_reply(spark):
    reply = '[{"example": "a", "template": "b"}, {"example": "c", "template": null}]'
    assert variants(spark, 3, reply) == [(reply, "t <*>")]


def test_loose_objects(spark):
    reply = 'a {"example": "x1", "template": "y1"} b {"example": 3, "template": "y"} {"example": "x2", "z": 1, "template": "y2"}'
    assert variants(spark, 2, reply) == [("x1", "y1"), ("x2", "y2")]


def test_only_identical_loose_objects_fall_back(spark):
    reply = '{"example": "src", "template": "y1"}'
    assert variants(spark, 2, reply) == [(reply, "t <*>")]


def test_error_type_is_kept_on_request(spark):
    reply = '[{"example": "a", "template": "b", "error_type": 4}]'
    assert variants(spark, 3, reply) == [("a", "b")]
    assert variants(spark, 3, reply, keep_error_type=True) == [("a", "b", 4)]


def test_line_candidates_are_rows(spark):
    df = spark.createDataFrame([(1, "```\n  a line here \n*/ no\nshort\n\nsecond line")], "id int, t string")
    found = augment.line_candidates(df, "t", ["id"]).orderBy("pos").collect()
    assert [r["candidate"] for r in found] == ["a line here", "second line"]


def test_brackets_that_never_close(spark):
    assert variants(spark, 1, "[" * 5000 + "\nlong line")[-1] == ("long line", "t <*>")
    assert variants(spark, 1, "] a long line [") == [("] a long line [", "t <*>")]


def test_a_repeated_key_has_its_last_value(spark):
    rows = [('{"label": 9, "label": 3, "error_type": "a", "error_type": "b"}', 3, "b"), ('{"label": 3, "label": "x"}', None, None),
            ('{"a": {"label": 1, "label": 2}, "label": 5, "error_type": "c"}', 5, "c")]
    df = spark.createDataFrame(rows, "text string, label int, named string")
    read = df.withColumn("json", replies.parse_single(F.col("text")))
    found = read.select("label", "named", replies.label_number(F.col("json")).alias("n"), replies.label_text(F.col("json")).alias("t"))
    assert [(r["n"], r["t"]) for r in found.collect()] == [(r[1], r[2]) for r in rows]
