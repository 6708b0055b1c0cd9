import pytest
from pyspark.sql import functions as F

from parselab.functions import text
from parselab.operators import summaries


def run(spark, function, values):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, t string")
    out = df.withColumn("r", function(F.col("t"))).orderBy("n").collect()
    return [r["r"] for r in out]


def summarised(spark, values, mode="observed"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, response string")
    return [r["error_summary"] for r in summaries.with_summary(df, mode=mode).orderBy("n").collect()]


def test_strip_is_unicode(spark):
    assert run(spark, text.strip, ["\N{NO-BREAK SPACE}\N{EM SPACE} a b \t", " \x1c\n", None]) == ["a b", "", None]


def test_removed_token_exposes_the_next(spark):
    assert run(spark, text.strip_markers, ["a<s<unk>>b", "<|user|>x<|im_end|>"]) == ["ab", "x"]


def test_marker_is_added_once_and_case_counts(spark):
    lower = "template: x\n  a <*> b  \nc <*>"
    assert run(spark, text.inject_marker, [lower, "TEMPLATE: a <*>", "  no wildcard "]) == [
        lower + "\n\nTEMPLATE: a <*> b\n\n\n\n",
        "TEMPLATE: a <*>\n\n\n\n",
        "no wildcard\n\n\n\n",
    ]


@pytest.mark.parametrize(
    ("output", "template", "tier"),
    [
        ("x\nTemplate: 'a <*>' \nTEMPLATE: second", "a <*>", 1),
        ("TEMPLATE:\n\n  next line\nmore", "next line", 1),
        ("text\nTEMPLATE:", "", 1),
        ("TEMPLATE: `a` **b**", "`a` **b**", 1),
        ("TEMPLATE: a\N{LINE SEPARATOR}b\nc", "a\N{LINE SEPARATOR}b", 1),
        ("TEMPLATE:\N{NO-BREAK SPACE}a", "a", 1),
        ("TEMPLATE: \r\na\rb", "a", 1),
        ("My FINAL template is x\ny", "is x", 2),
        ("the log template a and template b", "a and template b", 2),
        ("the template is c", "is c", 2),
        ("intro\n output: user <*> in\nend", "user <*> in", 3),
        ("a<*>b\n" + "x" * 300 + "<*>\nlong enough <*>", "long enough <*>", 3),
        ("  first \nsecond", "first", 4),
        ("\nsecond", "\nsecond", 5),
        ("", "", 5),
    ],
)
def test_template_tiers(spark, output, template, tier):
    assert [tuple(r) for r in run(spark, text.extract_template, [output])] == [(template, tier)]


def test_reasoning_is_cleaned(spark):
    given = ["a</think>b", "a```x\ny```b```z```", "## Step 12: do\nrest", "$\\boxed{a\nb}$ \\boxed{c} $\\boxed{d}"]
    assert run(spark, text.clean_reasoning, given) == ["a b", "a b ", " rest", "a\nb c d"]


def test_summary_modes(spark):
    reply = 'Why.\n\nerror_summary: one\n\nerror_summary: "Two  X" '
    assert summarised(spark, [reply, "", "  \n \n", None]) == ['error_summary: "Two  X"', "", "", ""]
    intended = summarised(spark, [reply, "A\n \N{NO-BREAK SPACE} \nB", "x\n\nerror_summary: "], "intended")
    assert intended == ["two x", "B", "error_summary:"]


def test_long_summary_is_cut(spark):
    assert summarised(spark, ["a" * 1001, "a" * 1000]) == ["a" * 997 + "...", "a" * 1000]


def test_missing_value_fills_as_nan(spark):
    assert run(spark, lambda c: text.fill("<{x}> {y}", x=c), ["a{x}", None]) == ["<a{x}> {y}", "<nan> {y}"]


def test_long_lines_cost_one_pass(spark):
    """Lines of 200 000 characters, without and with a wildcard, and brackets that never close."""
    wide = "word " * 40_000
    given = [wide + "\n" + wide + "<*>", wide, "[" * 3000 + wide]
    marked = run(spark, text.normalise_output, given)
    assert marked[0].endswith("<*>\n\n\n\n") and marked[0].count("TEMPLATE: word") == 1
    assert marked[1] == wide.strip() + "\n\n\n\n"
    assert [r["tier"] for r in run(spark, text.extract_template, marked)] == [1, 4, 4]
