import pytest

from parselab.operators import taxonomy

DOC = """# Types

#### A. Path. Split
- The path is split
second line
- Example errors:
  - "one"
  - "two
  - three
#### B. Hash
- Holds a # sign
- Example errors: "inline 1" and "inline 2"
  - "below"

#### c. lower case
- text
#### A. Path again
- Newer
#### AB. no letter
- x
#### D. No dash
text
"""


@pytest.fixture
def doc(spark):
    return spark.createDataFrame([(1, DOC)], "doc_id int, text string")


def test_headings(doc, rows):
    found = taxonomy.read_taxonomy(doc, by=["doc_id"])
    assert [r[:2] for r in rows(found, "number", "title")] == [
        (1, "Path again"),
        (2, "Hash"),
        (3, "lower case"),
        (4, "No dash"),
    ]
    assert [r["number"] for r in found.orderBy("pos").collect()] == [1, 2, 3, 4]


def test_blocks_observed(doc):
    found = {r["letter"]: r for r in taxonomy.read_taxonomy_blocks(doc).collect()}
    assert set(found) == {"A"}
    assert (found["A"]["title"], found["A"]["description"], found["A"]["examples"]) == ("Path again", "Newer", [])


def test_blocks_first_occurrence(spark):
    first = DOC.split("#### B.")[0]
    df = spark.createDataFrame([(first,)], "text string")
    (row,) = taxonomy.read_taxonomy_blocks(df).collect()
    assert (row["description"], row["examples"]) == ("The path is split second line", ["one", "two"])


def test_blocks_intended(doc):
    found = {r["letter"]: r for r in taxonomy.read_taxonomy_blocks(doc, mode="intended").collect()}
    assert set(found) == {"A", "B"}
    assert found["B"]["description"] == "Holds a # sign"
    assert found["B"]["examples"] == ["inline 1", "inline 2", "below"]


def types(spark, n):
    return spark.createDataFrame(
        [(k, f"T{k}", f"about {k}", ["e"] if k % 2 else []) for k in range(n)],
        "pos int, title string, description string, examples array<string>",
    )


def test_reletter_goes_past_z(spark):
    found = taxonomy.reletter(types(spark, 28)).orderBy("number").collect()
    assert (found[0]["letter"], found[25]["letter"], found[26]["letter"], found[27]["number"]) == ("A", "Z", None, 28)


def test_document_names_the_real_threshold(spark):
    blocks = taxonomy.taxonomy_blocks(taxonomy.reletter(types(spark, 2)), threshold=0.8)
    (row,) = taxonomy.document_text(blocks).collect()
    head, body = row["document"].split("categories:\n\n")
    assert "similarity > 0.8 have" in head and "threshold: 0.8" in head
    assert body == '#### A. T0\n- about 0\n\n#### B. T1\n- about 1\n- Example errors:\n  - "e"\n\n'


def test_written_document_reads_back(spark, tmp_path, rows):
    from parselab.sources import files

    named = taxonomy.reletter(types(spark, 5))
    path = str(tmp_path / "doc")
    files.write_blocks(taxonomy.taxonomy_blocks(named), path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    text = spark.createDataFrame([("\n".join(lines),)], "text string")
    assert rows(taxonomy.read_taxonomy_blocks(text), "letter", "title", "description") == rows(
        named, "letter", "title", "description"
    )


def test_options_follow_first_place(spark):
    df = spark.createDataFrame([(3, "C", 0), (1, "A", 1), (30, "X", 2)], "number int, title string, pos int")
    (row,) = taxonomy.option_text(df).collect()
    assert tuple(row) == ("3 (C): C\n1 (A): A\n30 (30): X\n", 3)


def test_embed_text(spark, rows):
    df = spark.createDataFrame(
        [("T", "d", ["a", "b", "c"]), ("U", "", [])], "title string, description string, examples array<string>"
    )
    assert rows(taxonomy.embed_text(df), "embed_text") == [("T d a b",), ("U ",)]


def test_analysis_document(spark):
    overview = spark.createDataFrame([(9, 7, 5)], "total int, valid int, sampled int")
    reply = spark.createDataFrame([("#### A. T",)], "response string")
    (row,) = taxonomy.analysis_document(reply, overview, "s.csv", "m").collect()
    assert "based on 5 error summaries\nModel used: m\n" in row["document"]
    assert row["document"].endswith("- Analysis sample size: 5\n\n---\n\n## Error Type Classification\n\n#### A. T")


def test_long_block(spark):
    """A block of many lines and many signs parses without deep recursion."""
    body = "\n".join(f"line {n} # sign" for n in range(20_000))
    df = spark.createDataFrame([(f"#### A. T\n- {body}\n#### B. U\n- x\n",)], "text string")
    found = {r["letter"]: r for r in taxonomy.read_taxonomy_blocks(df, mode="intended").collect()}
    assert set(found) == {"A", "B"} and found["A"]["description"].endswith("line 19999 # sign")
    assert {r["letter"] for r in taxonomy.read_taxonomy_blocks(df).collect()} == {"B"}
