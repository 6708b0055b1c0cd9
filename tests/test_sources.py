import csv
import json

import pytest

from parselab.functions import fixed
from parselab.operators import summaries
from parselab.session import is_local, new_path, shared_dir
from parselab.sources import files

CELLS = [
    ['line one\nline "two"', "t <*>"],
    ["007", " padded "],
    ["null", "NA"],
    ["", "comma, here"],
    ["caf\N{LATIN SMALL LETTER E WITH ACUTE}\N{NO-BREAK SPACE} x", "t"],
]


@pytest.fixture
def log_file(tmp_path):
    path = tmp_path / "logs.csv"
    with open(path, "w", newline="", encoding="utf-8") as handle:
        writer = csv.writer(handle)
        writer.writerow(fixed.LOG_COLUMNS)
        writer.writerows(CELLS)
    return str(path)


def test_csv_cells_stay_text(spark, log_file):
    found = [tuple(r) for r in files.read_logs(spark, log_file).collect()]
    assert found == [tuple(c or None for c in row) for row in CELLS]


def test_words_for_missing(spark, log_file):
    found = [tuple(r) for r in files.read_logs(spark, log_file, na=True).collect()]
    assert found[2] == (None, None) and found[3] == (None, "comma, here") and found[1] == ("007", " padded ")


def test_round_trip(spark, tmp_path, log_file, rows):
    logs = files.read_logs(spark, log_file)
    for write in (files.overwrite_csv, files.append_csv):
        path = str(tmp_path / write.__name__)
        write(logs, path)
        assert rows(files.read_csv(spark, path, fixed.LOG_COLUMNS, na=True)) == rows(
            files.read_logs(spark, log_file, na=True)
        )
    files.append_csv(logs, path)
    assert files.read_csv(spark, path, fixed.LOG_COLUMNS).count() == 2 * len(CELLS)


def test_appended_cells_are_quoted(spark, tmp_path):
    path = str(tmp_path / "out")
    files.append_csv(spark.createDataFrame([("a", "1")], "x string, y string").coalesce(1), path)
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert text == '"x","y"\n"a","1"\n'


def test_contract(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", None), ("b", "c")], "Content string, EventTemplate string")
    report = files.required_columns(df, ["Content", "EventTemplate", "Error_Type"])
    assert rows(report) == [("Content", True, 2, 0), ("Error_Type", False, 2, 2), ("EventTemplate", True, 2, 1)]
    path = str(tmp_path / "p")
    df.drop("EventTemplate").write.parquet(path)
    with pytest.raises(ValueError, match="EventTemplate"):
        files.read_logs(spark, path, fmt="parquet")


def test_parquet_tolerates_more_columns(spark, tmp_path, rows):
    path = str(tmp_path / "p")
    spark.createDataFrame([("a", "t", 1)], "Content string, EventTemplate string, extra int").write.parquet(path)
    assert rows(files.read_logs(spark, path, fmt="parquet")) == [("a", "t")]


def test_tuning_json(spark, tmp_path):
    path = tmp_path / "t"
    df = spark.createDataFrame([("i", 'a "q" é', "<*>")], "instruction string, input string, output string")
    files.write_tuning(df, str(path))
    (line,) = [t for p in path.glob("part-*") for t in p.read_text(encoding="utf-8").splitlines()]
    assert json.loads(line) == {"instruction": "i", "input": 'a "q" é', "output": "<*>"}
    assert "é" in line


def test_documents_are_rows(spark, tmp_path):
    for name in ("a.md", "b.md"):
        (tmp_path / name).write_text("#### A. T\n- d\n")
    assert [r["text"] for r in files.read_documents(spark, str(tmp_path)).collect()] == ["#### A. T\n- d\n"] * 2


def test_row_filters(spark, rows):
    df = spark.createDataFrame(
        [("a", "b"), (None, "b"), ("", "b"), (" ", "b")], "Content string, `Think-Process` string"
    )
    whole = summaries.drop_null_rows(df, ["Content", "Think-Process"])
    assert len(rows(whole)) == 3
    assert rows(summaries.drop_empty_rows(whole, ["Content", "Think-Process"])) == [(" ", "b"), ("a", "b")]
    texts = spark.createDataFrame([("  12345678901 ",), (" 1234567890 ",), (None,)], "error_summary string")
    assert rows(summaries.clean_summaries(texts)) == [("12345678901",)]


def test_shared_folder(spark):
    assert new_path(spark, "x").startswith(shared_dir(spark) + "/x-")
    assert new_path(spark, "x") != new_path(spark, "x")


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
    for master in ("local-cluster[2,1,1024]", "yarn", "k8s://x"):
        assert not is_local(master)
    assert is_local("local") and is_local("local[8]")
