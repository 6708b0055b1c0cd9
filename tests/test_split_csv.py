"""CSV files read in splits of some bytes, against the reader that takes a file as a whole."""

import csv
import random

import pytest

from parselab.sources import files, split_csv


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield use
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def cells(rng):
    pieces = ["a", "bc", ",", '"', '""', "\n", "\r\n", " ", "\u00e9", "NA", "x" * 40, "\n\n", '"\n"']
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 8)))


def written(path, rows, end):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(["one", "two\nlines"])
        writer.writerows(rows)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [7, 61, 1 << 20])
def test_splits_give_the_same_cells(spark, tmp_path, rows, small_splits, end, size):
    rng = random.Random(size)
    made = [[(cells(rng), cells(rng) or "z") for _ in range(rng.randrange(1, 40))] for _ in range(3)]
    made.append([("long " + "line\n" * 60, "t")])
    (tmp_path / "in").mkdir()
    for k, own in enumerate(made):
        written(tmp_path / "in" / f"{k}.csv", own, end)
    (tmp_path / "in" / "empty.csv").write_text("")
    path = str(tmp_path / "in")
    expected = sorted(((a or None, b) for own in made for a, b in own), key=repr)
    if end == "\n":
        assert rows(files.read_csv(spark, path, ["one", "two"], split=False)) == expected
    small_splits(size)
    found = files.read_csv(spark, path, ["one", "two"])
    assert rows(found) == expected
    if size == 61:
        assert split_csv._lines(spark, path).select("file", "start").distinct().count() > 20


def test_one_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    written(tmp_path / "logs.csv", [(f"line {k}\nmore", "t") for k in range(2000)], "\n")
    small_splits(4096)
    found = files.read_csv(spark, str(tmp_path / "logs.csv"), ["one", "two"])
    assert found.count() == 2000
    assert split_csv._lines(spark, str(tmp_path / "logs.csv")).rdd.getNumPartitions() > 3
