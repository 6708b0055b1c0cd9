from parselab.operators import scoring
from parselab.streaming import live

SCHEMA = "system string, row_id long, Content string, EventTemplate string, response string"


def arrive(spark, path, system, start, n):
    rows = [(system, k, f"c{k}", "t", "TEMPLATE: t" if k % 3 else "other") for k in range(start, start + n)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_files_are_scored_once(spark, tmp_path, rows):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def run():
        stream = live.read_stream(spark, source, spark.createDataFrame([], SCHEMA).schema)
        live.stream_scoring(stream, out, progress, once=True).awaitTermination()
        return spark.read.parquet(out)

    arrive(spark, source, "a", 0, 10)
    assert run().count() == 10
    arrive(spark, source, "b", 10, 5)
    assert run().count() == 15  # the restart does not score the first file again
    assert run().count() == 15
    batch = scoring.score(spark.read.parquet(source))
    assert rows(run(), "row_id", "outcome", "Prediction") == rows(batch, "row_id", "outcome", "Prediction")


def test_accuracy_goes_on(spark, tmp_path, rows):
    source, progress = (str(tmp_path / n) for n in ("in", "progress"))
    seen = []

    def run():
        stream = live.read_stream(spark, source, spark.createDataFrame([], SCHEMA).schema)
        note = lambda batch, number: seen.append(rows(batch, "system", "processed"))
        live.stream_accuracy(scoring.score(stream), progress, once=True, on_update=note).awaitTermination()
        return rows(live.latest_accuracy(spark, progress), "system", "processed", "correct")

    arrive(spark, source, "a", 0, 6)
    assert run() == [("a", 6, 4)]
    arrive(spark, source, "a", 6, 3)
    arrive(spark, source, "b", 0, 3)
    assert run() == [("a", 9, 6), ("b", 3, 2)]
    arrive(spark, source, "b", 3, 3)
    assert run() == [("a", 9, 6), ("b", 6, 4)]
    assert seen == [[("a", 6)], [("a", 9), ("b", 3)], [("b", 6)]]  # only what a batch changed
    assert [r["accuracy"] for r in live.latest_accuracy(spark, progress).orderBy("system").collect()] == [6 / 9 * 100, 4 / 6 * 100]
