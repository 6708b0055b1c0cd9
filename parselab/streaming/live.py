"""Scoring of files as they arrive, and the accuracy so far."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parselab.operators.scoring import accuracy, percent, score


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def stream_scoring(arriving: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append scored rows to a parquet table, exactly once per input file.

    A restart goes on from ``checkpoint``, so rows already done are not scored again.
    """
    writer = score(arriving).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def stream_accuracy(
    scored: DataFrame,
    checkpoint: str,
    by: str = "system",
    once: bool = False,
    on_update: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Keep counts per system as keyed state below ``checkpoint``; ``latest_accuracy`` reads them there.

    A batch touches the keys that it has rows of. ``on_update`` gets their new counts and the batch's number (the same ones again
    after a restart, so it should write by key); without it nothing is written but the state, of which Spark keeps
    the last ``spark.sql.streaming.minBatchesToRetain`` versions, so files do not grow with batches.
    """
    writer = accuracy(scored, [by]).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.format("noop") if on_update is None else writer.foreachBatch(on_update)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_accuracy(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The counts after the last finished batch, a row per key, from the state itself."""
    state = spark.read.format("statestore").load(checkpoint)
    counts = F.col("value").cast("struct<processed: bigint, correct: bigint>")
    kept = state.select("key.*", counts.alias("counts")).select("*", "counts.*").drop("counts")
    return kept.withColumn("accuracy", percent(F.col("correct"), F.col("processed")))
