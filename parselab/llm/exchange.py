"""Blocks of rows that ask one another for counts: one row per block, sorted hashes dealt to buckets, answers joined back by block."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parselab.session import new_path

MOST_BUCKETS = 100_000  # Spark's own bound for bucketed tables


@contextmanager
def block_table(blocks: DataFrame, buckets: int) -> Iterator[DataFrame]:
    """``blocks`` (one row per ``block``) as a table bucketed by ``block``, so that joins on it move the other side only.

    Its files lie below the shared folder and stay; its name goes at the end.
    """
    spark, name = blocks.sparkSession, f"blocks_{uuid.uuid4().hex}"
    place = new_path(spark, "blocks")
    of_bucket = blocks.write.format("parquet").bucketBy(max(1, min(buckets, MOST_BUCKETS)), "block").option("path", place)
    of_bucket.saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each block with the rows of ``answers`` (block, ...) for it as one array; only the answers are shuffled."""
    names = [c for c in answers.columns if c != "block"]
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct(*names)).alias("answers"))
    return blocks.join(gathered, "block", "left")


def pack(ascending: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers as the byte planes of their differences, without the planes that are zero."""
    return planes(np.diff(ascending, prepend=np.uint64(0)))


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(numbers(data, n), dtype=np.uint64)


def planes(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers as byte planes, without the planes that are zero."""
    found = values.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = int(np.flatnonzero(found.any(axis=1)).max(initial=-1)) + 1
    return found[:used].tobytes()


def numbers(data: bytes, n: int) -> np.ndarray:
    whole = np.zeros((n, 8), np.uint8)
    if n:
        found = np.frombuffer(data, np.uint8).reshape(-1, n)
        whole[:, : len(found)] = found.T
    return whole.view("<u8")[:, 0]


def groups(ascending: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(ascending):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], ascending[1:] != ascending[:-1])))
