"""What the operators share: input tables, batches of texts, written intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def batches(per_batch: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch], schema: str, done=None):
    """A function for ``mapInArrow``: columns by name in, columns in the order of ``schema`` out; ``done()`` ends a task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                made = per_batch(part)
                yield pa.RecordBatch.from_pydict(made, schema=out) if isinstance(made, dict) else made
        if done is not None:
            done()

    return run


def mapped(df: DataFrame, per_batch, schema: str, done=None) -> DataFrame:
    return df.mapInArrow(batches(per_batch, schema, done), schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside send Python at most ``rows`` rows at a time, for rows that may be large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def texts(part: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in part.column(column).to_pylist()]


def portions(values: list[str], chars: int = 8_000_000) -> Iterator[list[str]]:
    """Runs of texts of about so many characters, to bound what is held for them at a time."""
    some, size = [], 0
    for value in values:
        some.append(value)
        size += len(value)
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


class BitTable:
    """A broadcast table of ``bits`` bits, one set for each of some 64-bit hashes.

    Its size does not grow with the data; a fuller table lets more rows through and never keeps one back, so it may only stand
    before an exact join.
    """

    def __init__(self, hashes: DataFrame, column: str, bits: int = 1 << 26):
        words = (
            hashes.select((F.col(column).bitwiseAND(F.lit(bits - 1))).alias("slot"))
            .groupBy(F.expr("shiftrightunsigned(slot, 5)").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 31 AS int)))").alias("bits"))
            .toArrow()
        )
        table = np.zeros(bits // 32, np.uint32)
        table[words["word"].to_numpy()] = words["bits"].to_numpy()
        self.mask = bits - 1
        self.sent = hashes.sparkSession.sparkContext.broadcast(table)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether the bit of each hash is set."""
        slot = (hashes.astype(np.uint64) & np.uint64(self.mask)).astype(np.int64)
        return (self.sent.value[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1) != 0

    def rows(self, df: DataFrame, column: str, among: bool = True) -> DataFrame:
        """The rows whose hash in ``column`` (not null) may be among the hashes, or those whose hash surely isn't."""

        def run(parts):
            for part in parts:
                keep = self.holds(part.column(column).to_numpy(zero_copy_only=False)) == among
                yield part.filter(pa.array(keep, pa.bool_()))

        return df.mapInArrow(run, df.schema)
