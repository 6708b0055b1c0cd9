"""CSV with line ends in cells, read by many tasks: quotes are counted per split, and a prefix parity tells which splits start in a cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS = "file string, start bigint, kind int, record string"
WHOLE, HEAD, TAIL, HEADER = 0, 1, 2, 3  # HEADER: the beginning of a header that goes on behind its split


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files with the split (file and first byte) that they lie in, in their order within it."""
    read = spark.read.text(path, lineSep="\n")
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def starts_inside(lines: DataFrame) -> DataFrame:
    """file, start, inside: whether the split begins within a quoted cell, by the parity of all quotes before it."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)  # a row per split
    return counted.select("file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _assemble(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split, the end of one that began before it (head), and the beginning of one that goes on behind it (tail).

    The first record of a file, its header, is left out.
    """
    split, inside, kind, held = None, False, WHOLE, []
    out: dict[str, list] = {"file": [], "start": [], "kind": [], "record": []}
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])

    def put(what: int) -> None:
        for column, value in zip(out.values(), (*split, what, "\n".join(held)), strict=True):
            column.append(value)

    def end_split() -> None:
        if held:
            put({WHOLE: TAIL}.get(kind, kind))
            held.clear()

    for part in parts:
        odd = np.asarray(pc.count_substring(part.column("value"), '"')) % 2 == 1
        names = ("file", "start", "inside", "value")
        for file, start, begins_inside, value, turns in zip(*(part.column(c).to_pylist() for c in names), odd.tolist(), strict=True):
            if (file, start) != split:
                end_split()
                split, inside = (file, start), begins_inside
                kind = HEAD if inside else HEADER if start == 0 else WHOLE
            held.append(value)
            inside ^= turns
            if not inside:
                if kind != HEADER:
                    put(kind)
                held.clear()
                kind = WHOLE
        if out["file"]:
            yield pa.RecordBatch.from_pydict(out, schema=schema)
            for column in out.values():
                column.clear()
    end_split()
    if out["file"]:
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per CSV record (``record``) of the files below ``path``, without their headers.

    Splits are read by as many tasks; records within one are put together where they are read. What crosses the end of a split, two pieces
    a split at most, is joined in the order of the file. Records end in a line feed, with or without a carriage return before it; a
    quote stands only in a quoted cell, doubled there. The number of splits bounds what is broadcast.
    """
    lines = _lines(spark, path)
    placed = lines.join(F.broadcast(starts_inside(lines)), ["file", "start"])  # keeps the order of the lines
    found = placed.select("file", "start", "inside", "value").mapInArrow(_assemble, RECORDS)
    whole = found.filter(F.col("kind") == WHOLE).select("record")
    pieces = found.filter(F.col("kind") != WHOLE)
    chain = F.sum((F.col("kind") >= TAIL).cast("int")).over(W.partitionBy("file").orderBy("start", "kind"))
    parts = F.array_sort(F.collect_list(F.struct("start", "kind", "record")))
    joined = pieces.withColumn("chain", chain).groupBy("file", "chain").agg(parts.alias("parts"))
    crossing = joined.filter(F.col("parts")[0]["kind"] == TAIL).select(
        F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")
    )
    every = whole.unionByName(crossing).select(F.regexp_replace("record", r"\r\z", "").alias("record"))
    return every.filter("record <> ''")


def read(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """The cells of ``records``, read as Spark reads them; through a generator, so that a record is read once for all its cells."""
    cells = F.from_csv("record", F.lit(schema.simpleString()), {**options, "multiLine": "true", "header": "false"})
    return records(spark, path).select(F.inline(F.array(cells)))
