"""Packing: documents into sequences of a fixed number of tokens, by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parselab.llm.common import mapped, portions, texts
from parselab.llm.fit import best_fit_decreasing, cut
from parselab.llm.token_ids import WordIds, once
from parselab.session import written

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
GROUP = 50_000
PORTION = 2_000_000  # characters whose words are held at a time, some ten times their size


def document_ids(values: list[str], tokenizer: str, end: int) -> Iterator[bytes]:
    """Ids of each text and the end id, as little-endian unsigned 32-bit numbers."""
    last = np.array([end], "<u4").tobytes()
    for some in portions(values, PORTION):
        for ids in once(WordIds, tokenizer).encode(some):
            yield ids + last


def pieces(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 2, capacity: int = 4096
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's full windows and its rest."""

    def per_batch(part: pa.RecordBatch) -> dict[str, list]:
        keys = part.column("doc_id").to_pylist()
        out: dict[str, list] = {name.split()[0]: [] for name in PIECES.split(", ")}
        for key, ids in zip(keys, document_ids(texts(part), tokenizer, end), strict=True):
            n = len(ids) // 4
            for start, length in cut(n, capacity):
                row = key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
        return out

    read = df.selectExpr(f"cast(`{key}` as bigint) AS doc_id", f"`{text}` AS text")
    return mapped(read, per_batch, PIECES, lambda: once(WordIds, tokenizer).clear())


def pack(
    df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end: int = 2, capacity: int = 4096,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece: the columns of ``PIECES``, sequence_id and offset.

    Pieces carry lengths and checksums only. They are written once, dealt at random (with a fixed seed) to groups of about
    ``group`` pieces, however many there are, and packed group by group, so equal keys and texts spread like any other
    rows, and at most a few windows a group stay open. Every document has at least its end id: null and empty texts
    are pieces of one id. An empty table gives no rows; repeated rows are packed each; other columns are not read.
    """
    made = written(pieces(df, tokenizer, key, text, end, capacity), "pieces")
    groups = max(1, -(-made.count() // group))
    dealt = made.withColumn("pack", F.floor(F.rand(7) * groups).cast("bigint"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        window, offset = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="pack").assign(sequence_id=(rows["pack"].to_numpy() << 32) + window, offset=offset)

    return dealt.groupBy("pack").applyInPandas(one, f"{PIECES}, sequence_id bigint, offset bigint")
