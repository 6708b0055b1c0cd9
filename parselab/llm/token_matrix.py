"""Packed token ids as a binary matrix, with cumulative segment lengths and position resets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from parselab.llm.common import mapped, portions, texts
from parselab.llm.fit import best_fit_decreasing, cut
from parselab.llm.token_ids import RankIds, once

ROWS = (
    "sequence_id bigint, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>,"
    " doc_ids array<bigint>, starts array<bigint>"
)


def matrix_rows(
    df: DataFrame, ranks: str, pattern: str, end: int, key: str = "doc_id", text: str = "text",
    capacity: int = 4096, buffered: int = 8_000_000,
) -> DataFrame:
    """One row per sequence.

    ``ids``: ``capacity`` little-endian unsigned 16-bit ids (32-bit for larger vocabularies), filled up with ``end``.
    ``cu_seqlens``: 0 and the end of each segment. ``position_resets``: where positions start again from 0, i.e. the
    first id of each segment and of the filling. ``doc_ids``, ``starts``: document of each segment, and its ids before it.

    Ids never leave the task that made them: a task packs buffers of at least ``buffered`` ids best-fit decreasing and
    writes them out, so nothing is shuffled and memory is bounded. Full windows of an overlong document take a sequence
    each. A document is its ids and ``end``, so null and empty texts are segments of one id. An empty table gives no
    rows; repeated rows are packed each; other columns are not read. ``sequence_id`` is the task's number times 2^32 plus
    a count in the task.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = once(RankIds, ranks, pattern).kind
        size, base = np.dtype(kind).itemsize, TaskContext.get().partitionId() << 32
        last = np.array([end], kind).tobytes()
        held: list[tuple[int | None, int, bytes]] = []
        ids_held = made = 0

        def packed() -> dict[str, list]:
            window, offset = best_fit_decreasing(np.array([len(h[2]) // size for h in held]), capacity)
            out: dict[str, list] = {name.split()[0]: [] for name in ROWS.split(", ")}
            segments: list[list[int]] = [[] for _ in range(int(window.max()) + 1)]
            for i in np.lexsort((offset, window)).tolist():
                segments[window[i]].append(i)
            for k, own in enumerate(segments):
                row = b"".join([held[i][2] for i in own])
                n = len(row) // size
                ends = np.cumsum([0, *(len(held[i][2]) // size for i in own)]).tolist()
                values = (
                    base + made + k, row + last * (capacity - n), n, ends, ends[:-1] + [n] * (n < capacity),
                    [held[i][0] for i in own], [held[i][1] for i in own],
                )
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            return out

        for part in parts:
            keys = iter(part.column("doc_id").to_pylist())
            for some in portions(texts(part)):
                for ids in once(RankIds, ranks, pattern).encode(some):
                    ids, owner = ids + last, next(keys)
                    held += [(owner, s, ids[size * s : size * (s + n)]) for s, n in cut(len(ids) // size, capacity)]
                    ids_held += len(ids) // size
                if ids_held >= buffered:
                    rows = packed()
                    made, held, ids_held = made + len(rows["ids"]), [], 0
                    yield pa.RecordBatch.from_pydict(rows, schema=schema)
        if held:
            yield pa.RecordBatch.from_pydict(packed(), schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ROWS))
    return df.selectExpr(f"cast(`{key}` as bigint) AS doc_id", f"`{text}` AS text").mapInArrow(run, ROWS)


def write_matrix(df: DataFrame, path: str, **options) -> DataFrame:
    """The rows of ``matrix_rows`` as Parquet below ``path``, read back."""
    matrix_rows(df, **options).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def digests(rows: DataFrame, wide: bool = False) -> DataFrame:
    """The same rows with a checksum of the used ids in place of the ids."""
    size = 4 if wide else 2

    def per_batch(part: pa.RecordBatch) -> dict:
        ids, used = part.column("ids").to_pylist(), part.column("n_tokens").to_pylist()
        found = {name: part.column(name) for name in part.schema.names if name != "ids"}
        return {"ids_crc32": [zlib.crc32(i[: size * n]) for i, n in zip(ids, used, strict=True)], **found}

    return mapped(rows, per_batch, ROWS.replace("ids binary", "ids_crc32 bigint", 1))
