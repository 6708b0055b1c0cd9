"""Quality rules: repetition counts, and compression bands over whole texts and fixed chunks."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from parselab.llm.common import WORD, mapped, texts

WORDS = re.compile(WORD)
SYMBOLS = re.compile(r"[#*$%&|<>]")
COLUMNS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
    "n_repeat_words": "bigint", "base_failed": "boolean", "whole_ratio": "double", "low_chunk_ratio": "double",
    "high_chunk_ratio": "double", "kept": "boolean",
}
SCHEMA = "doc_id bigint, " + ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size / size (zstandard, ``level``), by length in UTF-8 bytes.

    ``limits`` lists (texts up to so many bytes, lowest, highest whole ratio). Short texts compress badly, so their band
    lies higher. Chunks of ``chunk`` bytes, from the text's start on, and one more that ends with the text where those leave a rest: a text
    goes if more than ``chunk_share`` of its chunks lie outside ``chunk_limits``. A text shorter than a chunk has the whole ratio only.
    """

    level: int = 3
    limits: tuple[tuple[float, float, float], ...] = (
        (64, 0.30, 1.60),
        (256, 0.20, 1.30),
        (1024, 0.20, 0.95),
        (8192, 0.20, 0.75),
        (float("inf"), 0.15, 0.75),
    )
    chunk: int = 4096
    chunk_limits: tuple[float, float] = (0.12, 0.75)
    chunk_share: float = 0.25


def repeat_words(words: list[str], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text, first finds included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    rank = ids[:n]
    for k in range(1, width):  # exact: ranks and word numbers stay below the word count, so a pair fits 64 bits
        _, rank, count = np.unique(rank * len(seen) + ids[k : k + n], return_inverse=True, return_counts=True)
        if len(count) == n:
            return 0
    starts = np.flatnonzero(count[rank] > 1)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(marks)))


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return len(lines) - len(set(lines))


def ratios(data: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, list[float]]:
    """Compressed size / size of the whole text, and of its chunks; the last chunk ends where the text ends."""
    whole = len(press.compress(data)) / len(data) if data else 1.0
    size, view = bands.chunk, memoryview(data)
    starts = list(range(0, len(data) - size + 1, size))
    if starts and len(data) % size:
        starts.append(len(data) - size)
    return whole, [len(press.compress(view[i : i + size])) / size for i in starts]


def in_bands(size: int, whole: float, chunks: list[float], bands: Bands) -> bool:
    low, high = next((low, high) for most, low, high in bands.limits if size <= most)
    if not low <= whole <= high:
        return False
    outside = sum(not bands.chunk_limits[0] <= c <= bands.chunk_limits[1] for c in chunks)
    return outside <= bands.chunk_share * len(chunks)


def judge(text: str, bands: Bands, press: zstandard.ZstdCompressor) -> tuple:
    """The columns of ``COLUMNS`` for one text."""
    words = WORDS.findall(text)
    repeats = repeat_words(words)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    data = text.encode("utf-8", "surrogatepass")
    whole, chunks = ratios(data, bands, press)
    kept = not failed and in_bands(len(data), whole, chunks, bands)
    symbols = len(SYMBOLS.findall(text))
    return (
        len(words), sum(map(len, words)), symbols, duplicate_lines(text), repeats, failed,
        whole, min(chunks, default=whole), max(chunks, default=whole), kept,
    )


def assess(df: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document with its counts, ratios and verdict.

    A null text is an empty one: no words, so it fails the base rule. Rows are judged one by one, repeated rows alike;
    an empty table gives no rows; other columns are not read.
    """

    def per_batch(part: pa.RecordBatch) -> dict[str, list]:
        press = zstandard.ZstdCompressor(level=bands.level)
        found = [judge(t, bands, press) for t in texts(part)]
        return {"doc_id": part.column("doc_id")} | dict(zip(COLUMNS, map(list, zip(*found)), strict=True))

    return mapped(df.selectExpr(f"cast(`{key}` as bigint) AS doc_id", f"`{text}` AS text"), per_batch, SCHEMA)


def passing(df: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows whose text passes, all columns as they are."""

    def run(parts):
        press = zstandard.ZstdCompressor(level=bands.level)
        for part in parts:
            keep = [judge(t, bands, press)[-1] for t in texts(part, text)]
            yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)

