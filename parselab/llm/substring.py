"""Substring deduplication: relative Lempel-Ziv factors of each document against the indexed blocks of all documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parselab.llm.common import small_batches
from parselab.llm.exchange import block_table, groups, numbers, pack, planes, unpack, with_answers
from parselab.session import written

SEED = 5  # words of a seed
NO_ID = np.iinfo(np.int64).max
BLOCK_BYTES = 5_000_000
BLOCKS = "block bigint, doc_ids array<bigint>, texts array<string>"
FACTORS = "array<struct<start: bigint, length: bigint, ref_doc: bigint, ref_start: bigint>>"
PARSED = f"doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, factors {FACTORS}, kept string"


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(ids: np.ndarray, width: int, odd: int) -> np.ndarray:
    """64-bit hash of each run of ``width`` words."""
    n = max(0, len(ids) - width + 1)
    found = np.full(n, width, np.uint64)
    for k in range(width):
        found = (found ^ (found >> np.uint64(29))) * np.uint64(odd) + ids[k : k + n]
    return _mix(found)


def words_of(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes are cut at just these."""
    return text.encode("utf-8", "surrogatepass").split()


@dataclass
class Block:
    """The documents of a block in the order of their ids (none last), as one reference string of word hashes with all its windows.

    ``at``: start of each window in the string, ascending, so of equal windows the first is that of the least id. ``seed``: the
    least hash of the runs of ``SEED`` words in a window; equal windows have equal seeds, and neighbours mostly share one.
    """

    doc_ids: np.ndarray
    texts: list[str]
    start: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    window: np.ndarray
    seed: np.ndarray
    bucket: np.ndarray

    @classmethod
    def of(cls, row: dict, width: int) -> Block:
        keys = np.array([NO_ID if d is None else d for d in row["doc_ids"]], np.int64)
        order = np.argsort(keys, kind="stable")
        texts = [row["texts"][i] or "" for i in order.tolist()]
        ids, sizes = [np.zeros(0, np.uint64)], []
        for text in texts:
            words = words_of(text)
            sizes.append(len(words))
            ids.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        ids, start = np.concatenate(ids), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        owner = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(max(0, len(ids) - width + 1))
        at = at[owner[at] == owner[at + width - 1]]
        short = _runs(ids, min(SEED, width), 0x9E3779B97F4A7C15)
        least = short[: max(0, len(ids) - width + 1)].copy()
        for k in range(1, width - min(SEED, width) + 1):
            np.minimum(least, short[k : k + len(least)], out=least)
        return cls(
            keys[order], texts, start, owner, at,
            _runs(ids, width, 0x9E3779B97F4A7C15)[at], least[at], _runs(ids, width, 0xD6E8FEB86659FD93)[at],
        )

    def document(self, windows: np.ndarray) -> np.ndarray:
        return self.doc_ids[self.owner[self.at[windows]]]

    def place(self, windows: np.ndarray) -> np.ndarray:
        """Start in its own document."""
        at = self.at[windows]
        return at - self.start[self.owner[at]]

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct seeds, and whether several of the block's documents have each."""
        order = np.argsort(self.seed, kind="stable")
        first = groups(self.seed[order])
        last = np.append(first[1:], len(order)) - 1
        owner = self.owner[self.at[order]]
        return self.seed[order[first]], owner[first] != owner[last]


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows dealt to blocks of about ``size`` characters where they are read; nothing is shuffled."""
    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, ids, texts, held = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"block": first + made, "doc_ids": ids, "texts": texts}], schema=schema)

        for part in parts:
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                held += len(text or "")
                if held >= size:
                    yield block()
                    made, ids, texts, held = made + 1, [], [], 0
        if ids:
            yield block()

    return df.mapInArrow(run, BLOCKS)


def _each(df: DataFrame, schema: str, per_block) -> DataFrame:
    """``per_block`` of each row, a block, gives rows."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                yield pa.RecordBatch.from_pylist(list(per_block(part.slice(k, 1).to_pylist()[0])), schema=out)

    return df.mapInArrow(run, schema)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    starts = groups(bucket)
    for a, z in zip(starts.tolist(), (starts + np.diff(starts, append=len(bucket))).tolist(), strict=True):
        yield int(bucket[a]), slice(a, z)


def _shared_seeds(blocks: DataFrame, buckets: int, width: int) -> DataFrame:
    """block, bucket, bits: which of the seeds that a block sent to a bucket some other block has too."""

    def sent(row: dict) -> Iterator[dict]:
        seeds, _ = Block.of(row, width).seeds()
        own = seeds % np.uint64(buckets)
        order = np.argsort(own, kind="stable")
        for bucket, part in _by_bucket(own[order]):
            some = seeds[order[part]]
            yield {"bucket": bucket, "block": row["block"], "n": len(some), "seeds": pack(some)}

    schema = to_arrow_schema(StructType.fromDDL("block bigint, bucket bigint, bits binary"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = np.concatenate([unpack(r["seeds"], r["n"]) for r in rows])
        _, at, times = np.unique(found, return_inverse=True, return_counts=True)
        shared = np.split(times[at] > 1, np.cumsum([r["n"] for r in rows])[:-1])
        made = [
            {"block": r["block"], "bucket": r["bucket"], "bits": np.packbits(own).tobytes()}
            for r, own in zip(rows, shared, strict=True) if own.any()
        ]
        return pa.Table.from_pylist(made, schema=schema)

    dealt = _each(blocks, "bucket bigint, block bigint, n int, seeds binary", sent)
    return dealt.groupBy("bucket").applyInArrow(compare, "block bigint, bucket bigint, bits binary")


def _first_places(asked: DataFrame, buckets: int, width: int) -> DataFrame:
    """block, n, windows, docs, places: the windows of a block that a smaller id has in another block, and where it has them first.

    ``asked``: blocks with the bits of their seeds. Only windows whose seed lies in several documents are sent, once per block, from
    the least id that has them there.
    """

    def sent(row: dict) -> Iterator[dict]:
        block = Block.of(row, width)
        seeds, shared = block.seeds()
        own = seeds % np.uint64(buckets)
        order = np.argsort(own, kind="stable")
        bits = {a["bucket"]: a["bits"] for a in row["answers"] or ()}
        for bucket, part in _by_bucket(own[order]):
            if bucket in bits:
                at = order[part]
                shared[at] |= np.unpackbits(np.frombuffer(bits[bucket], np.uint8), count=len(at)).astype(bool)
        some = np.flatnonzero(shared[np.searchsorted(seeds, block.seed)])
        order = np.argsort(block.window[some], kind="stable")
        some = some[order[groups(block.window[some[order]])]]
        to = block.bucket[some] % np.uint64(buckets)
        some = some[np.argsort(to, kind="stable")]
        for bucket, part in _by_bucket(block.bucket[some] % np.uint64(buckets)):
            own = some[part]
            yield {
                "bucket": bucket, "block": row["block"], "n": len(own), "windows": pack(block.window[own]),
                "docs": planes(block.document(own).view(np.uint64)), "places": planes(block.place(own).view(np.uint64)),
            }

    names = "block bigint, n int, windows binary, docs binary, places binary"
    schema = to_arrow_schema(StructType.fromDDL(names))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.select(["block", "n", "windows", "docs", "places"]).to_pylist()
        window = np.concatenate([unpack(r["windows"], r["n"]) for r in rows])
        doc = np.concatenate([numbers(r["docs"], r["n"]) for r in rows]).view(np.int64)
        place = np.concatenate([numbers(r["places"], r["n"]) for r in rows])
        source = np.repeat(np.arange(len(rows)), [r["n"] for r in rows])
        order = np.lexsort((source, doc, window))
        starts = groups(window[order])
        first = order[np.repeat(starts, np.diff(starts, append=len(order)))]  # the first place of each entry in that order
        later = doc[order] > doc[first]
        entry, first = order[later], first[later]
        again = np.argsort(entry, kind="stable")  # by block, then by window
        entry, first = entry[again], first[again]
        made = []
        for at, part in _by_bucket(source[entry]):
            own, to = entry[part], first[part]
            made.append(
                {"block": rows[at]["block"], "n": len(own), "windows": pack(window[own]),
                 "docs": planes(doc[to].view(np.uint64)), "places": planes(place[to])}
            )
        return pa.Table.from_pylist(made, schema=schema)

    return _each(asked, f"bucket bigint, {names}", sent).groupBy("bucket").applyInArrow(compare, names)


def _parse(block: Block, answers: list[dict], width: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which words of the block's string go, and the factors: start in the string, length, reference document and place in it.

    A factor begins at a window that lies in an earlier document and goes on as long as the next windows follow there as well;
    where the reference ends the next window, across the boundary, is looked up itself.
    """
    order = np.argsort(block.window, kind="stable")
    starts = groups(block.window[order])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.repeat(starts, np.diff(starts, append=len(order)))]
    every = np.arange(len(order))
    ref_doc, ref_place = block.document(first), block.place(first)
    repeated = ref_doc < block.document(every)
    if answers:
        known = np.concatenate([unpack(a["windows"], a["n"]) for a in answers])
        by = np.argsort(known)
        docs = np.concatenate([numbers(a["docs"], a["n"]) for a in answers]).view(np.int64)[by]
        places = np.concatenate([numbers(a["places"], a["n"]) for a in answers]).view(np.int64)[by]
        known = known[by]
        at = np.minimum(np.searchsorted(known, block.window), len(known) - 1)
        met = known[at] == block.window
        repeated |= met
        ref_doc, ref_place = np.where(met, docs[at], ref_doc), np.where(met, places[at], ref_place)
    hit = np.flatnonzero(repeated)
    at, doc, place = block.at[hit], ref_doc[hit], ref_place[hit]
    edge = np.zeros(len(block.owner) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
    starts = np.flatnonzero(new)
    length = np.diff(starts, append=len(at)) + width - 1
    return np.cumsum(edge[:-1]) > 0, {"start": at[starts], "length": length, "ref_doc": doc[starts], "ref_start": place[starts]}


def _rows(block: Block, gone: np.ndarray, factors: dict[str, np.ndarray], texts: bool) -> Iterator[dict]:
    of_doc = np.searchsorted(factors["start"], block.start)
    columns = [v.tolist() for v in factors.values()]
    for k, text in enumerate(block.texts):
        words, a, z = words_of(text), int(block.start[k]), int(block.start[k + 1])
        removed = int(np.count_nonzero(gone[a:z]))
        kept = b" ".join(compress(words, (~gone[a:z]).tolist()) if removed else words)
        found = zip(*(c[of_doc[k] : of_doc[k + 1]] for c in columns), strict=True)
        yield {
            "doc_id": None if block.doc_ids[k] == NO_ID else int(block.doc_ids[k]),
            "n_words": z - a,
            "n_removed": removed,
            "kept_sha256": sha256(kept).hexdigest(),
            "factors": [dict(zip(factors, (f[0] - a, *f[1:]), strict=True)) for f in found],
            "kept": kept.decode("utf-8", "surrogatepass") if texts else None,
        }


def parse(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 13, texts: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, factors, and with ``texts`` the kept words.

    A factor is a stretch of at least ``width`` words that stands in the same order in a document with a smaller id: its start and
    length in words, and document and place of its reference, the first occurrence by id. Words under a factor are removed, whatever
    else goes; the first document that has a passage keeps it.

    Documents lie in blocks of about ``block_bytes``, each with an index of its windows. A document is factored against its own
    block's index, and against those of all other blocks by way of buckets: first the blocks compare seeds, then windows whose
    seed several documents have. Of a passage that very many documents share a block sends one copy, so no key gathers more entries
    than there are blocks. A bucket holds about as much as a block. With b blocks the exchange has b^2 small rows at most: choose
    larger blocks for larger inputs (256 MB for 100 TB).

    Windows are compared by 64-bit hashes within a bucket that a second hash chooses. Null and empty texts have no words; rows
    without an id come after all others and none is removed for another's sake; rows that repeat an id remove nothing from each
    other. An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    read = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    total = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with small_batches(spark, 256), block_table(_blocks(read, block_bytes), -(-total // block_bytes)) as blocks:
        buckets = max(1, blocks.count())
        with small_batches(spark, 1):
            seeds = written(_shared_seeds(blocks, buckets, width), "seeds")
            places = written(_first_places(with_answers(blocks, seeds), buckets, width), "places")

            def parsed(row: dict) -> Iterator[dict]:
                block = Block.of(row, width)
                return _rows(block, *_parse(block, row["answers"] or [], width), texts)

            return written(_each(with_answers(blocks, places), PARSED, parsed), "parsed")
