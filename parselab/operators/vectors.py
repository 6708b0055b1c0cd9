"""Joins of vectors by cosine similarity: exact with bounds from leading directions, and by signed random projections."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parselab.session import written

SLACK = 1e-9  # above the rounding of a dot product of unit vectors
BOX = 4  # leading directions in which blocks have bounds
PAIRS = "i long, j long, sim double"
WORK = "low int, high int, products long, completed long"
SIDES = 16  # a vector is sent to at most so many tasks,
SIDE_BYTES = 1 << 25  # unless the vectors of one side of a task would be larger than this


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row stays zero, so its cosine is 0."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    if np.ptp(column.value_lengths().to_numpy()):
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit_vectors(df: DataFrame, pos: str, vector: str, keep: Sequence[str] = ()) -> DataFrame:
    """pos, vector (scaled) and the columns ``keep``, as a written table; rows without place or vector are in no pair."""
    rows = df.select(F.col(pos).cast("long").alias("pos"), F.col(vector).cast("array<double>").alias("vector"), *keep)
    rows = rows.filter("pos IS NOT NULL AND vector IS NOT NULL")

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scaled = unit(_matrix(batch.column("vector")))
                ends = np.arange(len(scaled) + 1, dtype=np.int32) * scaled.shape[1]
                yield batch.set_column(1, "vector", pa.ListArray.from_arrays(ends, scaled.ravel()))

    return written(rows.mapInArrow(scale, rows.schema), "vectors")


def directions(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Principal directions of all vectors as columns, and the share of the squared lengths along each, largest first.

    Sums of products leave a task as one row per matrix cell, so the driver gets dimensions squared numbers.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                some = np.stack(batch["vector"].to_numpy())
                total = some.T @ some + (0 if total is None else total)
        if total is not None:
            yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    cells = rows.mapInPandas(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    found = cells.toPandas().sort_values("cell")["value"].to_numpy()
    matrix = found.reshape(math.isqrt(len(found)), -1)
    shares, columns = np.linalg.eigh(matrix)
    shares = np.clip(shares[::-1], 0, None)
    return columns[:, ::-1].copy(), shares / (shares.sum() or 1.0)


def lead_of(shares: np.ndarray, threshold: float, margin: float = 0.15) -> int:
    """Directions after which two vectors of usual remainders fall short of ``threshold``; 0 where half of them are not enough."""
    enough = np.flatnonzero(1 - np.cumsum(shares) <= threshold - margin)
    return int(enough[0]) + 1 if len(enough) and enough[0] < len(shares) // 2 else 0


def _placed(rows: DataFrame, turn: np.ndarray, block_rows: int, n: int) -> DataFrame:
    """The rows and their block: cells between quantiles of the two leading directions, large cells in parts."""
    wanted = -(-n // block_rows)
    bins = max(1, math.isqrt(wanted))
    turn = turn[:, :2]

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.stack(batch.column("vector").to_numpy(zero_copy_only=False)) @ turn
                yield batch.append_column("x", pa.array(at[:, 0])).append_column("y", pa.array(at[:, -1]))

    turned = rows.mapInArrow(coordinates, StructType(list(rows.schema.fields)).add("x", "double").add("y", "double"))
    if bins == 1:
        return turned.withColumn("block", F.pmod(F.xxhash64("pos"), F.lit(wanted)).cast("int"))
    cuts = turned.approxQuantile(["x", "y"], [k / bins for k in range(1, bins)], 0.1 / bins)
    of = [sum((F.col(c) > F.lit(v)).cast("int") for v in sorted(set(at))) for c, at in zip("xy", cuts, strict=True)]
    celled = written(turned.withColumn("cell", of[0] * bins + of[1]), "cells")
    parts = celled.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    dealt = celled.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("pos"), "parts").cast("int"))
    names = dealt.select("cell", "part").distinct()
    numbered = names.select("cell", "part", F.dense_rank().over(_ordered("cell", "part")).alias("block"))
    return dealt.join(numbered, ["cell", "part"]).select(*rows.columns, "block")


def _ordered(*names: str):
    from pyspark.sql import Window as W

    return W.partitionBy(F.lit(0)).orderBy(*names)  # a row per block


def _boxes(placed: DataFrame, turn: np.ndarray) -> pd.DataFrame:
    """Least and greatest coordinates of each block in the leading directions and of what remains: a row per block."""
    turn = turn[:, :BOX]
    names = [f"c{k}" for k in range(turn.shape[1])] + ["rest"]
    bounds = ", ".join(f"low_{c} double, high_{c} double" for c in names)

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.stack(batch["vector"].to_numpy())
            at = vectors @ turn
            rest = np.sqrt(np.clip((vectors**2).sum(axis=1) - (at**2).sum(axis=1), 0, None))
            whole = pd.DataFrame(np.column_stack((at, rest)), columns=names).groupby(batch["block"].to_numpy())
            yield pd.concat([whole.min().add_prefix("low_"), whole.max().add_prefix("high_")], axis=1).rename_axis("block").reset_index()[
                ["block", *(f"{end}_{c}" for c in names for end in ("low", "high"))]
            ]

    found = placed.select("block", "vector").mapInPandas(bound, f"block int, {bounds}").groupBy("block")
    ends = [f(f"{end}_{c}").alias(f"{end}_{c}") for c in names for end, f in (("low", F.min), ("high", F.max))]
    return found.agg(*ends).toPandas().sort_values("block").reset_index(drop=True)


def meeting(boxes: pd.DataFrame, threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs of blocks in which two vectors may be similar enough, by their boxes: products and distances are bounded."""
    names = [c[4:] for c in boxes.columns if c.startswith("low_")]
    low, high = (boxes[[f"{end}_{c}" for c in names]].to_numpy() for end in ("low", "high"))
    blocks = boxes["block"].tolist()
    for k, block in enumerate(blocks):
        ends = [low[k] * low[k:], low[k] * high[k:], high[k] * low[k:], high[k] * high[k:]]
        product = np.maximum.reduce(ends).sum(axis=1)
        gap = np.clip(np.maximum(low[k] - high[k:], low[k:] - high[k]), 0, None)
        near = (gap**2).sum(axis=1) <= 2 - 2 * threshold + SLACK
        zero = threshold < 0  # a zero vector is at a cosine of 0 to all, whatever its distance
        for other in np.flatnonzero((product > threshold - SLACK) & (near | zero)).tolist():
            yield block, blocks[k + other]


def products(low: np.ndarray, high: np.ndarray, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """(rows, columns, similarities) above ``threshold``, and the number of products that were completed.

    A product is begun in the leading directions (the columns of ``turn``); the remainders' lengths bound the rest of it. Only products
    that may pass are completed, all of them where that is cheaper.
    """
    if turn.shape[1]:
        lead = low @ turn, high @ turn
        rest = [np.sqrt(np.clip((v**2).sum(axis=1) - (p**2).sum(axis=1), 0, None)) for v, p in zip((low, high), lead, strict=True)]
        at, to = np.nonzero(lead[0] @ lead[1].T + np.outer(*rest) > threshold - SLACK)
        if len(at) * 8 < len(low) * len(high):
            sim = np.einsum("ij,ij->i", low[at], high[to])
            keep = sim > threshold
            return at[keep], to[keep], sim[keep], len(at)
    sim = low @ high.T
    at, to = np.nonzero(sim > threshold)
    return at, to, sim[at, to], sim.size


def side_blocks(blocks: int, n: int, dims: int) -> int:
    """Blocks that go through the tasks together, as one side of a pair of sides."""
    sides = max(SIDES, -(-n * dims * 8 // SIDE_BYTES))
    return -(-blocks // sides)


Found = Iterator[tuple]  # per pair of blocks that meet: the blocks, rows, rows, similarities, products completed, products


def _spread(rows: DataFrame, threshold: float, turn: np.ndarray, block_rows: int, n: int) -> tuple[DataFrame, pd.DataFrame, int]:
    """The rows once per pair of sides (low, high) that they take part in, the blocks' boxes, and the blocks of a side."""
    placed = written(_placed(rows, turn, block_rows, n).select(*rows.columns, "block"), "placed")
    boxes = _boxes(placed, turn)
    per = side_blocks(int(boxes["block"].max()) + 1, n, len(turn))
    sides = sorted({(one // per, two // per) for one, two in meeting(boxes, threshold)})
    ends = [(low, high, side) for low, high in sides for side in {low, high}]
    partners = rows.sparkSession.createDataFrame(ends, "low int, high int, side int")
    sided = placed.withColumn("side", F.floor(F.col("block") / per).cast("int"))
    return sided.join(partners, "side").drop("side"), boxes, per


def block_products(
    df: DataFrame, threshold: float, pos: str, vector: str, block_rows: int, schema: str,
    each: Callable[[pa.Table, Found], Iterator[pa.RecordBatch]], keep: Sequence[str] = (),
) -> DataFrame:
    """What ``each`` makes of the rows (pos, ``keep``, block) of one pair of sides and the pairs of blocks that meet there.

    Blocks travel as ``SIDES`` sides, so a vector is sent to as many tasks whatever the number of blocks, and products are formed
    and handed on one pair of blocks at a time.
    """
    rows = unit_vectors(df, pos, vector, keep)
    spark, n = df.sparkSession, rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    turn, shares = directions(rows)
    lead = turn[:, : lead_of(shares, threshold)]
    spread, boxes, per = _spread(rows, threshold, turn, block_rows, n)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        table = table.take(pa.array(np.argsort(table.column("block").to_numpy(), kind="stable")))
        block = table.column("block").to_numpy()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(len(block), -1)
        ends = tuple(k.as_py() for k in key)

        def found() -> Found:
            for one, two in meeting(boxes[(boxes["block"] // per).isin(ends)], threshold):
                if (one // per, two // per) == ends:
                    left, right = (slice(*np.searchsorted(block, [b, b + 1])) for b in (one, two))
                    at, to, sim, completed = products(vectors[left], vectors[right], lead, threshold)
                    begun = (left.stop - left.start) * (right.stop - right.start)
                    yield one, two, at + left.start, to + right.start, sim, completed, begun

        yield from each(table.drop_columns(["vector"]), found())

    return spread.groupBy("low", "high").applyInArrow(run, schema)


def side_blocks(blocks: int, n: int, dims: int) -> int:
    """Blocks that go through the tasks together, as one side of a pair of sides."""
    return -(-blocks // max(SIDES, -(-n * dims * 8 // SIDE_BYTES)))


def in_order(pos: np.ndarray, found: Found) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of the smaller and row of the greater place, and similarity, of each pair once."""
    for one, two, at, to, sim, *_ in found:
        if one != two:  # within a block both orders of a pair are among the products
            swap = pos[at] > pos[to]
            at, to = np.where(swap, to, at), np.where(swap, at, to)
        keep = pos[at] < pos[to]
        yield at[keep], to[keep], sim[keep]


def bounded_pairs(
    df: DataFrame, threshold: float, pos: str = "pos", vector: str = "vector", block_rows: int = 2048
) -> DataFrame:
    """Pairs ``i < j`` with cosine above ``threshold``, as ``(i, j, sim)``. Exact.

    Directions are ordered by spread. Vectors near each other in the leading two lie in one block of about ``block_rows``; pairs of
    blocks whose boxes rule out the threshold never meet. A task gets a pair of sides of neighbouring blocks. It begins the products of two
    blocks in the leading directions and completes those that the remainders' lengths leave open, so its memory is bounded by the sizes of
    a side and a block, and only pairs above the threshold leave it. On the driver are a matrix of the dimensions and one box per block.
    Evenly spread vectors at a low threshold leave nothing to rule out: then every product is formed. A zero vector has cosine 0; an
    empty table no pairs.
    """

    def pairs(table: pa.Table, found: Found) -> Iterator[pa.RecordBatch]:
        place = table.column("pos").to_numpy()
        for at, to, sim in in_order(place, found):
            yield pa.RecordBatch.from_arrays([pa.array(place[at]), pa.array(place[to]), pa.array(sim)], ["i", "j", "sim"])

    return block_products(df, threshold, pos, vector, block_rows, PAIRS, pairs)


def pair_work(
    df: DataFrame, threshold: float, pos: str = "pos", vector: str = "vector", block_rows: int = 2048
) -> DataFrame:
    """What ``bounded_pairs`` does, per pair of blocks that meet: products begun, and products completed."""

    def work(table: pa.Table, found: Found) -> Iterator[pa.RecordBatch]:
        for one, two, _, _, _, completed, begun in found:
            row = [pa.array([one], pa.int32()), pa.array([two], pa.int32()), pa.array([begun]), pa.array([completed])]
            yield pa.RecordBatch.from_arrays(row, ["low", "high", "products", "completed"])

    return block_products(df, threshold, pos, vector, block_rows, WORK, work)


# Signed random projections.

MEMBERS = 1 << 14  # vectors of a bucket in one block
TILE = 256, 512  # vectors of two blocks in one product, which stays in a core's cache
TOGETHER = 1 << 15  # vectors that are compared together, or eight times as many pairs


def chance(similarity: float) -> float:
    """How likely a random plane leaves two vectors of this cosine on one side."""
    return 1 - math.acos(max(-1.0, min(1.0, similarity))) / math.pi


def bands_for(threshold: float, recall: float, bits: int) -> int:
    """Bands of ``bits`` planes so that a pair at the threshold shares one with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-(chance(threshold) ** bits))))


def bits_for(n: int) -> int:
    """Planes of a key so that a bucket of evenly spread vectors holds about 16."""
    return max(8, min(40, round(math.log2(max(n, 1) / 16))))


def _packed(rows: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of the rows between two starts as one binary value each."""
    ends = (np.append(starts, len(rows)) * rows[:1].nbytes).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of a binary column."""
    array = column.combine_chunks()
    ends = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def _signs(vectors: np.ndarray, bits: int, bands: int, seed: int) -> np.ndarray:
    """A key per row and band: on which side of the band's planes the row lies."""
    planes = np.random.default_rng(seed).normal(size=(vectors.shape[1], bits * bands)).astype(np.float32)
    side = vectors.astype(np.float32) @ planes > 0
    return (side.reshape(-1, bits).astype(float) @ 2.0 ** np.arange(bits)).astype(np.int64).reshape(len(side), bands)


def _coded(vectors: np.ndarray) -> np.ndarray:
    """Rows as bytes: numbers in steps of the row's greatest over 127, the step, and at most how far the row is from that."""
    step = (np.abs(vectors).max(axis=1, initial=0) / 127).astype(np.float32)
    with np.errstate(invalid="ignore"):
        whole = np.rint(vectors / np.where(step == 0, 1, step)[:, None]).astype(np.int8)
    off = np.linalg.norm(vectors - whole * step[:, None].astype(float), axis=1).astype(np.float32)
    return np.concatenate([whole.view(np.uint8), np.stack([step, off], axis=1).view(np.uint8)], axis=1)


def _decoded(code: np.ndarray, threshold: float) -> tuple[np.ndarray, float]:
    """Rows of ``_coded``, and what the product of two of them exceeds where their vectors' exceeds ``threshold``."""
    step, off = np.ascontiguousarray(code[:, -8:]).view(np.float32).T
    most = float(np.fmax.reduce(off, initial=0))
    rounding = code.shape[1] * 2.0**-22
    return code[:, :-8].view(np.int8) * step[:, None], threshold - 2 * most - 3 * most**2 - rounding


def _hot(rows: DataFrame, bits: int, bands: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of more than ``MEMBERS`` vectors, and the blocks each is cut into: at most ``bands`` buckets in ``MEMBERS`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _signs(_matrix(batch.column("vector")), bits, bands, seed)
                some = np.unique(keys + (np.arange(bands) << bits), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in some], ["bucket", "size"])

    sizes = rows.mapInArrow(count, "bucket long, size long").groupBy("bucket").agg(F.sum("size").alias("size"))
    found = sizes.filter(F.col("size") > MEMBERS).toPandas().sort_values("bucket")
    return found["bucket"].to_numpy(np.int64), -(-found["size"].to_numpy(np.int64) // MEMBERS)


def _dealt(rows: DataFrame, bits: int, bands: int, seed: int, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The vectors of each batch by band and group, packed in a row: the bucket, or below zero a pair of blocks of a hot one.

    ``part`` is 0 where all pairs of the group count, 1 and 2 on the two sides of a pair of blocks; ``member`` has the keys and the code.
    """
    buckets, parts = hot
    first = np.cumsum(parts**2) - parts**2
    kind = np.min_scalar_type((1 << bits) - 1)
    step = max(1, (1 << 18) // int(parts.max(initial=1)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                some = batch.slice(a, step)
                vectors = _matrix(some.column("vector"))
                other = _matrix(some.column("other")) if "other" in some.schema.names else vectors
                keys = _signs(vectors, bits, bands, seed)
                theirs = keys if other is vectors else _signs(other, bits, bands, seed)
                member = np.concatenate([theirs.astype(kind).view(np.uint8), _coded(other)], axis=1)
                pos = some.column("pos").to_numpy()
                own = (pos.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                for band in range(bands):
                    yield packed(keys[:, band] + (band << bits), band, pos, own, member)

    def packed(group: np.ndarray, band: int, pos: np.ndarray, own: np.ndarray, member: np.ndarray) -> pa.RecordBatch:
        at, part = np.arange(len(group)), np.zeros(len(group), np.int32)
        if len(buckets):
            place = np.minimum(np.searchsorted(buckets, group), len(buckets) - 1)
            times = np.where(buckets[place] == group, parts[place], 1)
            at = np.repeat(at, times)
            turn, times, place = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times), times[at], place[at]
            mine = own[at] % times
            low, high = np.minimum(mine, turn), np.maximum(mine, turn)
            group = np.where(times > 1, -1 - (first[place] + low * times + high), group[at])
            part = np.where(low == high, 0, np.where(mine == low, 1, 2)).astype(np.int32)
        order = np.lexsort((part, group))
        group, part, at = group[order], part[order], at[order]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(group) != 0) | (np.diff(part) != 0)]))
        columns = [pa.array(group[starts]), pa.array(np.full(len(starts), band, np.int32)), pa.array(part[starts])]
        blobs = _packed(pos[at][:, None], starts), _packed(member[at], starts)
        return pa.RecordBatch.from_arrays([*columns, *blobs], ["group", "band", "part", "pos", "member"])

    return rows.mapInArrow(deal, "group long, band int, part int, pos binary, member binary")


def _near(keys: np.ndarray, rows: np.ndarray, part: np.ndarray, band: int, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one group with a product above ``limit`` that share no earlier band (there they were found before)."""
    low, high = (np.flatnonzero(part == k) for k in (1, 2)) if part.any() else (np.arange(len(part)),) * 2
    whole = not part.any()
    turned = np.zeros((rows.shape[1], -(-len(high) // 8) * 8), np.float32)  # a multiple of 8 columns: hits are looked for in words
    turned[:, : len(high)] = rows[high].T
    for a in range(0, len(low), TILE[0]):
        left = rows[low[a : a + TILE[0]]]
        for b in range(a // TILE[1] * TILE[1] if whole else 0, len(high), TILE[1]):
            hits = left @ turned[:, b : b + TILE[1]] > limit
            words = np.flatnonzero(hits.reshape(-1).view(np.uint64))
            if not len(words):
                continue
            word, byte = np.nonzero(hits.reshape(-1, 8)[words])
            at, to = np.divmod(words[word] * 8 + byte, hits.shape[1])
            at, to = at + a, to + b
            keep = (at < to) & (to < len(high)) if whole else to < len(high)
            at, to = low[at[keep]], high[to[keep]]
            for c in range(0, len(at), 1 << 16):
                some = slice(c, c + (1 << 16))
                new = ~(keys[at[some], :band] == keys[to[some], :band]).any(axis=1)
                yield at[some][new], to[some][new]


def _portions(rows: DataFrame, threshold: float, recall: float, bits: int | None, seed: int) -> DataFrame:
    """Candidates in portions, as a written table: portion, members (places), at and to (pairs of indexes into the members)."""
    n = rows.count()
    bits = bits or bits_for(n)
    bands = bands_for(threshold, recall, bits)
    if rows.groupBy("pos").count().filter("count > 1").isEmpty():
        given = rows
    else:  # the rows of a place stand for each other
        given = written(rows.join(rows.select("pos", F.col("vector").alias("other")), "pos"), "given")
        n = given.count()
    hot = _hot(given, bits, bands, seed) if n > MEMBERS else (np.zeros(0, np.int64),) * 2
    grouped = _dealt(given, bits, bands, seed, hot).repartition("group").sortWithinPartitions("group")
    wide = bands * np.min_scalar_type((1 << bits) - 1).itemsize
    kind = np.min_scalar_type((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        number = TaskContext.get().partitionId() << 32

        def groups(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Places of the candidates of whole groups."""
            size = pc.binary_length(table.column("pos")).to_numpy() // 8
            group, band, part = (np.repeat(table.column(c).to_numpy(), size) for c in ("group", "band", "part"))
            pos = _unpacked(table.column("pos")).view(np.int64)
            member = _unpacked(table.column("member")).reshape(len(pos), -1)
            starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
                if b - a > 1:
                    keys = np.ascontiguousarray(member[a:b, :wide]).view(kind)
                    code, limit = _decoded(member[a:b, wide:], threshold)
                    for at, to in _near(keys, code, part[a:b], int(band[a]), limit):
                        yield pos[a:b][at], pos[a:b][to]

        def portion() -> pa.RecordBatch:
            nonlocal number
            one, two = (np.concatenate(x) for x in zip(*pairs, strict=True))
            members, at = np.unique(np.concatenate([np.minimum(one, two), np.maximum(one, two)]), return_inverse=True)
            lists = [[number], [members], *([x.astype(np.int32)] for x in np.split(at, 2))]
            pairs.clear()
            number += 1
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(lists, kinds, strict=True)], ["portion", "members", "at", "to"])

        def gathered(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal count, ends
            for one, two in groups(table):
                if len(one):
                    pairs.append((one, two))
                    count, ends = count + len(one), ends + min(2 * len(one), sum(TILE))
                    if ends >= TOGETHER or count >= 8 * TOGETHER:
                        yield portion()
                        count = ends = 0

        count = ends = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("group").to_numpy()
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on in the next batch
            if held and (cut or group[0] != held[-1].column("group")[-1].as_py()):
                yield from gathered(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from gathered(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from gathered(pa.Table.from_batches(held))
        if pairs:
            yield portion()

    return written(grouped.mapInArrow(run, "portion long, members array<long>, at array<int>, to array<int>"), "candidates")


def hashed_candidates(
    rows: DataFrame, threshold: float, recall: float = 0.95, bits: int | None = None, seed: int = 42
) -> DataFrame:
    """Pairs ``i < j`` of the unit vectors ``rows`` (pos, vector) that share a bucket and may be above ``threshold``, each once.

    ``bits`` planes make a bucket's key, by default so many that a bucket of evenly spread vectors holds about 16; as many bands as
    ``recall`` takes at ``threshold``. Places, keys and a byte per number of the vector travel to the buckets. There products of the
    coarse vectors, in tiles, rule out all pairs but those whose error bounds leave the threshold open. Buckets of more than ``MEMBERS``
    vectors are cut into blocks, and each pair of blocks is a group of its own, so no bucket is one task's.
    """
    portions = _portions(rows, threshold, recall, bits, seed)
    return portions.selectExpr("inline(transform(arrays_zip(at, to), p -> struct(members[p.at] AS i, members[p.to] AS j)))")


def hashed_pairs(
    df: DataFrame, threshold: float, pos: str = "pos", vector: str = "vector", recall: float = 0.95,
    bits: int | None = None, seed: int = 42,
) -> DataFrame:
    """Pairs ``i < j`` with cosine above ``threshold``, as ``(i, j, sim)``: nearly all of them, by locality-sensitive hashing.

    No pair below the threshold comes out, as candidates are compared on the vectors themselves; a pair at the threshold is found with
    probability ``recall``, more similar ones more surely. A vector is sent once to each portion of candidates that it is in, however
    many of them are with it. At a low threshold the bands it takes would bring half of all pairs together or more; then hashing saves
    nothing, and all products are formed instead.
    """
    rows = unit_vectors(df, pos, vector)
    bits = bits or bits_for(rows.count())
    if bands_for(threshold, recall, bits) >= 2 ** (bits - 1):
        return bounded_pairs(rows, threshold)
    portions = _portions(rows, threshold, recall, bits, seed)
    wanted = portions.select(F.col("portion").alias("of"), F.explode("members").alias("pos")).join(rows, "pos")

    def compare(candidates: pa.Table, given: pa.Table) -> pa.Table:
        members, at, to = (candidates.column(c).combine_chunks().flatten().to_numpy() for c in ("members", "at", "to"))
        place = given.column("pos").to_numpy()
        order = np.argsort(place, kind="stable")
        vectors = _matrix(given.column("vector").combine_chunks())[order]
        start, end = (np.searchsorted(place[order], members, side) for side in ("left", "right"))
        size = end - start
        times = size[at] * size[to]  # a place given twice has two vectors
        pair = np.repeat(np.arange(len(at)), times)
        turn = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
        one, two = start[at[pair]] + turn // size[to[pair]], start[to[pair]] + turn % size[to[pair]]
        steps = range(0, len(pair), TOGETHER)
        sim = [np.einsum("ij,ij->i", vectors[one[k : k + TOGETHER]], vectors[two[k : k + TOGETHER]]) for k in steps]
        sim = np.concatenate([*sim, np.zeros(0)])
        keep = sim > threshold
        i, j = members[at[pair[keep]]], members[to[pair[keep]]]
        return pa.table({"i": pa.array(i), "j": pa.array(j), "sim": pa.array(sim[keep])})

    return portions.groupBy("portion").cogroup(wanted.groupBy("of")).applyInArrow(compare, PAIRS)
