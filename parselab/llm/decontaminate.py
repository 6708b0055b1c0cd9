"""Benchmark decontamination: shared-token seeds, greedy string tiling, a threshold on the covered share of an item."""

from __future__ import annotations

import re
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parselab.llm.common import BitTable, mapped, small_batches, texts
from parselab.session import written

# A word, or one character of a script without spaces.
TOKENS = re.compile(r"[぀-ヿ㐀-鿿]|[^\W぀-ヿ㐀-鿿]+")
MEMO = 150_000
BATCH = 512  # documents in one Arrow batch
BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Rule:
    """Tiles of at least ``least`` tokens; an item with ``percent`` of its tokens covered is leaked.

    ``filter_bits`` is the size of the bit table that passes over text without seeds (8 MB by default, whatever the size of
    the benchmark; a fuller table only lets more through to the exact join).
    """

    least: int = 5
    percent: int = 60
    filter_bits: int = 1 << 26


def tokens(text: str) -> list[str]:
    return TOKENS.findall(text.lower())


class _TokenHashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[token] = xxhash.xxh3_64_intdigest(token)
        return found


_HASHES = _TokenHashes()


def token_hashes() -> _TokenHashes:
    """The token hashes of this worker; they go on from batch to batch."""
    return _HASHES


def seed_hashes(words: list[str], least: int, hashes: dict) -> np.ndarray:
    """64-bit hash of each run of ``least`` tokens, in order."""
    n = len(words) - least + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    found = ids[:n].copy()
    for k in range(1, least):
        found = (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[k : n + k]
    return found ^ (found >> np.uint64(32))


def item_seeds(items: DataFrame, rule: Rule) -> DataFrame:
    """item, n_words, seed, times: seeds of each item's text; those below ``least`` tokens have none."""

    def per_batch(part: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"item": [], "n_words": [], "seed": [], "times": []}
        hashes = token_hashes()
        for item, text in zip(part.column("item").to_pylist(), texts(part), strict=True):
            words = tokens(text)
            seeds, times = np.unique(seed_hashes(words, rule.least, hashes), return_counts=True)
            out["item"] += [item] * len(seeds)
            out["n_words"] += [len(words)] * len(seeds)
            out["seed"] += seeds.view(np.int64).tolist()
            out["times"] += times.tolist()
        return out

    return mapped(items, per_batch, "item bigint, n_words bigint, seed bigint, times bigint")


def document_runs(docs: DataFrame, bits: BitTable, rule: Rule) -> DataFrame:
    """doc_id, text_hash, run, words, seeds: maximal runs of a document's tokens that seeds cover (or may cover)."""

    def per_batch(part: pa.RecordBatch) -> dict[str, list]:
        hashes = token_hashes()
        out: dict[str, list] = {"doc_id": [], "text_hash": [], "run": [], "words": [], "seeds": []}
        keys = zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), texts(part), strict=True)
        for doc_id, text_hash, text in keys:
            words = tokens(text)
            seeds = seed_hashes(words, rule.least, hashes)
            hit = np.flatnonzero(bits.holds(seeds))
            if not len(hit):
                continue
            for run, own in enumerate(np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)):
                out["doc_id"].append(doc_id)
                out["text_hash"].append(text_hash)
                out["run"].append(run)
                out["words"].append(words[own[0] : own[-1] + rule.least])
                out["seeds"].append(np.unique(seeds[own]).view(np.int64).tolist())
        return out

    schema = "doc_id bigint, text_hash bigint, run int, words array<string>, seeds array<bigint>"
    return mapped(docs, per_batch, schema)


def _rolling(ids: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hash of each window of ``length`` tokens, modulo 2^64: each is its neighbour's, moved on by one token."""
    n = len(ids) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    up, down = (np.cumprod(np.full(len(ids), step, np.uint64)) for step in (BASE, INVERSE))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_spread(ids) * up)))
    return (sums[length:] - sums[:n]) * down[:n]


def _spread(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(31))


def _maximal(item: np.ndarray, doc: np.ndarray, least: int, at_once: int = 50_000) -> list[tuple[int, int, int]]:
    """(-length, place in the item, place in the document) of each match that goes on at neither end.

    Equal windows on one diagonal are one match: only its first and its last window are kept, and hits are looked through for
    some places of the document at a time.
    """
    of_item, of_doc = _rolling(item, least), _rolling(doc, least)
    order = np.argsort(of_item, kind="stable")
    known = of_item[order]
    low, high = np.searchsorted(known, of_doc, "left"), np.searchsorted(known, of_doc, "right")
    places = np.flatnonzero(high > low)
    firsts, lasts = [], []
    hits = (high - low)[places]
    parts = np.split(places, np.flatnonzero(np.diff(np.cumsum(hits) // at_once)) + 1)
    for part in parts:
        count = (high - low)[part]
        j = np.repeat(part, count)
        i = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[part], count)]
        before = (i > 0) & (j > 0)
        before[before] = of_item[i[before] - 1] == of_doc[j[before] - 1]
        after = (i + 1 < len(of_item)) & (j + 1 < len(of_doc))
        after[after] = of_item[i[after] + 1] == of_doc[j[after] + 1]
        firsts.append((i[~before], j[~before]))
        lasts.append((i[~after], j[~after]))
    (i, j), (last, end) = (tuple(map(np.concatenate, zip(*side, strict=True))) for side in (firsts, lasts))
    one, other = np.lexsort((i, j - i)), np.lexsort((last, end - last))
    i, j, length = i[one], j[one], last[other] - i[one] + least
    same = (tuple(item[a : a + n]) == tuple(doc[b : b + n]) for a, b, n in zip(i, j, length, strict=True))  # not the hashes only
    return [(-n, a, b) for a, b, n, equal in zip(i.tolist(), j.tolist(), length.tolist(), same, strict=True) if equal]


def tile(item: list[int], runs: list[list[int]], least: int) -> list[int]:
    """Lengths of the tiles: the longest common stretch of unmarked tokens is marked on both sides, again and again.

    Every common stretch lies within a match that goes on at neither end, so those are enough: the longest one is taken from a heap, and
    what is left of one that a tile has cut goes back. Ties go to the first place in the item, then in the document.
    """
    doc: list[int] = []
    for run in runs:
        doc += [*run, 0]  # 0 parts the runs and is in no item
    if len(item) < least or len(doc) < least:
        return []
    waiting = _maximal(np.array(item, np.int64), np.array(doc, np.int64), least)
    heapify(waiting)
    free_item, free_doc = bytearray(b"\1" * len(item)), bytearray(b"\1" * len(doc))
    left, tiles = len(item), []
    while waiting and left >= least:
        n, i, j = heappop(waiting)
        n = -n
        if 0 not in free_item[i : i + n] and 0 not in free_doc[j : j + n]:
            free_item[i : i + n] = free_doc[j : j + n] = bytes(n)
            left -= n
            tiles.append(n)
            continue
        start = None
        for k in range(n + 1):
            if k < n and free_item[i + k] and free_doc[j + k]:
                start = k if start is None else start
            elif start is not None:
                if k - start >= least:
                    heappush(waiting, (start - k, i + start, j + start))
                start = None
    return tiles


def short_leaks(read: DataFrame, benchmark: DataFrame, rule: Rule) -> DataFrame | None:
    """doc_id, text_hash, item_id, n_words: items of fewer than ``least`` tokens that a document holds as they are; None without such items.

    Runs of as many tokens as some item has go on if they pass a bit table, each once per document, and are joined to the items.
    """

    def cut(part: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"item_id": [], "words": []}
        for item, text in zip(part.column("item_id").to_pylist(), texts(part), strict=True):
            words = tokens(text)
            if 0 < len(words) < rule.least:
                out["item_id"].append(item)
                out["words"].append(words)
        return out

    items = written(mapped(benchmark, cut, "item_id bigint, words array<string>"), "items")
    widths = [r["n"] for r in items.select(F.size("words").alias("n")).distinct().collect()]  # fewer than ``least``
    if not widths:
        return None

    def sign(part: pa.RecordBatch) -> dict[str, list]:
        hashes = token_hashes()
        return {"seed": [int(seed_hashes(w, len(w), hashes).view(np.int64)[0]) for w in part.column("words").to_pylist()]}

    bits = BitTable(mapped(items.select("words"), sign, "seed bigint"), "seed", rule.filter_bits)

    def search(part: pa.RecordBatch) -> dict[str, list]:
        hashes = token_hashes()
        out: dict[str, list] = {"doc_id": [], "text_hash": [], "words": []}
        for doc_id, text_hash, text in zip(part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist(), texts(part), strict=True):
            words = tokens(text)
            hits = {
                tuple(words[at : at + width])
                for width in widths
                for at in np.flatnonzero(bits.holds(seed_hashes(words, width, hashes))).tolist()
            }
            out["doc_id"] += [doc_id] * len(hits)
            out["text_hash"] += [text_hash] * len(hits)
            out["words"] += map(list, hits)
        return out

    found = mapped(read, search, "doc_id bigint, text_hash bigint, words array<string>").join(items, "words")
    return found.select("doc_id", "text_hash", "item_id", F.size("words").cast("bigint").alias("n_words")).distinct()


def leaks(
    docs: DataFrame, items: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """doc_id, text_hash, item_id, n_words, n_covered, n_tiles, longest: items that a document covers.

    Documents are read once; only runs that pass the bit table go on. A document that covers an item has seeds enough of it for the
    threshold (a tile of n tokens has n - least + 1 of them), so at least one beyond the most frequent seeds that the threshold can
    spare: documents and items meet on those rarer seeds only, all seeds of a pair are counted afterwards, and what remains is
    tiled with the document's own runs. Items are tiled in any order of their parts, so reordered passages are found. Items of fewer than
    ``least`` tokens have no seeds: a document that holds such an item whole, as a run of tokens, is a hit.

    Null and empty texts, and items without tokens, match nothing; rows with the same id and text are one document; tables without
    rows give none; other columns are not read.
    """
    named = items.select(F.col(item_key).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).distinct()
    benchmark = written(named.withColumn("item", F.xxhash64("item_id", F.col("item_id").isNull(), "text")), "benchmark")
    seeds = written(item_seeds(benchmark, rule), "seeds")
    read = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")
    )
    with small_batches(docs.sparkSession, BATCH):
        runs = written(document_runs(read, BitTable(seeds, "seed", rule.filter_bits), rule), "runs")
    document = ["doc_id", "no_id", "text_hash"]
    runs = runs.withColumn("no_id", F.col("doc_id").isNull()).fillna(0, ["doc_id"]).dropDuplicates([*document, "run"])
    of_runs = runs.select(*document, F.explode("seeds").alias("seed"))
    of_item = W.partitionBy("item")
    most = of_item.orderBy(F.desc("runs"), "seed").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = seeds.join(of_runs.groupBy("seed").agg(F.count("*").alias("runs")), "seed").select(
        "item", "seed", "times",
        F.ceil(F.col("n_words") * rule.percent / (100 * rule.least)).alias("needed"),
        F.sum("times").over(most).alias("so_far"),
    )
    ranked = written(ranked, "ranked")
    candidates = of_runs.join(ranked.filter("so_far >= needed").select("seed", "item"), "seed").select(*document, "item").distinct()
    wanted = ranked.groupBy("item").agg(
        F.map_from_entries(F.collect_list(F.struct("seed", "times"))).alias("of_item"), F.max("needed").alias("needed")
    )
    shared = F.array_intersect("seeds", F.map_keys("of_item"))
    met = candidates.join(runs.select(*document, "run", "words", "seeds"), document).join(wanted, "item")
    gathered = (
        met.withColumn("found", F.aggregate(shared, F.lit(0).cast("bigint"), lambda sum_, seed: sum_ + F.col("of_item")[seed]))
        .filter("found > 0")
        .groupBy(*document, "item")
        .agg(
            F.sort_array(F.collect_list(F.struct("run", "words"))).alias("runs"),
            F.sum("found").alias("found"),
            F.max("needed").alias("needed"),
        )
        .filter("found >= needed")
        .select(*document, "item", F.transform("runs", lambda r: r["words"]).alias("runs"))
        .join(benchmark.select("item", "item_id", F.col("text").alias("item_text")), "item")
    )

    def per_batch(part: pa.RecordBatch) -> dict:
        covered = []
        for item, own in zip(part.column("item_text").to_pylist(), part.column("runs").to_pylist(), strict=True):
            ids: dict[str, int] = {}
            words = [ids.setdefault(w, len(ids) + 1) for w in tokens(item)]
            tiles = tile(words, [[ids.get(w, -1) for w in run] for run in own], rule.least)
            covered.append((len(words), sum(tiles), len(tiles), max(tiles, default=0)))
        names = ("n_words", "n_covered", "n_tiles", "longest")
        same = {name: part.column(name) for name in (*document, "item_id")}
        return same | dict(zip(names, map(list, zip(*covered, strict=True)), strict=True))

    tiled = mapped(
        gathered, per_batch,
        "doc_id bigint, no_id boolean, text_hash bigint, item_id bigint, n_words bigint, n_covered bigint,"
        " n_tiles bigint, longest bigint",
    )
    tiled = tiled.where(F.col("n_covered") * 100 >= F.col("n_words") * rule.percent).withColumn(
        "doc_id", F.when(F.col("no_id"), F.lit(None)).otherwise(F.col("doc_id"))
    )
    short = short_leaks(read, benchmark, rule)
    if short is None:
        return tiled
    n = F.col("n_words")
    return tiled.unionByName(
        short.select(
            "doc_id", F.col("doc_id").isNull().alias("no_id"), "text_hash", "item_id", n,
            n.alias("n_covered"), F.lit(1).cast("bigint").alias("n_tiles"), n.alias("longest"),
        )
    )


def without_leaks(docs: DataFrame, items: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that cover no item, all columns as they are.

    A bit table of the documents to go lets most others pass by; only the rest is shuffled.
    """
    found = leaks(docs, items, rule, key, text)
    names = ["id_or_0", "no_id", "hash"]
    gone = found.select(F.coalesce("doc_id", F.lit(0)).alias("id_or_0"), "no_id", F.col("text_hash").alias("hash")).distinct()
    with small_batches(docs.sparkSession, BATCH):
        gone = written(gone, "gone")
    own = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(0)), F.col(f"`{key}`").isNull(), F.xxhash64(text)
    rows = docs.select(F.struct("*").alias("row"), *(part.alias(name) for part, name in zip(own, names, strict=True)))
    rows = rows.withColumn("row_hash", F.xxhash64(*names))
    bits = BitTable(gone.select(F.xxhash64(*names).alias("row_hash")), "row_hash", rule.filter_bits)
    kept = bits.rows(rows, "row_hash").join(gone, names, "left_anti").select("row.*")
    return bits.rows(rows, "row_hash", among=False).select("row.*").unionByName(kept)
