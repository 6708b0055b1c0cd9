"""Near duplicates: one-permutation hashing, banded buckets, star-shaped candidate edges, the pairs left in blocks, links on full sets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parselab.llm.common import BitTable, mapped, small_batches, texts
from parselab.session import written

MEMO = 150_000
BATCH = 512  # documents or pairs of sets in one Arrow batch
FILTER_BITS = 1 << 24
BLOCK, BLOCK_SHINGLES = 512, 500_000  # classes of a bucket, and shingles of them, in one block (about, by hash)
COLUMNS_AT_ONCE = 4096
ROW_KEY = ["id_or_0", "no_id", "hash"]


@dataclass(frozen=True)
class Rule:
    """Shingles of ``width`` words; documents with 100 * intersection >= ``percent`` * union are linked.

    ``bins`` (a power of two) values of one permutation, cut into bands of ``rows``. With 256 bins and 6 rows a pair at 80 % shares a
    band with probability 1 - 3e-6, more similar pairs more surely.
    """

    width: int = 5
    percent: int = 80
    bins: int = 256
    rows: int = 6


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _WordHashes()


def word_hashes() -> _WordHashes:
    """The word hashes of this worker; they go on from batch to batch."""
    return _HASHES


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle, one without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and cut at [\x20\x09-\x0D]+
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    found = _mix(ids[: len(ids) - width + 1] + np.uint64(width))
    for k in range(1, width):
        found = _mix(found + ids[k : len(ids) - width + 1 + k] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(found)


@cache
def probe_order(bins: int) -> np.ndarray:
    """For each bin the rank of every bin in its own fixed random order."""
    return np.argsort(np.random.default_rng(5).random((bins, bins)), axis=1).argsort(axis=1).astype(np.uint16)


def signature(values: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """The least hash of each bin (leading bits); an empty bin takes that of the first filled bin in its probe order."""
    starts = np.searchsorted(values >> np.uint64(64 - bins.bit_length() + 1), np.arange(bins + 1, dtype=np.uint64))
    filled = np.flatnonzero(starts[1:] > starts[:-1])
    out = np.zeros(bins, np.uint64)
    out[filled] = values[starts[filled]]
    if len(filled) < bins:
        empty = np.flatnonzero(starts[1:] == starts[:-1])
        out[empty] = out[filled[order[np.ix_(empty, filled)].argmin(axis=1)]]
    return out


def band_keys(values: np.ndarray, rule: Rule, order: np.ndarray) -> np.ndarray:
    bands = rule.bins // rule.rows
    cells = signature(values, rule.bins, order)[: bands * rule.rows].reshape(bands, rule.rows)
    keys = np.arange(bands, dtype=np.uint64)
    for k in range(rule.rows):
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, k])
    return keys


def sketches(df: DataFrame, key: str, text: str, rule: Rule) -> DataFrame:
    """doc_id, text_hash, n, cls (128 bits over the shingle set; null without words), bands."""
    read = df.select(
        F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")
    )

    def per_batch(part: pa.RecordBatch) -> dict:
        hashes, order = word_hashes(), probe_order(rule.bins)
        n, cls, bands = [], [], []
        for t in texts(part):
            values = shingles(t, rule.width, hashes)
            n.append(len(values))
            cls.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
            bands.append(band_keys(values, rule, order).view(np.int64) if len(values) else None)
        return {"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "n": n, "cls": cls, "bands": bands}

    return mapped(read, per_batch, "doc_id bigint, text_hash bigint, n bigint, cls binary, bands array<bigint>")


def _row_key(doc_id: Column, text_hash: Column) -> list[Column]:
    """A row's id and text as plain keys: joins and groups on them share one partitioning, nulls included."""
    parts = F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), text_hash
    return [part.alias(name) for part, name in zip(parts, ROW_KEY, strict=True)]


def shingle_sets(df: DataFrame, key: str, text: str, rule: Rule, nodes: DataFrame) -> DataFrame:
    """no, values for the classes in ``nodes`` (no, cls, doc_id, text_hash), each from the row it names.

    A bit table of the text hashes keeps most other texts from the shuffle.
    """
    read = df.select(F.col(text).alias("text"), *_row_key(F.col(key).cast("bigint"), F.xxhash64(text)))
    read = BitTable(nodes, "text_hash", FILTER_BITS).rows(read, "hash")
    named = nodes.select("no", F.col("cls").alias("wanted"), *_row_key(F.col("doc_id"), F.col("text_hash")))
    once = read.join(named, ROW_KEY).groupBy(*ROW_KEY).agg(*(F.first(c).alias(c) for c in ("no", "wanted", "text")))

    def per_batch(part: pa.RecordBatch) -> dict:
        hashes = word_hashes()
        made = [shingles(t, rule.width, hashes).tobytes() for t in texts(part)]
        same = {name: part.column(name) for name in ("no", "wanted")}
        return same | {"cls": [xxhash.xxh3_128_digest(v) for v in made], "values": made}

    made = mapped(once.select("no", "wanted", "text"), per_batch, "no bigint, wanted binary, cls binary, values binary")
    return made.where("cls = wanted").select("no", "values")


def _close(a: Column, b: Column, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("no")).select(F.xxhash64("no").alias("end"))
    needed = BitTable(ends, "end", FILTER_BITS).rows(sets.withColumn("end", F.xxhash64("no")), "end")
    left = needed.select(F.col("no").alias("a"), F.col("values").alias("of_a"))
    right = needed.select(F.col("no").alias("b"), F.col("values").alias("of_b"))
    pairs = edges.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")

    def run(parts):
        for part in parts:
            keep = []
            for x, y in zip(part.column("of_a"), part.column("of_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # two sorted runs
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """no, comp: the least class that can be reached, for every class of a link (a, b).

    Labels pass along links and then jump to the label's label, so rounds grow with the logarithm of a component's
    diameter. Each round is written; it stops when no label changes.
    """
    both = written(links.union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("no"), F.least("a", "m").alias("comp")), "labels")
    while True:
        heard = (
            both.join(labels.toDF("b", "heard"), "b").groupBy("a").agg(F.min("heard").alias("heard")).withColumnRenamed("a", "no")
        )
        step = labels.join(heard, "no").select("no", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        jump = labels.toDF("comp", "next")
        moved = written(
            step.join(jump, "comp").select("no", F.least("comp", "next").alias("comp"), "old"), "labels"
        )
        labels = moved.select("no", "comp")
        if not moved.where("comp <> old").limit(1).count():
            return labels


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, and text_hash, cls, representative.

    Equal sets are one class before anything else, so exact copies cost one row each. Classes that share a bucket form a
    star around the class that meets most others over all its buckets (an original among its copies); edges are checked on
    the full sets. In buckets whose other classes still lie in several components every pair from two components is then
    compared on the full sets, in blocks of bounded size, so no pair of classes that share a bucket stays untested. Hot buckets
    are reduced to a centre before the shuffle; the join back splits by size.

    Texts without words (null, empty) are linked with nothing: their component is their own doc_id. Repeated rows are
    copies; a null doc_id counts as no id for the least id. An empty table gives no rows; other columns are not read.
    """
    with small_batches(df.sparkSession, BATCH):
        made = written(sketches(df, key, text, rule), "sketches")
        classes = written(
            made.where("cls is not null").groupBy("cls").agg(
                F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row"),
                F.any_value("n").alias("n"),
                F.any_value("bands").alias("bands"),
            ).select("cls", "n", "bands", "row.doc_id", "row.text_hash", F.monotonically_increasing_id().alias("no")),
            "classes",
        )
        in_bands = classes.select(F.explode("bands").alias("bucket"), "no", F.col("n").cast("int").alias("n"))
        shared = in_bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        placed = written(in_bands.join(shared, "bucket"), "buckets")
        ranks = placed.groupBy("no").agg(F.sum("size").alias("met"))
        members = written(placed.join(ranks, "no"), "members")
        centres = members.groupBy("bucket").agg(F.max(F.struct("met", "no", "n")).alias("centre"))
        around = members.join(centres, "bucket").where(F.col("no") != F.col("centre.no"))
        edges = written(
            around.where(_close(F.col("n"), F.col("centre.n"), rule.percent))
            .select(F.least("no", "centre.no").alias("a"), F.greatest("no", "centre.no").alias("b"))
            .distinct(),
            "edges",
        )
        nodes = written(ranks.select("no").join(classes.select("no", "cls", "doc_id", "text_hash"), "no"), "nodes")
        sets = written(shingle_sets(df, key, text, rule, nodes), "sets")
        found = components(written(confirmed(edges, sets, rule.percent), "linked"))
        labels = written(nodes.join(found, "no", "left").select("no", F.coalesce("comp", "no").alias("comp")), "labels")
        # The centre of a bucket has been tried against all others, or their sizes rule the pair out.
        rest = written(around.where("size > 2").select("bucket", "no", "n").join(labels, "no"), "rest")
        return _labelled(made, classes, _joined(labels, written(_compared(_blocks(rest), sets, rule.percent), "linked")))


def _blocks(rest: DataFrame) -> DataFrame:
    """bucket, i, j, own, no, comp: the members (bucket, no, n, comp) of open buckets, once for each pair of blocks they are in.

    Classes of a bucket's largest component lie in blocks of their own, which do not meet each other: their pairs would join
    nothing. All other pairs of classes of a bucket meet in just one pair of blocks. Of buckets with the same members one is read.
    """
    parts = rest.groupBy("bucket", "comp").agg(
        F.count("*").alias("size"),
        F.sum("n").alias("total"),
        F.bit_xor(F.xxhash64("no")).alias("x"),
        F.bit_xor(F.xxhash64("no", F.lit(1))).alias("y"),
    )
    open_ = (
        parts.groupBy("bucket")
        .agg(
            F.max(F.struct("size", "comp", "total")).alias("most"),
            F.sum("size").alias("size"),
            F.sum("total").alias("total"),
            F.bit_xor("x").alias("x"),
            F.bit_xor("y").alias("y"),
        )
        .where("size > most.size")
        .groupBy("x", "y", "size", "total")
        .agg(F.min_by("most", "bucket").alias("most"), F.min("bucket").alias("bucket"))
    )

    def needed(size: Column, total: Column) -> Column:
        return F.greatest(F.ceil(size / BLOCK), F.ceil(total / BLOCK_SHINGLES)).cast("int")

    counted = open_.select(
        "bucket",
        F.col("most.comp").alias("main"),
        needed(F.col("size") - F.col("most.size"), F.col("total") - F.col("most.total")).alias("others"),
        needed(F.col("most.size"), F.col("most.total")).alias("mains"),
    )
    dealt = rest.join(counted, "bucket").withColumn(
        "own",
        F.when(F.col("comp") == F.col("main"), F.col("others") + F.pmod(F.xxhash64("no"), "mains"))
        .otherwise(F.pmod(F.xxhash64("no"), "others")).cast("int"),
    )
    last = F.when(F.col("own") < F.col("others"), F.col("others") + F.col("mains")).otherwise(F.col("others")) - 1
    met = dealt.select("bucket", "own", "no", "comp", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return met.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "no", "comp")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common values of each set on the left with each on the right."""
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(v) for v in (*left, *right)])
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    columns = np.cumsum(count > 1) - 1  # a value of one set is in no pair
    several = count[at] > 1
    owner, at = owner[several], columns[at[several]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    found = np.zeros((len(left), len(right)))
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, COLUMNS_AT_ONCE):
        a, z = np.searchsorted(at, (start, start + COLUMNS_AT_ONCE))
        holds = np.zeros((len(left) + len(right), min(COLUMNS_AT_ONCE, int(columns[-1]) + 1 - start)), np.float32)
        holds[owner[a:z], at[a:z] - start] = 1
        found += holds[: len(left)] @ holds[len(left) :].T
    return found


def _between(own: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of components that a similar pair of sets joins, as few as join them; ``own`` tells the two blocks apart."""
    left = np.flatnonzero(own == own.min())
    right = np.flatnonzero(own != own.min())
    right = right if len(right) else left
    sizes = np.array([len(v) for v in sets])
    shared = _overlaps([sets[k] for k in left], [sets[k] for k in right])
    union = sizes[left][:, None] + sizes[right][None, :] - shared
    x, y = np.nonzero((100 * shared >= percent * union) & (comps[left][:, None] != comps[right][None, :]))
    pairs = np.unique(np.sort(np.stack((comps[left][x], comps[right][y]), axis=1), axis=1), axis=0)
    top: dict[int, int] = {}

    def root(c: int) -> int:
        while c in top:
            c = top[c]
        return c

    joining = []
    for a, b in pairs.tolist():
        p, q = root(a), root(b)
        if p != q:
            top[max(p, q)] = min(p, q)
            joining.append((a, b))
    return joining


def _compared(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: components that a pair of similar full sets joins, from all pairs of classes of two components in each pair of blocks."""
    keys = ["bucket", "i", "j"]
    rows = blocks.join(sets, "no").repartition(*keys).sortWithinPartitions(*keys)

    def run(parts):
        key, own, comps, held = None, [], [], []

        def ended():
            found = _between(np.array(own), np.array(comps, np.int64), held, percent) if len(set(comps)) > 1 else []
            return pa.RecordBatch.from_pydict(
                {"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())}
            )

        for part in parts:
            columns = [part.column(name).to_pylist() for name in (*keys, "own", "comp")]
            for *at, block, comp, value in zip(*columns, part.column("values"), strict=True):
                if at != key:
                    yield ended()
                    key, own, comps, held = at, [], [], []
                own.append(block)
                comps.append(comp)
                held.append(np.frombuffer(value.as_py(), np.uint64))
        yield ended()

    return rows.select(*keys, "own", "comp", "values").mapInArrow(run, "a bigint, b bigint").distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links (a, b) between components."""
    new = labels.join(components(links).toDF("comp", "new"), "comp", "left")
    return written(new.select("no", F.coalesce("new", "comp").alias("comp")), "labels")


def _labelled(made: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    placed = classes.select("no", "cls", "doc_id", "text_hash").join(labels, "no", "left").withColumn("comp", F.coalesce("comp", "no"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "cls", "text_hash")
    first = written(placed.groupBy("comp").agg(F.min(row).alias("first")), "first")  # so that the join can split a large component
    of_class = placed.select("cls", "comp").join(first, "comp").select("cls", "first")
    return made.select("doc_id", "n", "text_hash", "cls").join(of_class, "cls", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        "text_hash",
        F.col("cls").alias("cls"),
        (F.col("cls").isNull() | (
            F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("cls") == F.col("first.cls"))
            & (F.col("text_hash") == F.col("first.text_hash"))
        )).alias("representative"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One row of each group of near duplicates, all its columns: that of the least (doc_id, text); texts without words stay.

    Rows that repeat a document (same id, same text) are one; the first in the order of the other columns stays.
    """
    found = near_duplicates(df, key, text, rule).where("representative and cls is not null")
    chosen = found.select(*_row_key(F.col("doc_id"), F.col("text_hash")))
    wordless = ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = df.select(
        F.struct("*").alias("row"), wordless.alias("wordless"), *_row_key(F.col(key).cast("bigint"), F.xxhash64(text))
    )
    kept = rows.where("not wordless").join(chosen, ROW_KEY, "left_semi").groupBy(ROW_KEY).agg(F.min("row").alias("row"))
    return kept.select("row").unionByName(rows.where("wordless").select("row")).select("row.*")
