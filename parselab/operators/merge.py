"""Merging of near-duplicate error types by embedding similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parselab.functions import fixed
from parselab.operators.vectors import Found, block_products, bounded_pairs, in_order
from parselab.session import cut_lineage


def embed_attach(
    taxonomy: DataFrame, embeddings: DataFrame, key: str = "number", vector: str = "vector"
) -> DataFrame:
    """Vector per type from a stored embedding table."""
    return taxonomy.join(embeddings.select(key, vector), key)


def call_embedder(
    texts: DataFrame,
    make_client: Callable[[], Callable[[list[str]], list[list[float]]]],
    text: str = "embed_text",
) -> DataFrame:
    """Vector per text from a user-supplied model, one call per Arrow batch."""
    schema = T.StructType([*texts.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            yield batch.assign(vector=client(batch[text].tolist()))

    return texts.mapInPandas(run, schema)


def similar_pairs(
    types: DataFrame,
    threshold: float = fixed.SIMILARITY_THRESHOLD,
    pos: str = "pos",
    vector: str = "vector",
    block_rows: int = 2048,
) -> DataFrame:
    """Pairs ``i < j`` with cosine above ``threshold``, as ``(i, j, sim)``. Exact; ``vectors.hashed_pairs`` is the cheaper search."""
    return bounded_pairs(types, threshold, pos, vector, block_rows)


def threshold_sweep(pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Pairs above each threshold, from one pass over the pairs of the lowest one."""
    counts = pairs.agg(
        *[F.count_if(F.col("sim") > t).alias(f"above_{at}") for at, t in enumerate(thresholds)]
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(float(t)).alias("threshold"), F.col(f"above_{at}").alias("pairs"))
                for at, t in enumerate(thresholds)
            ]
        )
    )
    return counts.select(rows.alias("row")).select("row.*")


def type_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy(F.col("Error_Type").alias("title")).agg(F.count(F.lit(1)).alias("rows"))


def titled(taxonomy: DataFrame, counts: DataFrame) -> DataFrame:
    """Place, title and row count per type; a type without rows counts 0."""
    return taxonomy.select("pos", "title").join(counts, "title", "left").select(
        "pos", "title", F.coalesce("rows", F.lit(0)).alias("rows")
    )


def pair_counts(pairs: DataFrame, taxonomy: DataFrame, counts: DataFrame) -> DataFrame:
    """Pairs with both titles and their row counts; a type without rows counts 0."""
    named = titled(taxonomy, counts)

    def side(place: str, at: str) -> DataFrame:
        return named.select(
            F.col("pos").alias(place), F.col("title").alias(f"type_{at}"), F.col("rows").alias(f"count_{at}")
        )

    return pairs.join(side("i", "1"), "i").join(side("j", "2"), "j")


def merge_plan(counted: DataFrame) -> DataFrame:
    """One row per losing type: ``from_type, to_type, seq``.

    The type with fewer rows loses, on a tie the earlier one. Pairs count in the order of (i, j): a
    later pair overwrites the target, while the first pair of a type fixes its place in the plan.
    """
    first_wins = F.col("count_1") > F.col("count_2")
    decided = counted.select(
        F.when(first_wins, F.col("type_2")).otherwise(F.col("type_1")).alias("from_type"),
        F.when(first_wins, F.col("type_1")).otherwise(F.col("type_2")).alias("winner"),
        F.struct("i", "j").alias("pair"),
    )
    return decided.groupBy("from_type").agg(
        F.max_by("winner", "pair").alias("to_type"), F.min("pair").alias("seq")
    )


def _with_titles(types: DataFrame, counts: DataFrame) -> DataFrame:
    """Types with the titles and row counts of their place, which travel with the vectors."""
    lists = titled(types, counts).groupBy("pos").agg(F.collect_list(F.struct("title", "rows")).alias("titles"))
    return types.select("pos", "vector").join(lists, "pos")


def _by_title(table: pa.Table, found: Found) -> Iterator[tuple[pa.Array, np.ndarray, tuple[np.ndarray, ...]]]:
    """All titles and row counts of a task, and per pair of blocks: i, j, sim and the entries of their titles."""
    titles = table.column("titles").combine_chunks()
    size = titles.value_lengths().to_numpy()
    start, flat, pos = np.cumsum(size) - size, titles.flatten(), table.column("pos").to_numpy()
    for at, to, sim in in_order(pos, found):
        times = size[at] * size[to]  # a place given twice has two titles
        pair = np.repeat(np.arange(len(at)), times)
        turn = np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times)
        one, two = start[at[pair]] + turn // size[to[pair]], start[to[pair]] + turn % size[to[pair]]
        yield flat.field("title"), flat.field("rows").to_numpy(), (pos[at[pair]], pos[to[pair]], sim[pair], one, two)


def counted_pairs(types: DataFrame, counts: DataFrame, threshold: float, block_rows: int = 2048) -> DataFrame:
    """``pair_counts`` of ``similar_pairs``: titles travel with the vectors, so the pairs themselves are not shuffled."""

    def name(table: pa.Table, found: Found) -> Iterator[pa.RecordBatch]:
        for title, rows, (i, j, sim, one, two) in _by_title(table, found):
            yield pa.RecordBatch.from_arrays(
                [pa.array(j), pa.array(i), pa.array(sim), title.take(pa.array(one)), pa.array(rows[one]),
                 title.take(pa.array(two)), pa.array(rows[two])],
                ["j", "i", "sim", "type_1", "count_1", "type_2", "count_2"],
            )

    schema = "j long, i long, sim double, type_1 string, count_1 long, type_2 string, count_2 long"
    return block_products(_with_titles(types, counts), threshold, "pos", "vector", block_rows, schema, name, ["titles"])


def similar_plan(types: DataFrame, counts: DataFrame, threshold: float, block_rows: int = 2048) -> DataFrame:
    """``merge_plan`` of ``counted_pairs``; a task gives one row per losing type, its last winner and its first and last pair."""

    def fold(table: pa.Table, found: Found) -> Iterator[pa.RecordBatch]:
        known = None
        for title, rows, (i, j, _, one, two) in _by_title(table, found):
            if known is None:
                known = np.zeros(len(rows), bool)
                first, last, winner = np.zeros((2, len(rows)), np.int64), np.zeros((2, len(rows)), np.int64), np.zeros(len(rows), np.int64)
            first_wins = rows[one] > rows[two]
            loser, other = np.where(first_wins, two, one), np.where(first_wins, one, two)
            order = np.lexsort((j, i, loser))
            ends = np.flatnonzero(np.diff(loser[order], append=-1))
            begins = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)[: len(ends)]
            lost = loser[order[ends]]
            for places, at, later in ((last, order[ends], True), (first, order[begins], False)):
                (a, b), (x, y) = (places[:, lost] if later else (i[at], j[at])), ((i[at], j[at]) if later else places[:, lost])
                takes = ~known[lost] | (a < x) | ((a == x) & (b < y))
                places[:, lost[takes]] = i[at[takes]], j[at[takes]]
                if later:
                    winner[lost[takes]] = other[at[takes]]
            known[lost] = True
        if known is not None:
            at = np.flatnonzero(known)
            yield pa.RecordBatch.from_arrays(
                [title.take(pa.array(at)), title.take(pa.array(winner[at])), *(pa.array(p[at]) for p in (*first, *last))],
                ["from_type", "winner", "i", "j", "last_i", "last_j"],
            )

    schema = "from_type string, winner string, i long, j long, last_i long, last_j long"
    folded = block_products(_with_titles(types, counts), threshold, "pos", "vector", block_rows, schema, fold, ["titles"])
    return folded.groupBy("from_type").agg(
        F.max_by("winner", F.struct("last_i", "last_j")).alias("to_type"), F.min(F.struct("i", "j")).alias("seq")
    )


def resolve_plan(plan: DataFrame, mode: str = "observed") -> DataFrame:
    """Final target of every plan row: ``from_type, to_type``.

    ``observed`` applies the plan once in its own order, so a chain stops where the next step came
    earlier; ``intended`` follows it to the root. Both double the reach in each round, which needs
    about log2(types) rounds, and stop when nothing moves. Only equal titles can close a circle;
    that is an error in ``intended``.
    """
    steps = plan.select(
        "from_type", "to_type", F.col("seq").alias("first"), F.col("seq").alias("last")
    )
    if mode == "intended":
        steps = steps.filter("from_type <> to_type")
    follows = F.lit(True) if mode == "intended" else F.col("n.first") > F.col("s.last")
    steps = cut_lineage(steps)
    for _ in range(steps.count().bit_length() + 1):
        nxt = steps.alias("s").join(
            steps.alias("n"), (F.col("s.to_type") == F.col("n.from_type")) & follows, "left"
        )
        longer = cut_lineage(
            nxt.select(
                "s.from_type",
                F.coalesce("n.to_type", "s.to_type").alias("to_type"),
                "s.first",
                F.coalesce("n.last", "s.last").alias("last"),
                F.col("n.from_type").isNotNull().alias("moved"),
            )
        )
        steps = longer.drop("moved")
        if longer.filter("moved").isEmpty():
            return steps.select("from_type", "to_type")
    raise ValueError("the merge plan runs in a circle: two types share a title")


def apply_merge(labels: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rewrite ``Error_Type``; ``Error_Number`` stays as it is."""
    joined = labels.join(resolved, labels["Error_Type"] == resolved["from_type"], "left")
    return joined.withColumn("Error_Type", F.coalesce("to_type", "Error_Type")).drop("from_type", "to_type")


def merge_effect(counts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rows per type before and after, and rows that leave it.

    A plan moves all rows of a type, so the counts per type are enough: the facts are read once.
    """
    moved = counts.join(resolved, F.col("title") == F.col("from_type"), "left").select(
        "title",
        F.coalesce("to_type", "title").alias("final"),
        "rows",
        F.when(F.col("to_type") != F.col("title"), F.col("rows")).otherwise(0).alias("leaving"),
    )
    before = moved.select("title", F.col("rows").alias("before"), F.col("leaving").alias("moved"))
    after = moved.groupBy(F.col("final").alias("title")).agg(F.sum("rows").alias("after"))
    return before.join(after, "title", "full").select(
        F.col("title").alias("Error_Type"),
        F.coalesce("before", F.lit(0)).alias("before"),
        F.coalesce("after", F.lit(0)).alias("after"),
        F.coalesce("moved", F.lit(0)).alias("moved"),
    )
