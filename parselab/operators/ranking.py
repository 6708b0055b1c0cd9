"""Seeded order, ranks and samples that hold for any table size.

The order of a row is ``md5(seed | key)``. A rank over the whole table, or over one large stratum, is
never taken in one task: rows fall into buckets by the leading hex digits of their order, which
are uniform however skewed the strata are; bucket sizes give each bucket its offset, and only the
rank inside a bucket needs a window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parselab.functions import fixed
from parselab.session import cut_lineage, written

BUCKET_DIGITS = 4  # 65 536 buckets
SAMPLED = 100_000  # keys from which a cutoff is guessed


def order_of(key: Column, seed: int = fixed.SEED) -> Column:
    """A missing key orders like an empty one."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))))


def bucket_offsets(df: DataFrame, strata: Sequence[str] = (), bucket: str = "bucket") -> DataFrame:
    """Rows that come before each bucket of a stratum: at most 16**digits rows per stratum."""
    sizes = df.groupBy(*strata, bucket).agg(F.count(F.lit(1)).alias("size"))
    before = W.partitionBy(*strata).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(
        *strata, bucket, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset")
    )


def ranked(
    df: DataFrame,
    key: str,
    strata: Sequence[str] = (),
    seed: int = fixed.SEED,
    upto: Column | None = None,
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add ``rank`` (1..) in seeded order, per stratum when given.

    Rows without a stratum have no rank and drop out. With ``upto`` only the rows of rank <= upto come back, and buckets beyond it are dropped before
    any row is shuffled.
    """
    keyed = df.withColumn("hash", order_of(F.col(key), seed))
    keyed = keyed.withColumn("bucket", F.substring("hash", 1, digits))
    offsets = bucket_offsets(keyed, strata)
    if upto is not None:
        offsets = offsets.filter(F.col("offset") < upto)
    if not strata:
        offsets = F.broadcast(offsets)  # never more than 16**digits rows
    names = [*strata, "bucket"]
    joined = keyed.join(offsets, names)
    inside = W.partitionBy(*names).orderBy("hash", key)
    out = joined.withColumn("rank", F.col("offset") + F.row_number().over(inside))
    if upto is not None:
        out = out.filter(F.col("rank") <= upto)
    return out.drop("hash", "bucket", "offset")


def first_n(df: DataFrame, key: str, n: int, seed: int = fixed.SEED) -> DataFrame:
    """The first ``n`` rows in seeded order, cut by bucket, so that no task gets the rows of all others."""
    return ranked(df, key, seed=seed, upto=F.lit(n)).drop("rank")


def sample_rows(df: DataFrame, key: str, n: int | None, seed: int = fixed.SEED) -> DataFrame:
    """``n`` seeded random rows; all rows when the table is not larger."""
    return df if not n else first_n(df, key, n, seed)


def capped_sample(
    df: DataFrame,
    key: str,
    sample_size: int | None,
    cap: int,
    seed: int = fixed.SEED,
) -> DataFrame:
    """A requested sample when it is smaller than the table, else at most ``cap`` rows, with its ``position``.

    The size is not monotone: with 500 requested and a cap of 200, 400 rows give 200 but 501 give 500.
    """
    total = df.agg(F.count(F.lit(1)).alias("n"))
    if sample_size:
        size = F.when(F.col("n") > sample_size, sample_size).otherwise(F.least("n", F.lit(cap)))
    else:
        size = F.least("n", F.lit(cap))
    return ranked(df, key, seed=seed, upto=total.select(size.alias("wanted")).scalar()).withColumnRenamed("rank", "position")


def volume_cap(df: DataFrame, key: str, baseline: DataFrame, seed: int = fixed.SEED) -> DataFrame:
    """Never more rows than the baseline table has."""
    limit = baseline.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ranked(df, key, seed=seed, upto=limit).drop("rank")


def cutoff(keys: DataFrame, n: int, sampled: int = SAMPLED) -> Column | None:
    """A condition that surely holds for the first ``n`` rows in the order of all columns of ``keys``, and for few others.

    About ``sampled`` keys, whatever the size of the table, give a guess; counting the keys below it proves it. None where the guess is
    too low or the table is hardly larger than ``n``.
    """
    total, order = keys.count(), keys.columns
    if total <= 4 * n:
        return None
    share = min(1.0, sampled / total)
    place = math.ceil(n * share + 5 * math.sqrt(n * share + 1)) + 5
    guess = keys.sample(share, fixed.SEED).orderBy(*order).offset(place).limit(1).collect()  # one row
    if not guess:
        return None
    kinds = dict(keys.dtypes)
    bound = F.struct(*[F.lit(guess[0][c]).cast(kinds[c]).alias(c) for c in order])
    below = F.struct(*[F.col(c) for c in order]) <= bound
    return below if keys.filter(below).count() >= n else None


def max_samples(
    df: DataFrame, order: Sequence[str], n: int = fixed.MAX_TUNING_ROWS
) -> DataFrame:
    """The first ``n`` rows by ``order``.

    The keys alone are written; a bound on them leaves out nearly all rows beyond the first ``n`` before anything is shuffled. The rest
    is dealt out by ranges of the order; the sizes of the ranges tell which of them hold the first ``n``, and only the
    last of those is cut. So a task ranks one range, whatever ``n`` is, and the shuffle grows with ``n``.
    """
    below = cutoff(written(df.select(*order), "order"), n)
    few = df if below is None else df.filter(below)
    dealt = cut_lineage(few.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    offsets = bucket_offsets(dealt, bucket="range").filter(F.col("offset") < n)  # a row per range
    inside = W.partitionBy("range").orderBy(*order)
    place = F.col("offset") + F.row_number().over(inside)
    kept = dealt.join(F.broadcast(offsets), "range").withColumn("place_in_all", place)
    return kept.filter(F.col("place_in_all") <= n).drop("range", "offset", "place_in_all")


def frequent_types(df: DataFrame, type_col: str, k: int) -> DataFrame:
    """Rows of the ``k`` most frequent types; equal counts are decided by name."""
    top = (
        df.groupBy(type_col)
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), type_col)
        .limit(k)
        .select(type_col)
    )
    return df.join(F.broadcast(top), type_col, "left_semi")  # ``k`` rows
