"""Seed choice: strata, seeded shuffle, round robin, and the summary of each seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parselab.functions import fixed
from parselab.functions.text import strip
from parselab.operators.ranking import ranked


def strata(df: DataFrame, column: str = "Error_Number") -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def stratified_shuffle(
    df: DataFrame, key: str, strata_by: str = "Error_Number", seed: int = fixed.SEED
) -> DataFrame:
    """Position of every row in the seeded order of its stratum."""
    return ranked(df, key, [strata_by], seed)


def round_robin(
    df: DataFrame,
    n: int,
    key: str,
    strata_by: str = "Error_Number",
    seed: int = fixed.SEED,
    include_failed: bool = True,
) -> DataFrame:
    """Fill ``n`` slots by turns; slot i belongs to stratum i mod K, and an empty turn is lost.

    A stratum gives at most its first ceil(n / K) rows, which are ranked in buckets, so a large stratum
    is spread over many tasks for any ``n``. Only the table of strata, one row each, is numbered as a whole.
    """
    rows = df if include_failed else df.filter(F.col("Error_Number") != 0)
    named = rows.select(strata_by).distinct()
    most = named.agg(F.ceil(F.lit(n) / F.greatest(F.count(F.lit(1)), F.lit(1)))).scalar()
    numbered = named.select(
        strata_by,
        (F.row_number().over(W.orderBy(strata_by)) - 1).alias("index"),
        F.count(F.lit(1)).over(W.partitionBy()).alias("strata"),
    )
    return (
        ranked(rows, key, [strata_by], seed, upto=most)
        .join(numbered, strata_by)
        .withColumn("slot", (F.col("rank") - 1) * F.col("strata") + F.col("index"))
        .filter(F.col("slot") < n)
        .drop("rank", "index", "strata")
    )


def dedup_keep_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the last one. Each task keeps its own last row before the shuffle."""
    last = W.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("back", F.row_number().over(last)).filter("back = 1").drop("back")


def _text(column: Column, mode: str) -> Column:
    """A missing cell reads ``nan`` as observed."""
    return F.coalesce(column, F.lit("nan")) if mode == "observed" else column


def attach_summaries(
    seeds: DataFrame, summaries: DataFrame, order: str, mode: str = "observed"
) -> DataFrame:
    """Summary of each seed by stripped log and template; the last one counts, none gives ''.

    Only the summaries of seeds pass on: the many other rows stop at the semi join.
    """
    keyed = seeds.withColumns(
        {
            "_log": strip(_text(F.col("Original_Log"), mode)),
            "_template": strip(_text(F.col("Correct_Template"), mode)),
        }
    )
    keys = ["_log", "_template"]
    found = summaries.select(
        strip(_text(F.col("original_log"), mode)).alias("_log"),
        strip(_text(F.col("correct_template"), mode)).alias("_template"),
        _text(F.col("error_summary"), mode).alias("error_summary"),
        F.col(order).alias("_order"),
    )
    wanted = found.join(keyed.select(*keys).distinct(), keys, "left_semi")
    last = dedup_keep_last(wanted, keys, "_order").drop("_order")
    return keyed.join(last, keys, "left").drop(*keys).withColumn(
        "error_summary", F.coalesce("error_summary", F.lit(""))
    )


def seed_columns(seeds: DataFrame) -> DataFrame:
    return seeds.select(*fixed.SEED_COLUMNS)


def seed_stats(seeds: DataFrame) -> DataFrame:
    """Seeds with and without summary, per stratum and over all (``Error_Number`` NULL), in one pass."""
    return seeds.rollup("Error_Number").agg(
        F.count(F.lit(1)).alias("seeds"),
        F.count_if(F.col("error_summary") != "").alias("with_summary"),
        F.count_if(F.col("error_summary") == "").alias("without_summary"),
    )


def selection_distribution(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy("Error_Number").agg(F.count(F.lit(1)).alias("seeds"))
