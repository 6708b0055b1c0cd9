"""Row clean-up and error summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parselab.functions import fixed
from parselab.functions.text import clean_reasoning, last_paragraph, shorten, strip, summary_by_marker
from parselab.operators.prompts import attach_responses, error_prompts
from parselab.operators.ranking import capped_sample


def drop_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=[f"`{c}`" if "-" in c else c for c in columns])


def drop_empty_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows where every field has at least one character."""
    for column in columns:
        df = df.filter(F.length(F.col(f"`{column}`")) > 0)
    return df


def clean_summaries(df: DataFrame, column: str = "error_summary") -> DataFrame:
    """Stripped summaries of more than ten characters."""
    return df.withColumn(column, strip(F.col(column))).filter(F.length(column) > fixed.SUMMARY_MIN)


def with_summary(
    df: DataFrame, response: str = "response", into: str = "error_summary", mode: str = "observed"
) -> DataFrame:
    """Add the error summary in a reply; '' when the reply is blank.

    ``observed`` always ends at the last paragraph, as the marker rule finds an empty text;
    ``intended`` takes the text after the last marker first. Each step is a column of its own, so
    that the patterns run once.
    """
    read = df.withColumn("_clean", clean_reasoning(F.col(response)))
    read = read.withColumn("_found", last_paragraph(F.col("_clean")))
    if mode == "intended":
        read = read.withColumn("_marked", summary_by_marker(F.col("_clean")))
        read = read.withColumn("_found", F.when(F.col("_marked") != "", F.col("_marked")).otherwise(F.col("_found")))
    return read.withColumn(into, F.coalesce(shorten(F.col("_found")), F.lit(""))).drop(
        "_clean", "_found", "_marked"
    )


def both_summaries(df: DataFrame, response: str = "response") -> DataFrame:
    """``with_summary`` in both modes, as columns ``observed`` and ``intended``; the reply is cleaned once."""
    read = df.withColumn("_clean", clean_reasoning(F.col(response)))
    read = read.withColumns({"_last": last_paragraph(F.col("_clean")), "_marked": summary_by_marker(F.col("_clean"))})
    marked = F.when(F.col("_marked") != "", F.col("_marked")).otherwise(F.col("_last"))
    both = {"observed": F.col("_last"), "intended": marked}
    named = {mode: F.coalesce(shorten(found), F.lit("")) for mode, found in both.items()}
    return read.withColumns(named).drop("_clean", "_last", "_marked")


def error_replies(diff: DataFrame, responses: DataFrame) -> DataFrame:
    """Wrong rows that have all fields, with their reply; a failed call gives an empty text."""
    complete = drop_null_rows(diff, fixed.DIFF_COLUMNS)
    replied = attach_responses(error_prompts(complete), responses)
    return replied.withColumn("response", F.coalesce("response", F.lit("")))


def summarise_errors(diff: DataFrame, responses: DataFrame, mode: str = "observed") -> DataFrame:
    """Error summary per wrong row."""
    kept = [c for c in diff.columns if c not in fixed.PREDICTION_COLUMNS]
    return with_summary(error_replies(diff, responses), mode=mode).select(
        *kept,
        F.col("Content").alias("original_log"),
        F.col("EventTemplate").alias("correct_template"),
        "error_summary",
    )


def summary_overview(
    summaries: DataFrame,
    column: str = "error_summary",
    sample_size: int | None = 500,
    cap: int = fixed.SUMMARY_CAP["reasoner"],
) -> DataFrame:
    """Total, valid and sampled rows in one pass."""
    counts = summaries.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.length(strip(F.col(column))) > fixed.SUMMARY_MIN).alias("valid"),
    )
    capped = F.least("valid", F.lit(cap))
    if sample_size:
        capped = F.when(F.col("valid") > sample_size, sample_size).otherwise(capped)
    return counts.withColumn("sampled", capped.cast("bigint"))


def summary_corpus(
    summaries: DataFrame,
    key: str,
    column: str = "error_summary",
    sample_size: int | None = 500,
    cap: int = fixed.SUMMARY_CAP["reasoner"],
    seed: int = fixed.SEED,
) -> DataFrame:
    """One row: the sampled summaries as a list text, in sample order. Never more than the sample."""
    sampled = capped_sample(clean_summaries(summaries, column), key, sample_size, cap, seed)
    return sampled.agg(
        F.array_sort(F.collect_list(F.struct("position", F.col(column).alias("summary")))).alias("kept")
    ).select(
        F.array_join(F.transform("kept.summary", lambda s: F.concat(F.lit("- "), s, F.lit("\n\n"))), "").alias(
            "corpus"
        )
    )
