"""Scoring of predicted templates: outcomes, accuracy, grouping, consistency, leakage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parselab.functions import text
from parselab.operators.passages import passage_leaks  # noqa: F401, found here as well
from parselab.session import cut_lineage


def outcome(prediction: Column, gold: Column) -> Column:
    """``same`` or ``diff``; a missing gold template counts as ``diff``."""
    equal = text.strip(prediction) == text.strip(gold)
    return F.when(equal, F.lit("same")).otherwise(F.lit("diff"))


def score(df: DataFrame, response: str = "response") -> DataFrame:
    """One scored row per log that has a response.

    Adds ``Prediction``, ``Think-Process``, ``tier``, ``outcome`` and ``gold_missing``; rows without
    a response are not scored, as a failed batch is not.
    """
    answered = df.filter(F.col(response).isNotNull())
    output = answered.withColumn("Think-Process", text.normalise_output(F.col(response)))
    output = output.withColumn("found", text.extract_template(F.col("`Think-Process`")))
    # Through a generator, so that a later filter on the result does not run the patterns a second time.
    found = output.select("*", F.inline(F.array("found")))
    return found.select(
        *[c for c in df.columns if c != response],
        F.col("`Think-Process`"),
        F.col("template").alias("Prediction"),
        "tier",
        outcome(F.col("template"), F.col("EventTemplate")).alias("outcome"),
        F.col("EventTemplate").isNull().alias("gold_missing"),
    )


def _correct() -> Column:
    return F.count_if(F.col("outcome") == "same")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


def accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Processed and correct rows and the accuracy in percent; 0 for an empty table."""
    counts = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("processed"), _correct().alias("correct")
    )
    return counts.withColumn("accuracy", percent(F.col("correct"), F.col("processed")))


def coverage(df: DataFrame, response: str = "response", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requested"), F.count(response).alias("processed")
    )


def tier_report(scored: DataFrame) -> DataFrame:
    """Rows per extraction tier and outcome."""
    return scored.groupBy("tier", "outcome").agg(F.count(F.lit(1)).alias("rows"))


def running_accuracy(
    scored: DataFrame,
    by: str = "system",
    order: str = "row_id",
    batch_size: int = 4,
    chunk: int = 65536,
) -> DataFrame:
    """Accuracy after each batch of ``batch_size`` positions.

    Running sums are taken in two levels, batches inside chunks and chunks inside a system, so that
    one large system is not summed up in one task.
    """
    batches = (
        scored.withColumn("batch_id", F.expr(f"`{order}` div {int(batch_size)}"))
        .groupBy(by, "batch_id")
        .agg(F.count(F.lit(1)).alias("rows"), _correct().alias("right"))
        .withColumn("chunk", F.expr(f"batch_id div {int(chunk)}"))
    )
    batches = cut_lineage(batches)  # read twice below, while the logs are read once
    earlier = W.partitionBy(by).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        batches.groupBy(by, "chunk")
        .agg(F.sum("rows").alias("rows"), F.sum("right").alias("right"))
        .select(
            by,
            "chunk",
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
            F.coalesce(F.sum("right").over(earlier), F.lit(0)).alias("right_before"),
        )
    )
    upto = W.partitionBy(by, "chunk").orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)
    return batches.join(offsets, [by, "chunk"]).select(
        by,
        "batch_id",
        (F.col("rows_before") + F.sum("rows").over(upto)).alias("processed"),
        (F.col("right_before") + F.sum("right").over(upto)).alias("correct"),
    ).withColumn("accuracy", percent(F.col("correct"), F.col("processed")))


def grouping_accuracy(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose predicted group is the same row set as their gold group.

    Rows are first counted per (prediction, gold). A row is right when its prediction meets one
    gold template only and that gold template meets no other prediction, so both sides are
    reduced to one row per template before they meet; no group of logs is ever collected.
    """
    by = list(by)
    pairs = scored.groupBy(
        *by, F.col("Prediction").alias("pred"), F.col("EventTemplate").alias("gold")
    ).agg(F.count(F.lit(1)).alias("n"))
    pairs = cut_lineage(pairs)  # read three times below, while the logs are read once
    whole = F.coalesce(F.col("rows"), F.lit(0))

    def lone(one: str, other: str) -> DataFrame:
        met = pairs.groupBy(*by, one).agg(
            F.count(F.lit(1)).alias("partners"), F.first(other).alias(other), F.sum("n").alias("n")
        )
        return met.filter("partners = 1").drop("partners")

    matched = lone("pred", "gold").alias("p").join(
        lone("gold", "pred").alias("g"),
        [F.col(f"p.{c}").eqNullSafe(F.col(f"g.{c}")) for c in [*by, "pred", "gold"]],
        "left_semi",
    )
    right = matched.groupBy(*by).agg(F.sum("n").alias("right"))
    total = pairs.groupBy(*by).agg(F.sum("n").alias("rows"))
    if by:
        joined = total.join(right, by, "left")
    else:
        joined = total.withColumn("right", right.select("right").scalar())
    correct = F.coalesce("right", F.lit(0))
    return joined.select(
        *by,
        whole.alias("rows"),
        correct.alias("correct"),
        percent(correct, whole).alias("grouping_accuracy"),
    )


def template_inventory(logs: DataFrame, by: str = "system") -> DataFrame:
    return logs.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("EventTemplate").alias("templates")
    )


def inconsistent_templates(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gold templates whose logs got more than one predicted template."""
    return (
        scored.groupBy(*by, "EventTemplate")
        .agg(F.count_distinct("Prediction").alias("predictions"), F.count(F.lit(1)).alias("rows"))
        .filter("predictions > 1")
    )


def normalised_log(log: Column) -> Column:
    return F.lower(text.collapse_space(text.strip(log)))


def decontaminate(evaluation: DataFrame, tuning: DataFrame, log: str = "Content") -> DataFrame:
    """Evaluation rows whose normalised log is not in the tuning table."""
    seen = tuning.select(normalised_log(F.col(log)).alias("seen")).distinct()
    return evaluation.join(seen, normalised_log(F.col(log)) == F.col("seen"), "left_anti")


def run_summary(scored: DataFrame, input_file: str, output_dir: str) -> DataFrame:
    """One row of run metrics; an empty run reports 0."""
    return accuracy(scored).select(
        F.lit("success").alias("status"),
        "processed",
        "correct",
        "accuracy",
        F.lit(input_file).alias("input_file"),
        F.lit(output_dir).alias("output_dir"),
    )
