"""Error labels from JSON replies, and their distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parselab.functions import fixed, replies
from parselab.functions.text import strip
from parselab.operators.prompts import attach_responses, classify_prompts
from parselab.operators.summaries import drop_empty_rows, drop_null_rows


def label_lookup(df: DataFrame, taxonomy: DataFrame, number: str = "number") -> DataFrame:
    """Title of a label number, NULL when the taxonomy has no such number."""
    titles = taxonomy.select(F.col("number").alias("known"), "title")
    return df.join(titles, F.col(number) == F.col("known"), "left").drop("known")


def parse_label(df: DataFrame, taxonomy: DataFrame, response: str = "response") -> DataFrame:
    """Add ``Error_Type`` and ``Error_Number``; replies that cannot be used get number 0 and a code.

    Needs ``answered``: false is a failed call, true with a NULL response a reply without text.
    """
    read = df.withColumn("_text", strip(F.col(response)))
    read = read.withColumn("_slice", replies.json_object_slice(F.col("_text")))
    read = read.withColumn("_json", replies.parse_single(F.col("_slice")))
    read = read.withColumns(
        {
            "_number": replies.label_number(F.col("_json")),
            "_named": replies.label_text(F.col("_json")),
            "_kind": F.schema_of_variant(F.try_variant_get("_json", "$[0]", "variant")),
        }
    )
    known = label_lookup(read, taxonomy.select("number", "title"), "_number")
    failure = (
        F.when(~F.col("answered"), fixed.API_ERROR)
        .when(F.col(response).isNull(), fixed.NO_RESPONSE)
        .when(F.col("_text") == "", fixed.EMPTY_RESPONSE)
        .when(F.col("_slice").isNull(), fixed.NO_JSON)
        .when(F.col("_kind").isNull() | (F.col("_kind") == "OBJECT<>"), fixed.BAD_JSON)
        .when(F.col("title").isNull(), fixed.INVALID_LABEL)
    )
    return known.withColumns(
        {
            "Error_Type": F.coalesce(failure, "_named", "title"),
            "Error_Number": F.when(failure.isNull(), F.col("_number")).otherwise(0),
        }
    ).drop("_text", "_slice", "_json", "_number", "_named", "_kind", "title")


def label_errors(diff: DataFrame, responses: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Label table of the wrong rows that have all fields."""
    whole = drop_empty_rows(drop_null_rows(diff, fixed.DIFF_COLUMNS), fixed.DIFF_COLUMNS)
    labelled = parse_label(attach_responses(classify_prompts(whole, taxonomy), responses), taxonomy)
    kept = [c for c in diff.columns if c not in fixed.PREDICTION_COLUMNS]
    return labelled.select(
        *kept,
        F.col("Content").alias("Original_Log"),
        F.col("EventTemplate").alias("Correct_Template"),
        "Error_Type",
        "Error_Number",
    )


def label_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("Error_Type").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "Error_Type")


def number_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("Error_Number").agg(F.count(F.lit(1)).alias("rows")).orderBy("Error_Number")


def failure_codes(labels: DataFrame) -> DataFrame:
    return labels.filter("Error_Number = 0").groupBy("Error_Type").agg(F.count(F.lit(1)).alias("rows"))
