"""Readers and writers for the tables of a run. Paths are any the cluster can reach.

CSV cells may hold line ends; a file is read by many tasks all the same (``split_csv``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parselab.functions import fixed
from parselab.functions.text import na_words
from parselab.sources import split_csv

_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str] | T.StructType, na: bool = False, split: bool = True
) -> DataFrame:
    """Cells as text, never inferred; ``na`` turns the usual words for a missing value into NULL.

    With ``split`` a file is read by as many tasks as it has splits. Files with quotes in unquoted cells, or with carriage returns alone as
    record ends, are read without it, by one task each.
    """
    schema = columns if isinstance(columns, T.StructType) else text_schema(columns)
    if split:
        df = split_csv.read(spark, path, schema, _CSV)
    else:
        df = spark.read.schema(schema).options(multiLine="true", **_CSV).csv(path)
    if na:
        text = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
        df = df.withColumns({c: na_words(F.col(f"`{c}`")) for c in text})
    return df


def read_logs(
    spark: SparkSession, path: str, columns: Sequence[str] = fixed.LOG_COLUMNS, fmt: str = "csv", na: bool = False
) -> DataFrame:
    """Labelled logs from CSV or parquet. A parquet file must hold the columns; more are tolerated."""
    if fmt == "csv":
        return read_csv(spark, path, columns, na)
    df = require(spark.read.format(fmt).load(path), columns)
    return df.select(*[F.col(f"`{c}`") for c in columns])


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; found {df.columns}")
    return df


def required_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per required column: is it there, and how many of the rows lack a value. One pass."""
    there = [c for c in columns if c in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_null_{at}") for at, c in enumerate(there)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(c in there).alias("present"),
            F.col("_rows").alias("rows"),
            (F.col(f"_null_{there.index(c)}") if c in there else F.col("_rows")).alias("missing"),
        )
        for c in columns
    ]
    return counts.select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files, one row each."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def write_outcomes(scored: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Predictions split by outcome: the same / diff tables are the partitions of one write."""
    columns = [F.col(f"`{c}`") for c in fixed.PREDICTION_COLUMNS]
    writer = scored.select(*columns, "outcome").write.mode("overwrite").partitionBy("outcome")
    (writer.options(**_CSV).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows to a CSV table, every cell quoted, one header per file."""
    df.write.mode("append").options(quoteAll="true", **_CSV).csv(path)


def overwrite_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_CSV).csv(path)


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add rows to a stage table: Parquet, or CSV for people (one CSV file is read back by one task)."""
    append_csv(df, path) if fmt == "csv" else df.write.mode("append").format(fmt).save(path)


def overwrite_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    overwrite_csv(df, path) if fmt == "csv" else df.write.mode("overwrite").format(fmt).save(path)


def write_tuning(tuning: DataFrame, path: str) -> None:
    """Tuning records as JSON lines, non-ASCII text unescaped."""
    tuning.select(*fixed.TUNING_COLUMNS).write.mode("overwrite").json(path)


def write_run_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def write_blocks(blocks: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """A taxonomy document as text files in block order; with ``by`` one folder per document."""
    if by:
        blocks.repartition(*by).sortWithinPartitions(*by, "block").select(*by, "text").write.mode(
            "overwrite"
        ).partitionBy(*by).text(path)
    else:
        blocks.orderBy("block").select("text").write.mode("overwrite").text(path)
