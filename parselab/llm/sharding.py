"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parselab.session import written

BUCKETS = 1024


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key (Lamping and Veach). Appending a shard moves keys into it only."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), np.int64)
    step = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = step[moving]
        state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        step[moving] = ((shard[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moving = moving[step[moving] < shards]
    return shard


def shard_of(key, shards: int):
    """Column expression: the shard of a 64-bit key column."""

    @F.pandas_udf("int")
    def assign(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return assign(key)


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    The hashed key and the number of shards decide the shard. ``slot`` counts from 0 without gaps inside a shard; rows
    are ordered within hashed buckets, whose counts (shards * ``BUCKETS`` rows) give the offsets, so no shard is sorted
    as one and repeated keys spread over all buckets. A null key is a key like any other; a null text has size 1
    and the checksum of the empty text; an empty table gives no rows. Other columns are not read.
    """
    rows = df.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    hashed = rows.withColumn("hash", F.xxhash64("key"))
    placed = written(
        hashed.select(
            "key", "size", "text_crc32", "row",
            shard_of(F.col("hash"), shards).alias("shard"),
            shard_of(F.col("hash"), shards + 1).alias("grown_shard"),
            F.pmod(F.xxhash64("row"), F.lit(BUCKETS)).cast("int").alias("bucket"),
        ),
        "shards",
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size", "row")
    return (
        placed.withColumn("place", F.row_number().over(inside))
        .join(F.broadcast(offsets), ["shard", "bucket"])
        .select(
            F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("base") + F.col("place") - 1).alias("slot"), "grown_shard",
        )
    )
