"""Sharding: a Feistel permutation of the global row numbers.

Rows are numbered 0 to n-1 by (hash bucket, id, contents); a keyed Feistel
network over the smallest balanced domain that holds n permutes the numbers,
and a number that lands outside is permuted again until it lies inside (cycle
walking). The place p gives shard p mod k and slot p div k, so every
shard's size and every row's shard and slot can be computed without moving rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

SHARDS = 16
SEED = 20240229
ROUNDS = 6
#: Rows are numbered within hash buckets; as many as keep a bucket near this size, within the bounds.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 100_000, 1024, 65_536


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(x: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """The places of row numbers ``x`` under a permutation of 0 to n-1."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(_mix(np.array([seed + 1000 * i], dtype=np.uint64), 1)[0]) >> 1 for i in range(ROUNDS)]
    out = np.asarray(x).astype(np.uint64)
    walking = np.ones(len(out), dtype=bool)
    while walking.any():
        left, right = out[walking] >> shift, out[walking] & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        out[walking] = (left << shift) | right
        walking = out >= np.uint64(n)
    return out.astype(np.int64)


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with a column ``__row`` of the numbers 0 to n-1, and n.

    The numbers follow from the rows alone: by hash bucket of the first column
    in ``order``, then by all of ``order``. Rows equal in ``order`` share
    a bucket and are numbered in any order. ``df`` is read twice, so it should be a table.
    """
    n = df.count()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (n // BUCKET_ROWS).bit_length()))
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    counts = dict(df.select(bucket.alias("b")).groupBy("b").count().collect())  # at most MOST_BUCKETS rows
    before = np.cumsum([0, *(counts.get(b, 0) for b in range(buckets - 1))])
    offsets = df.sparkSession.createDataFrame(pd.DataFrame({"__b": np.arange(buckets, dtype=np.int32), "__before": before.astype(np.int64)}), "__b int, __before long")
    ranked = df.withColumn("__b", bucket).withColumn("__rank", F.row_number().over(Window.partitionBy("__b").orderBy(*order)))
    numbered = ranked.join(F.broadcast(offsets), "__b").withColumn("__row", F.col("__before") + F.col("__rank") - 1)
    return numbered.drop("__b", "__rank", "__before"), n


def shard(df: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: a reproducible shuffle into shards whose counts differ by one at most.

    Nulls, repeated rows and ties get numbers like other rows; an empty table stays empty. Other
    columns stay, but ``shard`` and ``slot`` of ``df`` are replaced; names that begin with two underscores are this operator's.
    """
    rows, n = number_rows(df, order)

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(feistel(row.to_numpy(), n, seed))

    placed = rows.withColumn("__place", place("__row"))
    at: Column = F.col("__place")
    return placed.withColumns({"shard": (at % shards).cast("int"), "slot": F.expr(f"__place div {shards}")}).drop("__row", "__place")


def op10_feistel_sharding(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = shard(materialise(slim), ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
