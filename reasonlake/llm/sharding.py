"""Operator 3: reproducible shuffle and sharding by a Feistel permutation of row numbers.

Rows get global numbers 0..N-1 in an order that depends on their keys only. A keyed
Feistel network over the smallest power of two that holds N, walked along its cycle
until the value is below N, permutes the numbers. The permuted number p gives
``shard = p mod shards`` and ``slot = p div shards``: counts differ by one at most, slots have no
gaps, and both can be computed for any row number, or turned back, without data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mix, read, stage_table

ROUNDS = 8
#: Rows that one numbering bucket holds on average, and the most buckets (their counts are summed in one task).
BUCKET_ROWS, MOST_BUCKETS = 4096, 16384


def _halves(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _round(x: np.ndarray, i: int, seed: int, bits: int) -> np.ndarray:
    key = np.uint64((seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) % 2**64)
    return mix(x + key) & np.uint64((1 << bits) - 1)


def _once(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    lo, hi = _halves(n)
    left, right = x >> np.uint64(lo), x & np.uint64((1 << lo) - 1)
    for i in range(ROUNDS)[:: -1 if back else 1]:
        if i % 2:
            left = left ^ _round(right, i, seed, hi)
        else:
            right = right ^ _round(left, i, seed, lo)
    return left << np.uint64(lo) | right


def permute(rows: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """Images of row numbers below n under the permutation; ``back`` inverts it."""
    out = np.asarray(rows, np.uint64)
    if n < 2 or not len(out):
        return out.astype(np.int64)
    out = _once(out, n, seed, back)
    while len(over := np.flatnonzero(out >= n)):
        out[over] = _once(out[over], n, seed, back)
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The global row number that sits in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def number_rows(df: DataFrame, keys: list[str], into: str = "row_number") -> DataFrame:
    """Dense numbers from 0 that depend on the key values only.

    Rows are hashed by their keys into buckets of a few thousand rows, numbered by the
    keys inside a bucket, and shifted by the counts of the buckets before it (at most
    ``MOST_BUCKETS`` counts). Null keys are keys like others. Rows that agree in all
    keys are interchangeable: which of them gets which number is open.
    """
    n = df.count()
    buckets = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    put = df.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = put.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__start", F.coalesce(F.sum("__n").over(before), F.lit(0))
    ).drop("__n")
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(*keys))
    return put.withColumn("__place", place).join(F.broadcast(starts), "__bucket").withColumn(
        into, F.col("__start") + F.col("__place") - 1
    ).drop("__bucket", "__place", "__start")


def shard_rows(df: DataFrame, keys: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` int and ``slot`` long. ``df`` is read twice; pass a stage table where that is dear.

    Empty tables give no rows. Columns named shard or slot are replaced.
    """
    n = df.count()

    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    out = number_rows(df, keys, "__row").withColumn("__at", place("__row"))
    return out.withColumns(
        {
            "shard": (F.col("__at") % shards).cast("int"),
            "slot": F.floor(F.col("__at") / shards).cast("long") if n < 2**52 else F.expr(f"__at div {shards}L")
        }
    ).drop("__row", "__at")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 40 shards under the law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = stage_table(narrow, "op3-rows")  # from here on no text is read
    return shard_rows(rows, ["doc_id", "text_crc32", "size"], 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
