"""Ranks over a whole table without one task sorting it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_rank(df: DataFrame, key: Column, name: str, ties: list[Column], hex_digits: int = 3) -> DataFrame:
    """A 0-based rank in the order of a SHA-256 of key (then ties) over the whole table.

    Rows are ranked inside buckets of the hash's first digits, in parallel; a bucket's offset comes from the counts
    of the buckets before it (16 ** hex_digits rows at most, whatever the table's size).
    """
    hashed = df.withColumn("_h", F.sha2(key.cast("string"), 256)).withColumn("_b", F.substring("_h", 1, hex_digits))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_at", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", F.coalesce("_at", F.lit(0)).alias("_at"))
    place = Window.partitionBy("_b").orderBy(F.substring("_h", 1, 16), *ties)
    ranked = hashed.withColumn("_r", F.row_number().over(place) - 1)
    return ranked.join(F.broadcast(before), "_b").withColumn(name, (F.col("_r") + F.col("_at")).cast("long")).drop("_h", "_b", "_r", "_at")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`: last write wins."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in df.columns if c not in keys)), order).alias("_last"))
    return last.select(*keys, "_last.*").select(*df.columns)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k) -> DataFrame:
    """The first k rows of each group; Spark prunes each task to k before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
