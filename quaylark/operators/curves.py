"""Training curves: last write per step, exposure, persistent onset."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANCE = math.log(10)
ONSET_SHARE = 0.9
BATCH_TRACKS = 80


def curve(log: DataFrame, keys: list[str], step: str = "step", line: str = "line", value: str = "value") -> DataFrame:
    """The last finite value written for each positive step."""
    v = F.col(value)
    fine = log.where((F.col(step) > 0) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return fine.groupBy(*keys, step).agg(F.max_by(value, line).alias(value))


def require_points(points: DataFrame, name: str) -> DataFrame:
    if points.isEmpty():
        raise ValueError(f"no finite points for {name}")
    return points


def onset(points: DataFrame, keys: list[str], threshold: float, persistence: int, order: str = "step", value: str = "value") -> DataFrame:
    """First step from which on the value and the next `persistence` ones are all below the threshold."""
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = F.count_if(F.col(value) < threshold).over(w.rowsBetween(0, persistence))
    return points.withColumn("_n", ahead).where(F.col("_n") == persistence + 1).groupBy(*keys).agg(F.min(order).alias("onset"))


def exposures(step: Column, tracks: Column) -> Column:
    """Times that a track has been seen on average."""
    return step * float(BATCH_TRACKS) / tracks
