"""Evaluation queries: suites, manifests with exclusion and back-fill, cross products, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import record_id, snr_range_id
from .ranking import hash_rank
from .sampling import joint_snr, start_sample

#: SNR ranges in dB, query lengths in seconds, and window and hop in seconds.
RANGES = ((0, 5), (5, 10), (10, 20))
LENGTHS = (2, 5, 10)
WINDOW_SECONDS, HOP_SECONDS = 2.0, 0.5


def suites(spark, ranges=RANGES) -> DataFrame:
    """Noise, then noise with room, each over the SNR ranges."""
    rows = [(k + len(ranges) * int(rir), rir, float(lo), float(hi)) for rir in (False, True) for k, (lo, hi) in enumerate(ranges)]
    names = ("suite_pos", "rir", "snr_low", "snr_high")
    df = spark.range(0, 1, 1, 1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, r, strict=True))) for r in rows))))
    return df.withColumn("suite_id", F.concat_ws("_", F.when(F.col("rir"), "noise_rir").otherwise("noise"), snr_range_id(F.col("snr_low"), F.col("snr_high"))))


def exclusion(listing: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Distinct source ids of an external corpus, and how many of its files have none."""
    return listing.select(F.col(source).alias("source_id")).where(F.col(source).isNotNull()).distinct(), listing.agg(F.count_if(F.col(source).isNull()).alias("ignored"))


def manifest(cohort: DataFrame, excluded: DataFrame, n: int, seed: int, need_seconds: float, rate: int) -> tuple[DataFrame, DataFrame]:
    """Query recipes of the first n usable tracks in hash order, and the tracks left out as excluded.

    cohort: (track_id, source_id, duration, ...).  Excluded and short tracks are passed over and later ones fill in.
    """
    allowed = cohort.join(excluded, "source_id", "left_anti").where(F.col("duration") >= need_seconds)
    picked = hash_rank(allowed, F.concat_ws(":", F.lit(str(seed)), "track_id", F.lit("joint")), "query_pos", [F.col("track_id")]).where(F.col("query_pos") < n)
    most = ((F.col("duration") - need_seconds) * rate).cast("long")
    recipes = picked.withColumn("start_sample", start_sample(most, F.lit(seed), F.col("track_id"), F.lit("joint-query-start")))
    return recipes, cohort.join(excluded, "source_id", "left_semi").select("track_id", "source_id")


def query_corpus(recipes: DataFrame, suite_table: DataFrame, seed: int, lengths=LENGTHS) -> DataFrame:
    """Every recipe in every suite and length; noise and noise-with-room of one range share their SNR."""
    out = recipes.crossJoin(F.broadcast(suite_table)).withColumn("query_seconds", F.explode(F.array(*(F.lit(float(x)) for x in lengths))))
    out = out.withColumn("snr_db", joint_snr(seed, F.col("track_id"), F.col("snr_low"), F.col("snr_high")))
    return out.withColumn("id", record_id(F.col("track_id"), F.col("suite_id"), F.col("query_seconds")))


def pending(corpus: DataFrame, done: DataFrame, keys=("track_id", "query_seconds", "suite_id")) -> DataFrame:
    """What a resumed run still has to do."""
    return corpus.join(done.select(*keys).distinct(), list(keys), "left_anti")


def expect_count(df: DataFrame, n: int) -> DataFrame:
    got = df.count()
    if got != n:
        raise ValueError(f"{got} rows, not {n}")
    return df
