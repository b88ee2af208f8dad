"""Retrieval metrics and other grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_in(codes: Column, code: Column) -> Column:
    """1-based place of the true code in a beam, NULL if absent."""
    return F.nullif(F.array_position(codes, code).cast("int"), F.lit(0))


def hit(rank: Column, k: int) -> Column:
    return F.coalesce((rank <= k).cast("double"), F.lit(0.0))


def joint_metrics(rows: DataFrame, keys: list[str], rank: str = "rank", failed: str = "failed", eos: str | None = None, latency: str = "latency") -> DataFrame:
    """Metrics whose denominator is every selected query: failures are misses.  Empty groups give no row."""
    r, n = F.col(rank), F.count(F.lit(1))
    share = lambda k: F.sum(F.when(~F.col(failed) & (r <= k), 1).otherwise(0)) / n
    ok = F.sum(F.when(F.col(failed), 0).otherwise(1))
    elapsed = F.sum(latency)
    out = [
        n.cast("long").alias("selected"), ok.cast("long").alias("evaluated"), (n - ok).cast("long").alias("failed"), share(1).alias("top1"), share(5).alias("top5"), share(10).alias("top10"),
        (F.sum(F.when(F.col(failed), 0.0).otherwise(F.coalesce(1.0 / r, F.lit(0.0)))) / n).alias("mrr"), elapsed.alias("elapsed"), F.when(elapsed > 0, ok / elapsed).otherwise(0.0).alias("qps"),
    ]
    if eos:
        out.append((F.sum(F.when(F.col(eos), 1).otherwise(0)) / n).alias("eos_rate"))
    return rows.groupBy(*keys).agg(*out)


def generation_metrics(rows: DataFrame, keys: list[str], code: str = "code", beam: str = "beam", greedy: str = "greedy", ended: str = "ended", more: tuple[Column, ...] = ()) -> DataFrame:
    """Metrics over the rows present, and `more` aggregates in the same pass: reciprocal rank counts any place of the beam."""
    r = rank_in(F.col(beam), F.col(code))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"), F.avg((F.col(greedy) == F.col(code)).cast("double")).alias("greedy_top1"), F.avg((~F.col(ended)).cast("double")).alias("invalid_code_rate"),
        F.avg(hit(r, 1)).alias("top1"), F.avg(hit(r, 5)).alias("top5"), F.avg(hit(r, 10)).alias("top10"), F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), *more,
    )


def with_empty_groups(measured: DataFrame, expected: DataFrame, keys: list[str], count: str = "queries") -> DataFrame:
    """Metrics with a row for every expected group: one without queries has count 0 and no metric."""
    return expected.select(*keys).distinct().join(measured, keys, "left").withColumn(count, F.coalesce(F.col(count), F.lit(0)).cast("long"))


def augmentation_stats(rows: DataFrame, keys: list[str], categories: list[str], category: str = "category", snr: str = "snr_db", start: str = "start_sample", identity: str = "track_id") -> DataFrame:
    """What a batch's draws came to: share of each category, mean SNR where there is noise, bounds and mean of the starts, rows whose identity an earlier row had, and whether the starts are all different."""
    n = F.count(F.lit(1))
    share = [(F.count_if(F.col(category) == c) / n).alias(f"{c}_share") for c in categories]
    return rows.groupBy(*keys).agg(
        n.alias("rows"), *share, F.avg(snr).alias("mean_snr_db"), F.min(start).alias("first_start"), F.max(start).alias("last_start"), F.avg(start).alias("mean_start"),
        (F.count(identity) - F.count_distinct(identity)).alias("collisions"), (F.count_distinct(start) == F.count(start)).alias("starts_differ"),
    )


def grouped_levels(rows: DataFrame, levels: list[list[str]], aggregates: list[Column], names: list[str]) -> DataFrame:
    """One pass over several groupings; columns outside a row's level are NULL, and grouping_id tells levels apart."""
    return rows.groupingSets([[F.col(c) for c in lv] for lv in levels], *names).agg(F.grouping_id().alias("level"), *aggregates)


def perplexity(loss: Column, most: float = 20.0) -> Column:
    return F.exp(F.least(F.lit(most), loss))


def throughput(rows: DataFrame, tokens: str, seconds: str) -> DataFrame:
    t, s = F.sum(tokens), F.sum(seconds)
    return rows.agg(F.count(F.lit(1)).alias("documents"), t.alias("tokens"), F.when(s > 0, t / s).otherwise(0.0).alias("tokens_per_second"))


def weighted_mean(rows: DataFrame, keys: list[str], hits: str, n: str, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(hits) / F.sum(n)).alias(name))


def reconcile(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose counts differ: (keys, found, expected), 0 where a side lacks the key."""
    n = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    both = n.join(expected.select(*keys, F.col("n").alias("expected")), keys, "full_outer")
    both = both.select(*keys, F.coalesce("found", F.lit(0)).cast("long").alias("found"), F.coalesce("expected", F.lit(0)).cast("long").alias("expected"))
    return both.where("found <> expected")
