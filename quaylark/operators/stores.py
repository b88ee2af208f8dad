"""Token stores as tables: views of tracks, grids of starts, look-ups by key, equality of cached and fresh tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The view that each corpus role gives.
ROLES = {"canonical_training": "canonical", "shifted_training": "shifted", "heldout_evaluation": "heldout"}


def milliseconds(start):
    """A start as whole milliseconds, so that it can be a join key."""
    return F.round(start * 1000).cast("long")


def selected(rows: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows of the selected tracks."""
    return rows.join(tracks.select("track_id").distinct(), "track_id", "left_semi")


def views(stores: list[DataFrame], tracks: DataFrame) -> DataFrame:
    """The selected tracks' rows of several stores (corpus_role, track_id, segment_start, ...) with their view and start key."""
    rows = stores[0]
    for s in stores[1:]:
        rows = rows.unionByName(s)
    names = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    named = selected(rows, tracks).withColumn("view_type", F.try_element_at(names, F.col("corpus_role")))
    known = F.when(F.col("view_type").isNull(), F.raise_error(F.concat(F.lit("unknown role "), F.coalesce("corpus_role", F.lit("NULL"))))).otherwise(F.col("view_type"))
    return named.withColumn("view_type", known.cast("string")).withColumn("start_key", milliseconds(F.col("segment_start")))


def at_positions(rows: DataFrame, tracks: DataFrame, positions: DataFrame) -> DataFrame:
    """One row for each track and position (view_type, start): a repeated key counts with its last document; a missing one is an error later on."""
    wanted = tracks.select("track_id").distinct().crossJoin(F.broadcast(positions.select("view_type", milliseconds(F.col("start")).alias("start_key"))))
    last = rows.groupBy("track_id", "view_type", "start_key").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("track_id", "view_type", "start_key"))), "document_index").alias("_last"))
    return wanted.join(last, ["track_id", "view_type", "start_key"], "left").select("track_id", "view_type", "start_key", "_last.*")


def grid_violations(rows: DataFrame, tracks: DataFrame, grids: dict[str, list[float]]) -> DataFrame:
    """(track_id, rule) of tracks whose starts in a view are not that view's grid, each once, or whose codes differ.

    A view that a track lacks altogether breaks the rule, too.
    """
    wanted = F.array(*(F.struct(F.lit(v).alias("view_type"), F.array(*(F.lit(round(s * 1000)).cast("long") for s in sorted(g))).alias("grid")) for v, g in grids.items()))
    expected = tracks.select("track_id", F.inline(wanted))
    have = rows.where(F.col("view_type").isin(*grids)).groupBy("track_id", "view_type").agg(F.array_sort(F.collect_list("start_key")).alias("starts"))
    off = expected.join(have, ["track_id", "view_type"], "left").where(~F.col("starts").eqNullSafe(F.col("grid"))).select("track_id", F.concat(F.lit("starts of "), "view_type").alias("rule"))
    codes = rows.where(F.col("view_type").isin(*grids)).groupBy("track_id").agg(F.min("code").alias("low"), F.max("code").alias("high")).where("low <> high").select("track_id", F.lit("codes").alias("rule"))
    return off.unionByName(codes)


def corpus_lookup(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """Each result with its query's record, by track, suite and length."""
    return results.join(corpus, ["track_id", "suite_id", "query_seconds"])


def token_differences(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """(track_id, start_key) whose tokens differ between two tables, or that one of them lacks."""
    a, b = (df.select("track_id", "start_key", F.col("tokens").alias(n)) for df, n in ((cached, "cached"), (fresh, "fresh")))
    return a.join(b, ["track_id", "start_key"], "full_outer").where(~F.col("cached").eqNullSafe(F.col("fresh"))).select("track_id", "start_key")


def prefetched(waves: DataFrame, step: int, batch: int) -> DataFrame:
    """Waveforms that were loaded for exactly this step and batch; none for any other."""
    return waves.where((F.col("planned_optimizer_step") == step) & (F.col("planned_batch_idx") == batch))
