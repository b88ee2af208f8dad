"""Catalogues: records, codes, cohorts, segments, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_uint64, track_id
from .ranking import hash_rank

CODES = 100_000


def assign_codes(records: DataFrame, seed: int) -> DataFrame:
    """Five-digit codes in the order of a keyed hash: a bijection while there are 100,000 records at most."""
    ranked = hash_rank(records, F.concat_ws(":", F.lit(str(seed)), "track_id", F.lit("code")), "code_rank", [F.col("track_id")])
    return ranked.withColumn("code", F.when(F.col("code_rank") < CODES, F.lpad(F.col("code_rank").cast("string"), 5, "0"))).drop("code_rank")


def build_catalogue(listing: DataFrame, seed: int, count: int, least: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """From (path, duration, error): records of the first `count` readable files in hash order, and the files rejected before the last of them."""
    order = hash_rank(listing, F.concat_ws(":", F.lit(str(seed)), "path", F.lit("catalogue")), "place", [F.col("path")])
    fine = F.col("error").isNull() & (F.col("duration") >= least)
    good = hash_rank(order.where(fine), F.concat_ws(":", F.lit(str(seed)), "path", F.lit("catalogue")), "nth", [F.col("path")]).where(F.col("nth") < count)
    last = good.agg(F.max("place").alias("last"))
    records = assign_codes(good.select("path", track_id(F.col("path")).alias("track_id"), "duration"), seed)
    rejected = order.where(~F.coalesce(fine, F.lit(False))).crossJoin(F.broadcast(last)).where(F.col("place") < F.col("last"))
    return records, rejected.select("path", F.coalesce("error", F.lit("too short")).alias("error"))


def sample_cohort(records: DataFrame, seed: int, count: int, salt: str = "cohort") -> DataFrame:
    """`count` records without replacement, with their position in the cohort."""
    return hash_rank(records, F.concat_ws(":", F.lit(str(seed)), "track_id", F.lit(salt)), "pos", [F.col("track_id")]).where(F.col("pos") < count)


def select_cohort(cohort: DataFrame, expected: int, max_tracks: int | None = None, sample_tracks: int | None = None, seed: int = 0) -> DataFrame:
    """A prefix or a keyed sample of a cohort with `pos`, not both; the cohort must have the expected size."""
    if max_tracks is not None and sample_tracks is not None:
        raise ValueError("max_tracks and sample_tracks exclude each other")
    n = cohort.count()
    if n != expected:
        raise ValueError(f"cohort has {n} tracks, not {expected}")
    if max_tracks is not None:
        return cohort.where(F.col("pos") < max_tracks)
    return sample_cohort(cohort.drop("pos"), seed, sample_tracks, "evaluation") if sample_tracks is not None else cohort


def in_cohort_order(cohort: DataFrame, catalogue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Catalogue rows of the cohort's tracks with their position, and the cohort's tracks that are missing."""
    found = cohort.select("track_id", "pos").join(catalogue, "track_id")
    return found, cohort.join(catalogue, "track_id", "left_anti").select("track_id")


def mapping_fingerprint(records: DataFrame, order: str) -> DataFrame:
    """SHA-256 of 'track:code' lines in the given order (a cohort of bounded size goes into one value).

    A record without a code has no line; NULL where no line is left.
    """
    line = F.concat("track_id", F.lit(":"), "code")
    lines = F.transform(F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(F.col(order).alias("o"), line.alias("s"))))), lambda x: x["s"])
    return records.agg(lines.alias("l")).select(F.when(F.size("l") > 0, F.sha2(F.array_join("l", "\n"), 256)).alias("fingerprint"))


def segments(records: DataFrame, k: int, seconds: float, rank: str) -> DataFrame:
    """k contiguous segments a record: start i * seconds, index rank * k + i."""
    return records.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("start", F.col("i") * F.lit(float(seconds))).withColumn("document_index", (F.col(rank) * k + F.col("i")).cast("long"))


def expand_views(records: DataFrame, starts: DataFrame, rank: str, n_starts: int) -> DataFrame:
    """Every record with every start of a small table (start_pos, view_type, start), with a running index."""
    return records.crossJoin(F.broadcast(starts)).withColumn("document_index", (F.col(rank) * n_starts + F.col("start_pos")).cast("long"))


def complete_tracks(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Tracks with exactly k usable segments, and the others."""
    n = docs.groupBy("track_id").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") == k).select("track_id"), n.where(F.col("n") != k)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def cohort_violations(cohort: DataFrame, count: int) -> DataFrame:
    """One row a broken rule: wrong count, repeated tracks."""
    size = cohort.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("track_id").alias("d"))
    return size.select(F.explode(F.filter(F.array(F.when(F.col("n") != count, "count"), F.when(F.col("n") != F.col("d"), "repeated")), lambda x: x.isNotNull())).alias("rule"))


def batch_plan(cohort: DataFrame, seed: int, catalogue_pass: int, n: int, batch: int, accumulate: int, offset: int = 0) -> DataFrame:
    """(batch_idx, slot, track_id, optimizer_step): a keyed shuffle of n tracks cut into batches.

    The last batch is filled with the first tracks again; where the number of batches is no multiple of
    `accumulate`, the first batches are repeated.
    """
    order = hash_rank(cohort, F.concat_ws(":", F.lit(str(seed + catalogue_pass)), "track_id", F.lit("batch")), "place", [F.col("track_id")])
    full = -(-n // batch) * batch
    batches = full // batch
    every = -(-batches // accumulate) * accumulate
    fill = [order.select("track_id", F.col("place").alias("at")), order.where(F.col("place") < full - n).select("track_id", (F.col("place") + n).alias("at"))]
    rows = fill[0].unionByName(fill[1])
    rows = rows.withColumn("batch_idx", F.floor(F.col("at") / batch).cast("long")).withColumn("slot", (F.col("at") % batch).cast("int"))
    source = min(accumulate, batches)
    copies = [rows.select("track_id", "slot", "batch_idx")]
    for k in range(every - batches):
        copies.append(rows.where(F.col("batch_idx") == k % source).select("track_id", "slot", F.lit(batches + k).cast("long").alias("batch_idx")))
    out = copies[0]
    for c in copies[1:]:
        out = out.unionByName(c)
    return out.withColumn("optimizer_step", (F.floor((F.lit(catalogue_pass * every) + F.col("batch_idx")) / accumulate) + offset).cast("long"))


def resume_offset(global_step: int, catalogue_pass: int, yielded: int, n: int, batch: int, accumulate: int) -> int:
    """Offset with which the next batch gets the global step."""
    length = -(-(-(-n // batch)) // accumulate) * accumulate
    return global_step - (catalogue_pass * length + yielded) // accumulate


def view_rotation(rows: DataFrame, seed: int, catalogue_pass: int) -> DataFrame:
    """From (track_id, view, start): the start whose turn it is in this pass, in a keyed order of each track and view."""
    w = Window.partitionBy("track_id", "view").orderBy(stable_uint64(F.lit(seed), F.col("track_id"), F.col("view"), F.col("start").cast("string")), "start")
    n = F.count(F.lit(1)).over(Window.partitionBy("track_id", "view"))
    return rows.withColumn("_p", F.row_number().over(w) - 1).withColumn("_n", n).where(F.col("_p") == F.lit(catalogue_pass) % F.col("_n")).drop("_p", "_n")


def canonical_pairs(rows: DataFrame, seed: int, catalogue_pass: int) -> DataFrame:
    """Two canonical starts of each track for a pass: places 2 * pass and the next in the track's keyed order, cyclically.

    So the passes go through all starts two by two, and only then begin again.
    """
    w = Window.partitionBy("track_id")
    placed = rows.where("view = 'canonical'").withColumn("_p", F.row_number().over(w.orderBy(stable_uint64(F.lit(seed), F.col("track_id"), F.col("view"), F.col("start").cast("string")), "start")) - 1)
    placed = placed.withColumn("_n", F.count(F.lit(1)).over(w))
    turn = lambda k: F.max(F.when(F.col("_p") == (F.lit(2 * catalogue_pass) + k) % F.col("_n"), F.col("start")))
    return placed.groupBy("track_id").agg(turn(0).alias("anchor_start"), turn(1).alias("other_start"))


def anchor_swapped(seed: int, catalogue_pass: int, track: Column) -> Column:
    """Whether a pair's views change places in this pass."""
    return (stable_uint64(F.lit(seed), F.lit(catalogue_pass), track, F.lit("anchor")) % 2) == 1
