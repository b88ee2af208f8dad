"""Keyed draws of crops, categories, SNRs and pool items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import _text, stable_mod, stable_uint64, stable_uniform
from ..functions.paths import g_text
from ..functions.schedules import SNR_BINS, SNR_WEIGHTS
from ..functions.signals import let

#: Of nearest matches: tasks among which they are dealt, where the session has fewer shuffle partitions; items of one value that
#: meet a row at once; shares of the rows that have the same nearest value.
LEAST_TASKS, CHUNK, SHARES = 64, 1024, 16


def start_sample(most: Column, *key, reserved: Column | None = None) -> Column:
    """A start in 0..most; 0 where most is negative.  Reserved starts are stepped past, cyclically; NULL if all are reserved."""
    span = F.greatest(most, F.lit(0)) + 1
    first = stable_mod(span, *key, F.lit("crop-start"))
    if reserved is None:
        return F.when(most <= 0, F.lit(0).cast("long")).otherwise(first)
    steps = F.sequence(F.lit(0).cast("long"), F.size(reserved).cast("long"))
    free = F.filter(F.transform(steps, lambda k: (first + k) % span), lambda s: ~F.array_contains(reserved, s))
    return F.when(most <= 0, F.lit(0).cast("long")).otherwise(F.try_element_at(free, F.lit(1)))


def choose(draw: Column, names: list[str], weights: list[Column]) -> Column:
    """The first name whose cumulative weight exceeds the draw, else the last."""
    sums, total = [], F.lit(0.0)
    for w in weights:
        total = total + w
        sums.append(total)
    out = F.lit(names[-1])
    for name, s in reversed(list(zip(names[:-1], sums[:-1], strict=True))):
        out = F.when(draw < s, name).otherwise(out)
    return out


def bin_bounds(name: Column) -> tuple[Column, Column]:
    low = high = F.lit(None).cast("double")
    for n, a, b in SNR_BINS:
        low, high = F.when(name == n, F.lit(a)).otherwise(low), F.when(name == n, F.lit(b)).otherwise(high)
    return low, high


def augmentation(rows: DataFrame, key: list[Column], shares: dict[str, Column], weights=SNR_WEIGHTS, zero_share: float = 0.25) -> DataFrame:
    """category, snr_bin and snr_db by keyed draws: an SNR only where there is noise, 0 dB for a share of the hardest bin."""
    names = list(shares)
    category = choose(stable_uniform(*key, F.lit("category")), names, list(shares.values()))
    noisy = F.contains(F.col("category"), F.lit("noise"))
    bins = [b[0] for b in SNR_BINS]
    drawn = choose(stable_uniform(*key, F.lit("snr-bin")), bins, [F.lit(w) for w in weights])
    low, high = bin_bounds(F.col("snr_bin"))
    zero = (F.col("snr_bin") == "very_hard") & (stable_uniform(*key, F.lit("exact-zero")) < zero_share)
    within = low + stable_uniform(*key, F.lit("snr-within-bin")) * (high - low)
    return rows.withColumn("category", category).withColumn("snr_bin", F.when(noisy, drawn)).withColumn("snr_db", F.when(~noisy | zero, 0.0).otherwise(within))


def consistency_noise(rows: DataFrame, key: list[Column], share: Column, weights: list[Column], phase: Column, zero_share: float = 0.25) -> DataFrame:
    """applied, snr_bin, snr_db: exact zeros of the hardest bin only in the late phases; unselected rows get (0, NULL)."""
    on = stable_uniform(*key, F.lit("apply")) < share
    drawn = choose(stable_uniform(*key, F.lit("snr-bin")), [b[0] for b in SNR_BINS], weights)
    low, high = bin_bounds(F.col("snr_bin"))
    late = phase.isin("consolidation", "ramp", "steady")
    zero = late & (F.col("snr_bin") == "very_hard") & (stable_uniform(*key, F.lit("exact-zero")) < zero_share)
    within = low + stable_uniform(*key, F.lit("snr-within-bin")) * (high - low)
    return rows.withColumn("applied", on).withColumn("snr_bin", F.when(F.col("applied"), drawn)).withColumn("snr_db", F.when(~F.col("applied") | zero, 0.0).otherwise(within))


def background_noise(seed, step, pair, key, share: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """The oldest draw: whether noise is applied, and its SNR.  The batch is no part of this key."""
    return stable_uniform(seed, step, pair, key, F.lit("apply")) < share, low + stable_uniform(seed, step, pair, key, F.lit("snr")) * (high - low)


def joint_snr(seed: int, track: Column, low: Column, high: Column) -> Column:
    """An SNR shared by the noise and noise-with-room suites of one range."""
    return low + stable_uniform(F.lit(seed), track, F.lit("paper-snr-range"), g_text(low), g_text(high)) * (high - low)


def pool_index(seed: Column, attempt: Column, n: Column) -> Column:
    """(seed + attempt) mod n, beyond 64 bits."""
    return ((seed.cast("decimal(21,0)") + attempt.cast("decimal(21,0)")) % n.cast("decimal(20,0)")).cast("long")


def pool_offset(seed: Column, attempt: Column, most: Column) -> Column:
    return stable_mod(F.greatest(most, F.lit(0)) + 1, seed.cast("string"), attempt, F.lit("offset"))


def draw_from_pool(keys: DataFrame, pool: DataFrame, seed: Column, salt: str, valid: Column, width: int = 65_536) -> DataFrame:
    """For each row of keys (`key`) the first valid item of pool from the key's place on, around the pool's end: (key, attempt, pool_idx).

    pool: (pool_idx, ...), numbered from 0 without gaps.  attempt counts the items passed over; both are NULL where the
    pool has no valid item.  The next valid item of every place is found once, in ranges of `width` places.
    """
    from pyspark.sql import Window

    items = pool.select("pool_idx", F.when(valid, F.col("pool_idx")).alias("_item"), F.floor(F.col("pool_idx") / width).alias("_b"))
    edges = items.groupBy("_b").agg(F.min("_item").alias("_lo"))
    every = Window.orderBy("_b")  # a row a range
    edges = edges.select("_b", F.coalesce(F.first("_lo", True).over(every.rowsBetween(1, Window.unboundedFollowing)), F.min("_lo").over(Window.partitionBy())).alias("_later"))
    # Looks back from the end: a window that looks ahead goes through what follows for every row.
    ahead = F.last("_item", True).over(Window.partitionBy("_b").orderBy(F.col("pool_idx").desc()).rowsBetween(Window.unboundedPreceding, 0))
    following = items.withColumn("_next", ahead).join(edges, "_b").select(F.col("pool_idx").alias("_start"), F.coalesce("_next", "_later").alias("pool_idx"))
    size = F.broadcast(pool.agg(F.count(F.lit(1)).alias("_n")))  # one row
    placed = keys.select("key", stable_uint64(F.lit(salt), seed).alias("_seed")).crossJoin(size)
    placed = placed.withColumn("_start", F.when(F.col("_n") > 0, pool_index(F.col("_seed"), F.lit(0), F.greatest("_n", F.lit(1)))))
    met = placed.join(following, "_start", "left")
    return met.select("key", F.pmod(F.col("pool_idx") - F.col("_start"), F.greatest("_n", F.lit(1))).cast("int").alias("attempt"), "pool_idx")


def monitor_manifest(tracks: DataFrame, views: list[tuple[str, list[int]]], seed: int, rank: str) -> DataFrame:
    """One start for each track and view: (track offset + seed + view offset) mod the number of starts."""
    rows = F.array(*(F.struct(F.lit(i).alias("view_pos"), F.lit(v).alias("view_type"), F.array(*(F.lit(s).cast("long") for s in starts)).alias("starts")) for i, (v, starts) in enumerate(views)))
    out = tracks.withColumn("v", F.explode(rows))
    at = ((F.col(rank) + seed + F.col("v.view_pos")) % F.size("v.starts")).cast("int")
    return out.withColumn("view_type", F.col("v.view_type")).withColumn("start_sample", F.element_at("v.starts", at + 1)).drop("v")


def stratified_split(rows: DataFrame, label: str, key: str, share: float, seed: int) -> DataFrame:
    """split: the first ceil(share * n) rows of each label in hash order are test.

    Ranks come from counts of hash buckets, so a label with most of the rows is ranked in parallel.
    """
    from pyspark.sql import Window

    hashed = rows.withColumn("_h", F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), F.lit("split")), 256), 1, 16)).withColumn("_b", F.substring("_h", 1, 2))
    sizes = hashed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label)
    sizes = sizes.withColumn("_at", F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_test", F.ceil(F.sum("_n").over(w) * F.lit(share)))
    place = Window.partitionBy(label, "_b").orderBy("_h", key)
    ranked = hashed.withColumn("_r", F.row_number().over(place)).join(sizes.drop("_n"), [label, "_b"])
    return ranked.withColumn("split", F.when(F.col("_r") + F.col("_at") <= F.col("_test"), "test").otherwise("train")).drop("_h", "_b", "_r", "_at", "_test")


def group_split(rows: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """split by whole groups: the first ceil(share * groups) groups in hash order are test."""
    from .ranking import hash_rank

    groups = rows.select(group).distinct()
    n = groups.agg(F.ceil(F.count(F.lit(1)) * F.lit(share)).alias("_test"))
    ranked = hash_rank(groups, F.concat_ws(":", F.lit(str(seed)), group, F.lit("group")), "_g", [F.col(group)]).crossJoin(F.broadcast(n))
    return rows.join(ranked.select(group, F.when(F.col("_g") < F.col("_test"), "test").otherwise("train").alias("split")), group)


def nearest_match(left: DataFrame, right: DataFrame, key: str, value: str, item: str, seed: int, ranges: int = 256) -> DataFrame:
    """For each row of left the item of right with the nearest value; ties by a keyed hash.

    Both sides are laid on one line, cut into `ranges` ranges at quantiles of the right values, so no range holds many
    more of them than another.  Each left row takes the nearest right value before and after it inside its range, or
    the last one before and the first one after the range: no cross join, and a bounded table of ranges.

    The items of one value tie, and which has the least hash with a left row only the hashes of all of them tell: where
    values repeat, their pairs are the work.  It is dealt by value, CHUNK items and a share of the left rows, and a row
    meets a chunk as one array, so no pair is ever a row of its own.
    """
    from pyspark.sql import Window

    right = right.select(F.col(item), F.col(value).cast("double").alias("c"))
    values = right.groupBy("c").agg(F.count(F.lit(1)).alias("_n"))
    shares = [k / ranges for k in range(1, ranges)]
    cuts = sorted(set(values.select(F.percentile_approx("c", shares, 100 * ranges).alias("q")).first()["q"] or []))
    lit = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    line = left.select(F.col(key), F.col(value).cast("double").alias("v"), F.lit(None).cast("double").alias("at")).unionByName(
        values.select(F.lit(None).cast(left.schema[key].dataType).alias(key), F.col("c").alias("v"), F.col("c").alias("at"))
    )
    line = line.withColumn("_b", let(F.col("v"), lambda v: F.size(F.filter(lit, lambda c: c <= v))))
    edges = line.groupBy("_b").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    every = Window.orderBy("_b")  # one row a range
    edges = edges.select("_b", F.last("hi", True).over(every.rowsBetween(Window.unboundedPreceding, -1)).alias("hi"), F.first("lo", True).over(every.rowsBetween(1, Window.unboundedFollowing)).alias("lo"))
    # Both look back, one along each direction: a window that looks ahead goes through what follows for every row.
    so_far = lambda order: F.last("at", True).over(Window.partitionBy("_b").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    near = line.withColumn("below", so_far(F.col("v").asc())).withColumn("above", so_far(F.col("v").desc()))
    near = near.where(F.col("at").isNull()).join(F.broadcast(edges), "_b").withColumn("below", F.coalesce("below", "hi")).withColumn("above", F.coalesce("above", "lo"))
    cand = F.filter(F.array_distinct(F.array("below", "above")), lambda x: x.isNotNull())
    picked = near.withColumn("d", F.array_min(F.transform(cand, lambda x: F.abs(x - F.col("v"))))).withColumn("c", F.explode(F.filter(cand, lambda x: F.abs(x - F.col("v")) == F.col("d"))))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_TASKS)
    sizes = values.select("c", F.ceil(F.col("_n") / CHUNK).cast("int").alias("_chunks"), F.least(F.lit(SHARES), F.ceil(F.col("_n") / 64)).cast("int").alias("_shares"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = ["c", "_chunk", "_share"]
    asked = picked.select(key, "c").join(sizes, "c").withColumn("_share", F.pmod(F.xxhash64(key), F.col("_shares")).cast("int")).select(key, "c", "_share", F.explode(upto("_chunks")).alias("_chunk"))
    items = right.join(sizes, "c").groupBy("c", F.pmod(F.xxhash64(item), F.col("_chunks")).cast("int").alias("_chunk"), "_shares").agg(F.array_sort(F.collect_set(item)).alias("_items"))
    items = items.select("c", "_chunk", "_items", F.explode(upto("_shares")).alias("_share"))
    met = asked.repartition(tasks, *cell).join(items.repartition(tasks, *cell), cell)
    draw = lambda x: F.substring(F.sha2(_text(F.lit(seed), F.col(key), x), 256), 1, 16)  # noqa: E731  # ordered as stable_uint64()
    least = F.array_min(F.transform("_items", lambda x: F.struct(draw(x).alias("h"), x.alias("item"))))
    best = met.select(key, "c", least.alias("m")).where("m is not null").groupBy(key).agg(F.min_by(F.struct("m.item", "c"), F.col("m")).alias("x"))
    return best.select(key, F.col("x.item").alias(item), F.col("x.c").alias("matched"))


def replacement_candidates(rows: DataFrame, n: int, key: list[Column], index: str, most: int = 33) -> DataFrame:
    """For each row its own index, then (h + offset) mod n: up to `most` candidates in order."""
    h = stable_uint64(*key, F.col(index), F.lit("replacement"))
    others = F.transform(F.sequence(F.lit(0), F.lit(most - 2)), lambda k: ((h + k.cast("decimal(20,0)")) % F.lit(n).cast("decimal(20,0)")).cast("long"))
    return rows.withColumn("candidates", F.slice(F.array_distinct(F.concat(F.array(F.col(index).cast("long")), others)), 1, most))
