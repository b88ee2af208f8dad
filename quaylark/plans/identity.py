"""Queries over catalogue records: identity, codes, cohorts, keyed sampling, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing
from ..functions.hashing import stable_uint64, stable_uniform
from ..functions.schedules import SNR_BINS, SNR_WEIGHTS
from ..operators import catalogue, ranking, sampling
from . import views as v
from .registry import Registry

query = Registry()
S = v.SEED


@query(f"WITH {v.TRACKS} SELECT path, track_id, duration, code FROM tracks")
def track_identity(spark, sf):
    return v.tracks(spark, sf).select("path", "track_id", "duration", "code")


@query(f"WITH {v.TRACKS} SELECT count(*) AS tracks, count(DISTINCT code) AS codes, min(code) AS low, max(code) AS high FROM tracks")
def code_bijection(spark, sf):
    return v.tracks(spark, sf).agg(F.count(F.lit(1)).alias("tracks"), F.count_distinct("code").alias("codes"), F.min("code").alias("low"), F.max("code").alias("high"))


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return catalogue.duplicates(v.table(spark, sf, "documents", "text"), ["text"])


_COHORT = f"cohort AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {v.hash_order(f"'{S}'", 'track_id', "'cohort'")}, track_id) - 1 AS pos FROM tracks) WHERE pos < 100)"


def _cohort(spark, sf):
    return catalogue.sample_cohort(v.tracks(spark, sf), S, 100)


@query(f"WITH {v.TRACKS}, {_COHORT} SELECT track_id, code, pos FROM cohort")
def cohort_sample(spark, sf):
    """The cohort's size is a stated number of tracks."""
    return _cohort(spark, sf).select("track_id", "code", "pos")


@query(f"WITH {v.TRACKS}, {_COHORT}, seen AS (SELECT * FROM tracks WHERE duration >= 3) SELECT track_id, pos, code, true AS found FROM cohort JOIN seen USING (track_id, code) UNION ALL SELECT track_id, NULL, NULL, false FROM cohort WHERE track_id NOT IN (SELECT track_id FROM seen)")
def cohort_in_order(spark, sf):
    c = _cohort(spark, sf)
    found, missing = catalogue.in_cohort_order(c, v.tracks(spark, sf).where("duration >= 3").select("track_id", "code"))
    return found.select("track_id", "pos", "code", F.lit(True).alias("found")).unionByName(missing.select("track_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("code"), F.lit(False).alias("found")))


@query(f"WITH {v.TRACKS}, {_COHORT} SELECT sha256(string_agg(track_id || ':' || code, chr(10) ORDER BY pos)) AS fingerprint FROM cohort")
def code_mapping_fingerprint(spark, sf):
    return catalogue.mapping_fingerprint(_cohort(spark, sf), "pos")


@query("WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id AS track_id, n, n = 2 AS complete FROM n")
def complete_tracks(spark, sf):
    full, rest = catalogue.complete_tracks(v.table(spark, sf, "conversations", "conv_id").withColumnRenamed("conv_id", "track_id"), 2)
    return full.select("track_id", F.lit(2).cast("long").alias("n"), F.lit(True).alias("complete")).unionByName(rest.select("track_id", "n", F.lit(False).alias("complete")))


@query(f"WITH {v.TRACKS} SELECT track_id, r * 6 + i AS document_index, i * CAST(5.0 AS DOUBLE) AS start FROM tracks, range(6) t(i)")
def segments_explode(spark, sf):
    rows = ranking.hash_rank(v.paths(spark, sf), F.concat_ws(":", F.lit(str(S)), "track_id", F.lit("code")), "r", [F.col("track_id")])
    return catalogue.segments(rows, 6, 5.0, "r").select("track_id", "document_index", "start")


@query(f"WITH {v.TRACKS}, starts AS (SELECT * FROM (VALUES (0, 'canonical', 0), (1, 'shifted', 2500), (2, 'heldout', 5000)) s(start_pos, view_type, start)) SELECT track_id, r * 3 + start_pos AS document_index, view_type, start FROM tracks, starts")
def view_expand(spark, sf):
    rows = ranking.hash_rank(v.paths(spark, sf), F.concat_ws(":", F.lit(str(S)), "track_id", F.lit("code")), "r", [F.col("track_id")])
    starts = spark.createDataFrame([(0, "canonical", 0), (1, "shifted", 2500), (2, "heldout", 5000)], "start_pos int, view_type string, start int")
    return catalogue.expand_views(rows, starts, "r", 3).select("track_id", "document_index", "view_type", "start")


@query(f"SELECT event_id, CAST({hashing.sql_uint64('event_id', "'key'")} AS DECIMAL(20,0)) AS u FROM events")
def hash_uint64(spark, sf):
    return v.table(spark, sf, "events", "event_id").select("event_id", stable_uint64(F.col("event_id"), F.lit("key")).alias("u"))


@query(f"SELECT event_id, {hashing.sql_uniform('event_id', "'key'")} AS f FROM events")
def hash_uniform(spark, sf):
    return v.table(spark, sf, "events", "event_id").select("event_id", stable_uniform(F.col("event_id"), F.lit("key")).alias("f"))


_START = f"CAST({v.u64(str(S), 'track_id', "'anchor'", '0', "'crop-start'")} % CAST(greatest(most, 0) + 1 AS UBIGINT) AS BIGINT)"


@query(f"WITH {v.TRACKS}, m AS (SELECT track_id, CAST(floor(duration * 10) AS BIGINT) - 100 AS most FROM tracks) SELECT track_id, CASE WHEN most <= 0 THEN 0 ELSE {_START} END AS start_sample FROM m")
def crop_starts(spark, sf):
    most = F.floor(F.col("duration") * 10).cast("long") - 100
    return v.paths(spark, sf).select("track_id", sampling.start_sample(most, F.lit(S), F.col("track_id"), F.lit("anchor"), F.lit(0)).alias("start_sample"))


@query(f"""WITH {v.TRACKS}, m AS (SELECT track_id, CAST(floor(duration * 10) AS BIGINT) - 100 AS most FROM tracks), s AS (SELECT *, {_START} AS first, greatest(most, 0) + 1 AS span FROM m),
 r AS (SELECT *, [first, (first + 1) % span, (first + 3) % span] AS reserved FROM s)
 SELECT track_id, CASE WHEN most <= 0 THEN 0 ELSE list_filter(list_transform(range(4), lambda k: (first + k) % span), lambda x: NOT list_contains(reserved, x))[1] END AS start_sample FROM r""")
def crop_starts_reserved(spark, sf):
    key = (F.lit(S), F.col("track_id"), F.lit("anchor"), F.lit(0))
    rows = v.paths(spark, sf).withColumn("most", F.floor(F.col("duration") * 10).cast("long") - 100).withColumn("span", F.greatest("most", F.lit(0)) + 1)
    rows = rows.withColumn("first", hashing.stable_mod(F.col("span"), *key, F.lit("crop-start")))
    reserved = F.array(F.col("first"), (F.col("first") + 1) % F.col("span"), (F.col("first") + 3) % F.col("span"))
    return rows.select("track_id", sampling.start_sample(F.col("most"), *key, reserved=reserved).alias("start_sample"))


_KEY = f"'{S}', '60000', '3', '0', track_id"
_D = lambda salt: f"(CAST(('0x' || left(sha256(concat_ws(':', {_KEY}, '{salt}')), 16))::UBIGINT AS DOUBLE) / pow(2.0, 64))"
_AUG = f"""draws AS (SELECT track_id, {_D('category')} AS c, {_D('snr-bin')} AS b, {_D('exact-zero')} AS z, {_D('snr-within-bin')} AS w FROM tracks),
cats AS (SELECT *, CASE WHEN c < 0.1::DOUBLE THEN 'clean' WHEN c < 0.1::DOUBLE + 0.35::DOUBLE THEN 'noise' WHEN c < 0.1::DOUBLE + 0.35::DOUBLE + 0.3::DOUBLE THEN 'rir' ELSE 'noise_rir' END AS category FROM draws),
bins AS (SELECT *, CASE WHEN contains(category, 'noise') THEN CASE WHEN b < 0.4::DOUBLE THEN 'very_hard' WHEN b < 0.4::DOUBLE + 0.3::DOUBLE THEN 'hard' WHEN b < 0.4::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE THEN 'medium' ELSE 'easy' END END AS snr_bin FROM cats),
aug AS (SELECT track_id, category, snr_bin, CASE WHEN snr_bin IS NULL OR (snr_bin = 'very_hard' AND z < 0.25) THEN 0.0::DOUBLE ELSE round(CASE snr_bin WHEN 'very_hard' THEN 0 + w * 5 WHEN 'hard' THEN 5 + w * 5 WHEN 'medium' THEN 10 + w * 10 ELSE 20 + w * 10 END, 9) END AS snr_db FROM bins)"""


def _augmented(spark, sf):
    key = [F.lit(S), F.lit(60_000), F.lit(3), F.lit(0), F.col("track_id")]
    shares = dict(clean=F.lit(0.1), noise=F.lit(0.35), rir=F.lit(0.3), noise_rir=F.lit(0.25))
    return sampling.augmentation(v.paths(spark, sf), key, shares).withColumn("snr_db", F.round("snr_db", 9))


@query(f"WITH {v.TRACKS}, {_AUG} SELECT * FROM aug")
def augmentation_categories(spark, sf):
    return _augmented(spark, sf).select("track_id", "category", "snr_bin", "snr_db")


@query(f"WITH {v.TRACKS}, {_AUG} SELECT category, snr_bin, count(*) AS n, count(*) FILTER (snr_db = 0) AS zeros, round(avg(snr_db), 6) AS mean_snr FROM aug GROUP BY ALL")
def snr_bin_counts(spark, sf):
    return _augmented(spark, sf).groupBy("category", "snr_bin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("snr_db") == 0).alias("zeros"), F.round(F.avg("snr_db"), 6).alias("mean_snr"))


_N = lambda salt: f"(CAST(('0x' || left(sha256(concat_ws(':', '7', '60000', '3', '0', track_id, '{salt}')), 16))::UBIGINT AS DOUBLE) / pow(2.0, 64))"


@query(f"""WITH {v.TRACKS}, d AS (SELECT track_id, {_N('apply')} < 0.75 AS applied, {_N('snr-bin')} AS b, {_N('exact-zero')} AS z, {_N('snr-within-bin')} AS w FROM tracks),
 b AS (SELECT *, CASE WHEN applied THEN CASE WHEN b < 0.4::DOUBLE THEN 'very_hard' WHEN b < 0.4::DOUBLE + 0.3::DOUBLE THEN 'hard' WHEN b < 0.4::DOUBLE + 0.3::DOUBLE + 0.2::DOUBLE THEN 'medium' ELSE 'easy' END END AS snr_bin FROM d)
 SELECT track_id, applied, snr_bin, CASE WHEN snr_bin IS NULL OR (snr_bin = 'very_hard' AND z < 0.25) THEN 0.0::DOUBLE ELSE round(CASE snr_bin WHEN 'very_hard' THEN 0 + w * 5 WHEN 'hard' THEN 5 + w * 5 WHEN 'medium' THEN 10 + w * 10 ELSE 20 + w * 10 END, 9) END AS snr_db FROM b""")
def consistency_draws(spark, sf):
    key = [F.lit(7), F.lit(60_000), F.lit(3), F.lit(0), F.col("track_id")]
    out = sampling.consistency_noise(v.paths(spark, sf), key, F.lit(0.75), [F.lit(w) for w in SNR_WEIGHTS], F.lit("consolidation"))
    return out.select("track_id", "applied", "snr_bin", F.round("snr_db", 9).alias("snr_db"))


@query(f"""WITH {v.TRACKS} SELECT track_id, lo AS snr_low, hi AS snr_high, round(lo + CAST({v.u64(str(S), 'track_id', "'paper-snr-range'", 'lo', 'hi')} AS DOUBLE) / pow(2.0, 64) * (hi - lo), 9) AS snr_db FROM tracks, (VALUES (0, 5), (5, 10), (10, 20)) r(lo, hi)""")
def joint_snr(spark, sf):
    ranges = F.array(*(F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((0, 5), (5, 10), (10, 20))))
    rows = v.paths(spark, sf).select("track_id", F.inline(ranges))
    return rows.select("track_id", F.col("lo").alias("snr_low"), F.col("hi").alias("snr_high"), F.round(sampling.joint_snr(S, F.col("track_id"), F.col("lo"), F.col("hi")), 9).alias("snr_db"))


_VIEWS = [("training", [0, 100, 200, 300]), ("validation", [50, 150, 250]), ("heldout", [25, 75])]


@query(f"""WITH {v.TRACKS}, views AS (SELECT * FROM (VALUES (0, 'training', [0, 100, 200, 300]), (1, 'validation', [50, 150, 250]), (2, 'heldout', [25, 75])) t(p, view_type, starts))
 SELECT track_id, view_type, CAST(starts[(r + {S} + p) % len(starts) + 1] AS BIGINT) AS start_sample FROM tracks, views""")
def monitor_manifest(spark, sf):
    rows = ranking.hash_rank(v.paths(spark, sf), F.concat_ws(":", F.lit(str(S)), "track_id", F.lit("code")), "r", [F.col("track_id")])
    return sampling.monitor_manifest(rows, _VIEWS, S, "r").select("track_id", "view_type", "start_sample")


@query(f"""WITH {v.TRACKS}, {_COHORT}, o AS (SELECT track_id, row_number() OVER (ORDER BY {v.hash_order(f"'{S + 2}'", 'track_id', "'batch'")}, track_id) - 1 AS place FROM cohort),
 f AS (SELECT track_id, place AS spot FROM o UNION ALL SELECT track_id, place + 100 FROM o WHERE place < 12),
 b AS (SELECT track_id, spot // 16 AS batch_idx, CAST(spot % 16 AS INTEGER) AS slot FROM f),
 c AS (SELECT * FROM b UNION ALL SELECT track_id, 7, slot FROM b WHERE batch_idx = 0)
 SELECT track_id, slot, batch_idx, (2 * 8 + batch_idx) // 4 AS optimizer_step FROM c""")
def batch_plan(spark, sf):
    """A hundred tracks in batches of 16, four batches a step."""
    return catalogue.batch_plan(_cohort(spark, sf), S, 2, 100, 16, 4)


@query(f"""WITH s AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY {hashing.sql_uint64(str(S), 'conv_id', 'role', 'turn')}, turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations)
 SELECT conv_id AS track_id, role AS view, turn AS start FROM s WHERE p = 3 % n""")
def view_rotation(spark, sf):
    rows = v.table(spark, sf, "conversations", "conv_id", "role", "turn").toDF("track_id", "view", "start")
    return catalogue.view_rotation(rows, S, 3)


@query(f"WITH {v.TRACKS} SELECT track_id, CAST({v.u64(str(S), '3', 'track_id', "'anchor'")} % 2 AS BIGINT) = 1 AS swapped FROM tracks")
def anchor_swap(spark, sf):
    return v.paths(spark, sf).select("track_id", catalogue.anchor_swapped(S, 3, F.col("track_id")).alias("swapped"))


@query(f"""WITH {v.WAVES}, n AS (SELECT count(*) AS n FROM waves WHERE split = 'train'), pool AS (SELECT wave_id, row_number() OVER (ORDER BY wave_id) - 1 AS i FROM waves WHERE split = 'train'),
 k AS (SELECT wave_id AS key, ('0x' || left(sha256(concat_ws(':', 'train-noise', CAST({v.u64('7', 'wave_id')} AS VARCHAR))), 16))::UBIGINT AS u FROM waves WHERE split = 'test'),
 s AS (SELECT key, n, CAST(CAST(u AS HUGEINT) % n AS BIGINT) AS start FROM k, n), fine AS (SELECT i FROM pool WHERE i % 97 = 5)
 SELECT key, CAST((i - start + n) % n AS INTEGER) AS attempt, i AS pool_idx FROM (SELECT s.*, coalesce((SELECT min(i) FROM fine WHERE i >= s.start), (SELECT min(i) FROM fine)) AS i FROM s)""")
def noise_pool_draws(spark, sf):
    """One item in 97 is valid, so most keys pass over many."""
    w = v.waves(spark, sf).select("wave_id", "room", "split")
    train = w.where("split = 'train'")
    keys = w.where("split = 'test'").select(F.col("wave_id").alias("key"))
    return sampling.draw_from_pool(keys, _places(train), stable_uint64(F.lit(7), F.col("key")).cast("string"), "train-noise", F.col("pool_idx") % 97 == 5, width=64)


def _places(pool, ranges: int = 1024):
    """0-based places of pool items by id: counts of id ranges first (so many at most), then ranks inside them."""
    from pyspark.sql import Window

    low, high = pool.agg(F.min("wave_id"), F.max("wave_id")).first()
    width = max(1, ((high or 0) - (low or 0)) // ranges + 1)
    b = pool.withColumn("_b", F.floor((F.col("wave_id") - (low or 0)) / width))
    sizes = b.groupBy("_b").count().withColumn("_at", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = b.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("wave_id")) - 1)
    return r.join(F.broadcast(sizes), "_b").select("wave_id", (F.col("_r") + F.col("_at")).cast("long").alias("pool_idx"))


@query(f"""WITH {v.TRACKS}, h AS (SELECT track_id, r, {v.u64(str(S), '60000', '3', '0', 'r', "'replacement'")} AS u, (SELECT count(*) FROM tracks) AS n FROM tracks),
 c AS (SELECT track_id, list_concat([r], list_transform(range(32), lambda k: CAST((CAST(u AS HUGEINT) + k) % 1000 AS BIGINT))) AS c FROM h)
 SELECT track_id, len(list_distinct(c)) AS n, c[1] AS first, c[2] AS second FROM c""")
def replacement_candidates(spark, sf):
    rows = ranking.hash_rank(v.paths(spark, sf), F.concat_ws(":", F.lit(str(S)), "track_id", F.lit("code")), "r", [F.col("track_id")])
    u = stable_uint64(F.lit(S), F.lit(60_000), F.lit(3), F.lit(0), F.col("r"), F.lit("replacement"))
    out = sampling.replacement_candidates(rows, 1000, [F.lit(S), F.lit(60_000), F.lit(3), F.lit(0)], "r")
    return out.select("track_id", F.size("candidates").cast("long").alias("n"), F.element_at("candidates", 1).alias("first"), (u % F.lit(1000).cast("decimal(20,0)")).cast("long").alias("second"))


@query(f"""WITH {v.TRACKS} SELECT count(*) AS tracks, count(*) FILTER (d = 'very_hard') AS very_hard FROM (SELECT CASE WHEN {hashing.sql_uniform('7', 'track_id', "'snr-bin'")} < 0.4 THEN 'very_hard' ELSE 'other' END AS d FROM tracks)""")
def bin_share(spark, sf):
    names = [b[0] for b in SNR_BINS]
    drawn = sampling.choose(stable_uniform(F.lit(7), F.col("track_id"), F.lit("snr-bin")), names, [F.lit(w) for w in SNR_WEIGHTS])
    return v.paths(spark, sf).select(drawn.alias("d")).agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("d") == "very_hard").alias("very_hard"))


QUERIES, ORACLES = query.queries, query.oracles
