"""Whole jobs: corpus preparation, pool manifests, recipes of degraded queries, evaluation by position and by segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals
from ..functions.hashing import stable_mod, stable_uint64
from . import composites, corpus, decode, evaluation, losses, metrics
from .ranking import hash_rank
from .sampling import draw_from_pool, pool_offset


def rule_split(path: Column) -> Column:
    """The split that a path's name gives: development recordings train, evaluation recordings test; NULL for others."""
    name = F.lower(path)
    return F.when(F.contains(name, F.lit("development")), "train").when(F.contains(name, F.lit("evaluation")), "test")


def room_split(room: Column, test_rooms: list[str]) -> Column:
    """Whole rooms are test or train by a fixed list; NULL without a room."""
    return F.when(room.isin(*test_rooms), "test").when(room.isNotNull(), "train")


def json_fingerprint(rows: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """One row: SHA-256 of the rows as a canonical JSON list, by `order`, keys sorted, no white space.

    For listings of bounded size (a pool's files, a catalogue), which go into one value; strings and whole numbers only.
    """
    line = F.to_json(F.struct(*(F.col(f) for f in sorted(fields))), {"ignoreNullFields": "false"})
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("s")))), lambda x: x["s"])
    return rows.agg(F.sha2(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")), 256).alias("fingerprint"))


def ids_fingerprint(ids: DataFrame, column: str) -> DataFrame:
    """One row: SHA-256 of the distinct ids as a canonical JSON list in ascending order; an external listing's, of bounded size."""
    listed = F.transform(F.array_sort(F.collect_set(column)), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return ids.agg(F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256).alias("fingerprint"))


def pool_manifest(files: DataFrame, pool: str) -> DataFrame:
    """(pool, files, bytes, fingerprint) of a pool's files (path, bytes)."""
    size = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return size.crossJoin(json_fingerprint(files, "path", ["path", "bytes"])).select(F.lit(pool).alias("pool"), "files", "bytes", "fingerprint")


def prepare_corpus(sources: DataFrame, expected: DataFrame, status: Column, passthrough: str = "bg_noise") -> dict[str, DataFrame]:
    """The corpus job over sources (dataset, split, collection, relative, digest, ...): its tables by name.

    mismatches: collections whose counts are not as expected (a warning, or an error if strict).  duplicates: what exact
    dedupe removes from all data sets but the pass-through one.  manifest and failures: the others by `status`
    (converted, existing, or another word for a failure).  summary: counts by data set and split.
    """
    rest = sources.where(F.col("dataset") != passthrough)
    keepers = corpus.dedupe_keepers(rest).select("digest", F.concat_ws("/", "split", "collection", "relative").alias("_kept"))
    name = F.concat_ws("/", "split", "collection", "relative")
    kept = rest.join(keepers, "digest").where(name == F.col("_kept")).drop("_kept").dropDuplicates(["digest"])
    done = sources.where(F.col("dataset") == passthrough).unionByName(kept).withColumn("status", status)
    fine = F.col("status").isin("converted", "existing")
    manifest, failures = done.where(fine), done.where(~fine)
    return {
        "mismatches": metrics.reconcile(sources, expected, ["collection"]), "duplicates": corpus.dedupe_audit(rest),
        "manifest": manifest, "failures": failures, "summary": corpus.corpus_summary(manifest, failures),
    }


def with_assets(recipes: DataFrame, noise: DataFrame, rooms: DataFrame, seed: int, context: int) -> DataFrame:
    """Recipes (track_id, ...) with their held-out noise, its offset and their room; every recipe stays, `error` says what it lacks.

    noise: (pool_idx, path, samples, valid), rooms: (pool_idx, path, valid), numbered from 0.  Each recipe draws from
    both pools by its own keys and takes the next valid item; the noise's offset leaves `context` samples where it can.
    """

    def drawn(pool: DataFrame, salt: str, role: str, columns: list[str]) -> DataFrame:
        keys = recipes.select(F.col("track_id").alias("key"))
        seeded = stable_uint64(F.lit(seed), F.col("key"), F.lit(role)).cast("string")
        return draw_from_pool(keys, pool, seeded, salt, F.col("valid")).join(pool, "pool_idx").select(F.col("key").alias("track_id"), "attempt", *columns)

    sound = drawn(noise, "validation-noise", "paper-noise", ["path", "samples"])
    base = stable_uint64(F.lit("validation-noise"), stable_uint64(F.lit(seed), F.col("track_id"), F.lit("paper-noise")).cast("string"))
    sound = sound.select("track_id", F.col("path").alias("noise_path"), pool_offset(base, F.col("attempt"), F.col("samples") - context).alias("noise_offset_samples"))
    room = drawn(rooms, "validation-room-ir", "paper-room-ir", [F.col("path").alias("rir_path")]).drop("attempt")
    lacks = [F.when(F.col(c).isNull(), F.lit(f"no valid {what}")) for c, what in (("noise_path", "noise"), ("rir_path", "room"))]
    return recipes.join(sound, "track_id", "left").join(room, "track_id", "left").withColumn("error", F.nullif(F.concat_ws(", ", *lacks), F.lit("")))


def degraded_waveforms(corpus: DataFrame, tracks: DataFrame, noise: DataFrame, rooms: DataFrame, rate: int, past: int) -> DataFrame:
    """corpus with `samples`, each query's waveform as its recipe says, and `reason` where there is none.

    corpus: (track_id, start_sample, query_seconds, snr_db, rir, noise_path, noise_offset_samples, rir_path, error, ...).
    tracks: (track_id, samples), noise: (path, samples), rooms: (path, response), all at `rate`.  The query has `past`
    samples before it for the room to ring; noise is taken from its offset, and repeated if it ends before the query.
    """
    rows = corpus.join(tracks.select("track_id", F.col("samples").alias("_track")), "track_id", "left")
    rows = rows.join(noise.select(F.col("path").alias("noise_path"), F.col("samples").alias("_noise")), "noise_path", "left")
    rows = rows.join(rooms.select(F.col("path").alias("rir_path"), F.col("response").alias("_room")), "rir_path", "left")
    n = F.ceil(F.col("query_seconds") * rate).cast("int")
    context = signals.with_context(F.col("_track"), F.col("start_sample").cast("int"), F.lit(past), n)
    query = F.slice("_context", past + 1, n)
    rest = F.slice("_noise", (F.col("noise_offset_samples") + 1).cast("int"), F.greatest(F.size("_noise"), F.lit(0)))
    rows = rows.withColumn("_context", context).withColumn("_heard", rest)
    lacks = F.coalesce(
        F.col("error"), F.when(F.col("_track").isNull(), "no track"), signals.invalid_reason(query, n), F.when(F.col("_heard").isNull() | (F.size("_heard") == 0), "no noise"), F.when(F.col("rir") & F.col("_room").isNull(), "no room"),
    )
    rows = rows.withColumn("reason", lacks)
    wave = composites.suite_waveform(F.col("_context"), F.lit(past), F.col("_heard"), F.col("_room"), F.col("snr_db"), F.col("rir"))
    return rows.withColumn("samples", F.when(F.col("reason").isNull(), wave)).drop("_track", "_noise", "_room", "_context", "_heard")


def evaluate_degraded(
    recipes: DataFrame, tracks: DataFrame, noise: DataFrame, rooms: DataFrame, suite_table: DataFrame, scorer: decode.Scorer, seed: int, rate: int, past: int, width: int, lengths=evaluation.LENGTHS,
    window_seconds: float = evaluation.WINDOW_SECONDS, hop_seconds: float = evaluation.HOP_SECONDS, steps: int = decode.DIGITS, done: DataFrame | None = None, path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The whole evaluation: every recipe in every suite and length, its waveform, the joint beam over its windows; (result rows, metrics by suite and length).

    recipes: (track_id, code, start_sample) with assets (with_assets()).  done: results of an earlier run, which are not
    made again; the metrics are then of the rest.  A recipe without an asset or a waveform is a failed query.
    path: a new folder where the windows are stored; without it every step of the beams makes the waveforms again.
    """
    corpus = evaluation.query_corpus(recipes, suite_table, seed, lengths)
    if done is not None:
        corpus = evaluation.pending(corpus, done)
    heard = degraded_waveforms(decode.dealt(corpus, "id"), tracks, noise, rooms, rate, past)
    asked = heard.select(F.col("id").alias("query_id"), "track_id", "code", "suite_id", "query_seconds", "samples", "reason", F.lit(None).cast("double").alias("latency"))
    return composites.evaluate_joint(asked, scorer, width, round(window_seconds * rate), round(hop_seconds * rate), ["suite_id", "query_seconds"], steps, path)


def pair_keys(pairs: DataFrame, seed: int, clean_steps: int) -> DataFrame:
    """Keys of pairs (optimizer_step, batch_idx, pair, track_id, and both views and starts): the pair's, and its noise's.

    Noise is loaded only once the clean phase is over; before it, noise_key is NULL.
    """
    key = stable_uint64(F.lit(seed), F.col("track_id"), F.col("anchor_view"), F.col("anchor_start"), F.col("other_view"), F.col("other_start"))
    keyed = pairs.withColumn("pair_key", key)
    noise = stable_uint64(F.lit(seed), F.col("optimizer_step"), F.col("batch_idx"), F.col("pair"), F.col("pair_key"), F.lit("training-noise"))
    return keyed.withColumn("noise_key", F.when(F.col("optimizer_step") >= clean_steps, noise))


def position_key(seed: int, track: Column, view: Column, start: Column) -> Column:
    """The key by which an evaluation row draws its held-out noise."""
    return stable_uint64(F.lit(seed), track, view, start)


def pass_batches(segments: DataFrame, n_tracks: int, tracks: int, each: int, per_track: int, seed: int, catalogue_pass: int, multiple: int = 1) -> DataFrame:
    """(batch_idx, slot, track_id, segment): every segment of every track once a pass, `each` of a track at a time.

    segments: (track_id, segment), numbered from 0.  In round r tracks come in an order of their own, in batches of
    `tracks` tracks; a last short batch takes the first tracks again, and first batches are repeated up to a multiple.
    """
    if per_track % each:
        raise ValueError("segments of a track don't divide into rounds")
    rounds, batches = per_track // each, -(-n_tracks // tracks)
    known = segments.select("track_id").distinct()
    out = None
    for r in range(rounds):
        order = hash_rank(known, F.concat_ws(":", F.lit(str(seed + catalogue_pass * rounds + r)), "track_id", F.lit("pass")), "place", [F.col("track_id")])
        again = order.where(F.col("place") < batches * tracks - n_tracks).withColumn("place", F.col("place") + n_tracks)
        some = order.unionByName(again).select("track_id", (F.floor(F.col("place") / tracks) + r * batches).cast("long").alias("batch_idx"), (F.col("place") % tracks).cast("int").alias("slot"), F.lit(r).alias("_r"))
        out = some if out is None else out.unionByName(some)
    out = out.join(segments.withColumn("_r", F.floor(F.col("segment") / each).cast("int")), ["track_id", "_r"]).drop("_r")
    total = rounds * batches
    copies = [out]
    for k in range(-total % multiple):
        copies.append(out.where(F.col("batch_idx") == k % min(multiple, total)).withColumn("batch_idx", F.lit(total + k).cast("long")))
    for c in copies[1:]:
        out = out.unionByName(c)
    return out


def rank_slice(batches: DataFrame, tracks: int, world: int, rank: int) -> DataFrame:
    """The part of each batch that one of several workers takes: consecutive slots."""
    if tracks % world or not 0 <= rank < world:
        raise ValueError("tracks of a batch don't divide among the workers")
    n = tracks // world
    return batches.where(F.col("slot").between(rank * n, rank * n + n - 1))


def evaluate_positions(rows: DataFrame, scorer: decode.Scorer, width: int, steps: int = decode.DIGITS) -> tuple[DataFrame, DataFrame]:
    """Beams and greedy codes of cached positions (query_id, code, view_type, start_key), and their metrics by view and by start."""
    found = composites.identify(rows.select("query_id", F.lit(0).alias("window_id")), scorer, width, steps)
    told = rows.select("query_id", "code", "view_type", "start_key").join(found, "query_id").withColumn("ended", F.lit(True))
    each = told.withColumn("start_key", F.explode(F.array(F.lit(None).cast("long"), F.col("start_key"))))  # both groupings in one pass
    return told, metrics.generation_metrics(each, ["view_type", "start_key"])


def monitor_probe(rows: DataFrame, scorer: decode.Scorer, width: int, steps: int = decode.DIGITS) -> DataFrame:
    """Metrics of a monitoring run's queries (query_id, code, condition, snr_db): by condition, and by condition and SNR."""
    found = composites.identify(rows.select("query_id", F.lit(0).alias("window_id")), scorer, width, steps)
    told = rows.join(found, "query_id").withColumn("ended", F.lit(True))
    levels = F.array(F.struct(F.lit("condition").alias("level"), F.lit(None).cast("double").alias("snr_db")), F.struct(F.lit("snr").alias("level"), F.col("snr_db")))
    return metrics.generation_metrics(told.select("code", "greedy", "beam", "ended", "condition", F.inline(levels)), ["level", "condition", "snr_db"])


def evaluate_segments(queries: DataFrame, tokens: DataFrame, rejects: DataFrame, scorer: decode.Scorer, width: int, weight: float) -> DataFrame:
    """One row of metrics over track positions (query_id, track_id, path, code, seconds): generation and teacher-forced losses.

    queries is read several times: where it is costly, store it first.  Queries of rejected files are left out, and their tracks count as skipped.  tokens: (query_id, loss, family,
    correct), the losses of each query's document; means are of the queries' means.
    """
    all_tracks = queries.agg(F.count_distinct("track_id").alias("selected_tracks"))
    used = queries.join(rejects.select("path").distinct(), "path", "left_anti")
    found = composites.identify(used.select("query_id", F.lit(0).alias("window_id")), scorer, width)
    told = used.join(found, "query_id").withColumn("ended", F.lit(True))
    got = metrics.generation_metrics(told, [], more=(F.count_distinct("track_id").alias("evaluated_tracks"), F.avg("seconds").alias("mean_latency_seconds")))
    per = losses.family_losses(tokens.join(used.select("query_id"), "query_id", "left_semi"), ["query_id"], weight)
    exact = F.avg((F.col("digit_accuracy") == 1.0).cast("double")).alias("exact_accuracy")  # all digits are correct; NULL without digits
    mean = per.agg(*(F.avg(c).alias(c) for c in ("loss", "audio_loss", "digit_loss", "boundary_loss", "digit_accuracy")), exact)
    out = got.crossJoin(all_tracks).crossJoin(mean)
    return out.withColumn("skipped_tracks", F.col("selected_tracks") - F.col("evaluated_tracks")).withColumn("audio_perplexity", metrics.perplexity(F.col("audio_loss")))


#: Files that a job may know as unusable without asking for a join: their numbers travel to every task.
MOST_BAD = 1_000_000


def crop_job(slots: DataFrame, tracks: DataFrame, noise: DataFrame, rooms: DataFrame, shares: dict[str, Column], seed: int, past: int, length: int, path: str) -> dict[str, int]:
    """Write the crops of a plan's batches to path, and say in the same pass what became of its slots.

    slots: (optimizer_step, batch_idx, slot, index), noise and rooms also by slot: (optimizer_step, batch_idx, slot,
    noise) and (..., response).  tracks: (index, track_id, samples), numbered from 0.  A track that is silent, not
    finite or shorter than a crop is replaced by another of its batch's keyed sequence, which no slot of the batch has;
    a slot for which none is left is skipped.  Each other slot gives its clean anchor and its secondary view; a view
    that a room silences is a copy of the anchor.  The counts are observed while the rows are written (a stage that
    runs again for a lost executor may be counted twice): slots, replaced, skipped, rows, fallbacks, degraded.
    """
    from pyspark.sql import Observation

    batch = ["optimizer_step", "batch_idx"]
    usable = (F.size("samples") >= length) & signals.invalid_reason(F.col("samples"), F.size("samples")).isNull()
    n = tracks.agg(F.max("index")).first()[0]
    bad = {r["index"] for r in tracks.where(~F.coalesce(usable, F.lit(False))).select("index").limit(MOST_BAD + 1).collect()}
    if len(bad) > MOST_BAD:
        raise ValueError(f"more than {MOST_BAD} unusable tracks: leave them out of the catalogue first")
    identities, crops = Observation("identities"), Observation("crops")
    chosen = composites.replace_identities(slots, (-1 if n is None else n) + 1, lambda k: k not in bad, seed)
    replaced = F.col("chosen").isNotNull() & (F.col("chosen") != F.col("index"))
    chosen = chosen.observe(identities, F.count(F.lit(1)).alias("slots"), F.count_if(replaced).alias("replaced"), F.count_if(F.col("chosen").isNull()).alias("skipped"))
    found = chosen.where("chosen is not null").join(tracks.withColumnRenamed("index", "chosen"), "chosen").join(noise, [*batch, "slot"], "left").join(rooms, [*batch, "slot"], "left")
    pairs = found.withColumn("pair_id", F.struct(*batch, "slot", "index"))
    rows = composites.crop_pairs(pairs, [F.lit(seed), F.col("optimizer_step"), F.col("batch_idx"), F.col("slot")], shares, past, length)
    second = F.col("role") == "secondary"
    rows = rows.observe(crops, F.count(F.lit(1)).alias("rows"), F.count_if(second & F.col("fallback")).alias("fallbacks"), F.count_if(second & F.col("degraded")).alias("degraded"))
    rows.select("pair_id.*", "track_id", "role", "start", "category", "snr_bin", "snr_db", "fallback", "degraded", "wave").write.parquet(path)
    return identities.get | crops.get


def replacement_start(seed: int, step: Column, batch: Column, slot: Column, index: Column, n: int) -> Column:
    """Where the search for another identity begins."""
    return stable_mod(F.lit(n), F.lit(seed), step, batch, slot, index, F.lit("replacement"))
