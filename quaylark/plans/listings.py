"""Queries of listings, small waveform steps, token jobs, summaries and the streaming logs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import schedules as sc
from ..functions import signals as sg
from ..functions.hashing import sql_uint64
from ..functions.tokens import Vocabulary
from ..operators import composites, corpus, evaluation, jobs, metrics
from ..sources import files
from ..streaming import streams
from . import decoding
from . import views as v
from .registry import Registry

query = Registry()
VOCAB = Vocabulary(8)


# -- files

_NAMES = ("wav", "WAV", "mp3", "Flac", "aif", "AIFF", "mat", "txt", "ogg", "wav.bak", "m4a")
_FILES = f"""named AS (SELECT p_partkey, 'd' || p_partkey % 9 || '/' || p_partkey % 4 || '/f' || p_partkey || '.' || CASE p_partkey % {len(_NAMES)} {' '.join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_NAMES))} END AS name, p_name || ':' || p_partkey AS content FROM part)"""


def _folder(spark, sf):
    """A file for each part, of many suffixes, in nested folders."""
    i = F.col("p_partkey")
    suffix = F.element_at(F.array(*map(F.lit, _NAMES)), (i % len(_NAMES) + 1).cast("int"))
    name = F.concat(F.lit("d"), (i % 9).cast("string"), F.lit("/"), (i % 4).cast("string"), F.lit("/f"), i.cast("string"), F.lit("."), suffix)
    folder = files.work_folder(spark, "listing")
    files.write_files(v.table(spark, sf, "part", "p_partkey", "p_name").select(name.alias("name"), F.concat("p_name", F.lit(":"), i.cast("string")).alias("content")), folder)
    return folder


def _below(folder: str):
    return F.substring_index(F.col("path"), folder.rsplit("/", 1)[1] + "/", -1)


@query(f"WITH {_FILES} SELECT name, CAST(strlen(content) AS BIGINT) AS length FROM named WHERE lower(regexp_extract(name, '\\.([^.]+)$', 1)) IN {P.CATALOGUE_SUFFIXES}")
def found_audio(spark, sf):
    """Files of a catalogue below a root: six suffixes, any case."""
    folder = _folder(spark, sf)
    return files.audio_files(spark, folder).select(_below(folder).alias("name"), "length")


@query(f"WITH {_FILES} SELECT name, split_part(name, '/', 1) AS collection FROM named WHERE lower(regexp_extract(name, '\\.([^.]+)$', 1)) IN {P.CORPUS_SUFFIXES}")
def found_corpus_files(spark, sf):
    """Files of noise and response corpora: five suffixes; a root that is missing adds none."""
    folder = _folder(spark, sf)
    found = files.corpus_files(spark, folder).unionByName(files.corpus_files(spark, f"{folder}-missing"))
    return found.select(_below(folder).alias("name")).withColumn("collection", F.substring_index("name", "/", 1))


@query(f"WITH {_FILES} SELECT name, sha256(content) AS sha256 FROM named")
def content_digests(spark, sf):
    folder = _folder(spark, sf)
    digests = files.whole_files(spark, folder).select("path", F.sha2("content", 256).alias("sha256"))
    return digests.select(_below(folder).alias("name"), "sha256")


_CSV = ("query_id", "suite_id", "line", "rank", "failed", "absent", "latency")


@query(f"WITH {v.RANKS} SELECT CAST(query_id AS VARCHAR) AS query_id, suite_id, CAST(line AS VARCHAR) AS line, CAST(rank AS VARCHAR) AS rank, CAST(failed AS VARCHAR) AS failed, NULL::VARCHAR AS absent FROM ranks")
def csv_round_trip(spark, sf):
    """Fixed columns with a header; a column that is missing and nulls are empty."""
    path = files.work_folder(spark, "csv")
    files.write_csv(v.ranks(spark, sf).select("query_id", "suite_id", "line", "rank", "failed"), path, list(_CSV[:6]))
    return spark.read.csv(path, header=True, nullValue="").select(*_CSV[:6])


# -- names and waveforms

@query("""WITH n AS (SELECT p_partkey, upper(p_name) || '_' || (['booth', 'Office', 'MEETING', 'lecture', 'stairway', 'corridor', 'aula_carolina', 'hall', 'office_booth'])[p_partkey % 9 + 1] || '.mat' AS name FROM part),
 r AS (SELECT unnest(['booth', 'office', 'meeting', 'lecture', 'stairway', 'corridor', 'aula_carolina']) AS room, unnest(range(7)) AS o) SELECT p_partkey, (SELECT arg_min(room, o) FROM r WHERE contains(lower(name), room)) AS room FROM n""")
def room_names(spark, sf):
    i = F.col("p_partkey")
    word = F.element_at(F.array(*map(F.lit, ("booth", "Office", "MEETING", "lecture", "stairway", "corridor", "aula_carolina", "hall", "office_booth"))), (i % 9 + 1).cast("int"))
    return v.table(spark, sf, "part", "p_partkey", "p_name").select("p_partkey", P.first_room(F.concat(F.upper("p_name"), F.lit("_"), word, F.lit(".mat"))).alias("room"))


_PCM = lambda x: f"array_to_string(list_transform({x}, lambda q: CAST(CAST(floor(q * 1000) AS BIGINT) AS VARCHAR)), ' ')"


def _pcm(x):
    return F.array_join(F.transform(x, lambda q: F.floor(q * 1000).cast("string")), " ")


@query(f"WITH {v.WAVES} SELECT wave_id, n, {_PCM('samples[1:n]')} AS samples FROM waves, (VALUES (8), (20), (64)) t(n)")
def nested_prefixes(spark, sf):
    """Queries of several lengths: each is the beginning of the next."""
    w = v.waves(spark, sf).withColumn("n", F.explode(F.array(F.lit(8), F.lit(20), F.lit(64))))
    return w.select("wave_id", "n", _pcm(sg.prefix(F.col("samples"), F.col("n"))).alias("samples"))


@query(f"WITH {v.WAVES}, s AS (SELECT wave_id, samples[1:wave_id % 30 + 1] AS x FROM waves) SELECT wave_id, {_PCM('list_transform(range(64), lambda i: x[i % len(x) + 1])')} AS samples FROM s")
def tiled_noise(spark, sf):
    """Noise of one to thirty samples, repeated to sixty-four."""
    w = v.waves(spark, sf).withColumn("x", F.slice("samples", F.lit(1), (F.col("wave_id") % 30 + 1).cast("int")))
    return w.select("wave_id", _pcm(sg.tile(F.col("x"), F.lit(64))).alias("samples"))


@query(f"WITH {v.CODES} SELECT wave_id, q, CAST(codes[q + 1][1] + q * 1024 AS INTEGER) AS id FROM codes, range(8) t(q)")
def audio_token_ids(spark, sf):
    c = v.codes(spark, sf).select("wave_id", F.posexplode("codes").alias("q", "row"))
    return c.select("wave_id", F.col("q").cast("long").alias("q"), VOCAB.audio_token(F.col("q"), F.element_at("row", 1)).cast("int").alias("id"))


@query("""SELECT p_size, k AS codebooks, CAST(4 * k AS INTEGER) AS weight, CAST(50 * k AS INTEGER) AS targets, CAST(50 * k + 8 AS INTEGER) AS length, CAST(160 * 50 * k AS INTEGER) AS batch_targets, CAST(36000000 // (p_size * 1000) AS INTEGER) AS per_track
 FROM (SELECT DISTINCT p_size FROM part), (VALUES (2), (4), (6), (8)) t(k)""")
def exposure_sizes(spark, sf):
    """Sizes that follow from codebooks, and passes over catalogues of many sizes."""
    sizes = v.table(spark, sf, "part", "p_size").distinct()
    specs = {k: sc.batch_exposure(k, 1) for k in (2, 4, 6, 8)}
    rows = F.array(*(F.struct(F.lit(k).alias("codebooks"), *(F.lit(specs[k][c]).alias(c) for c in ("weight", "targets", "length", "batch_targets", "exposures"))) for k in specs))
    each = sizes.select("p_size", F.inline(rows))
    return each.select("p_size", "codebooks", "weight", "targets", "length", "batch_targets", F.floor(F.col("exposures") / (F.col("p_size") * 1000)).cast("int").alias("per_track"))


# -- token jobs

def _loud(waves):
    """A quantiser that refuses a batch with a wave whose first sample is above 0.1."""
    if any(w[0] > 0.1 for w in waves):
        raise ValueError("loud")
    return [[int(np.floor(w[1] * 100)), int(np.floor(w[2] * 100))] for w in waves]


@query(f"WITH {v.WAVES} SELECT wave_id AS document_index, CASE WHEN samples[1] > 0.1 THEN NULL ELSE CAST(floor(samples[2] * 100) AS BIGINT) || ' ' || CAST(floor(samples[3] * 100) AS BIGINT) END AS tokens, CASE WHEN samples[1] > 0.1 THEN 'ValueError: loud' END AS error FROM waves")
def tokens_with_fallback(spark, sf):
    """A batch that fails is done one by one: only the wrong documents fail."""
    docs = v.waves(spark, sf).select(F.col("wave_id").alias("document_index"), "samples")
    return composites.tokenize_documents(docs, _loud).select("document_index", F.array_join("tokens", " ").alias("tokens"), "error")


# -- summaries

_KINDS = ("clean", "noise", "rir", "noise_rir")
_DRAWN = f"""drawn AS (SELECT event_id, event_id // 160 AS batch, user_id AS track_id, ({list(_KINDS)})[event_id % 7 % 4 + 1] AS category, CASE WHEN event_id % 7 % 4 IN (1, 3) THEN event_id % 21 END AS snr_db, event_id * 37 % 1009 AS start_sample FROM events)"""


@query(f"""WITH {_DRAWN} SELECT batch, count(*) AS rows, {', '.join(f"round(count(*) FILTER (category = '{k}') / count(*)::DOUBLE, 9) AS {k}_share" for k in _KINDS)}, round(avg(snr_db), 9) AS mean_snr_db, min(start_sample) AS first_start, max(start_sample) AS last_start, round(avg(start_sample), 9) AS mean_start,
 count(track_id) - count(DISTINCT track_id) AS collisions, count(DISTINCT start_sample) = count(*) AS starts_differ FROM drawn GROUP BY batch""")
def augmentation_batches(spark, sf):
    """What the draws of batches of 160 came to."""
    i = F.col("event_id")
    rows = v.table(spark, sf, "events", "event_id", "user_id").select(
        F.floor(i / 160).alias("batch"), F.col("user_id").alias("track_id"), F.element_at(F.array(*map(F.lit, _KINDS)), (i % 7 % 4 + 1).cast("int")).alias("category"), F.when((i % 7 % 4).isin(1, 3), i % 21).alias("snr_db"), (i * 37 % 1009).alias("start_sample"))
    out = metrics.augmentation_stats(rows, ["batch"], list(_KINDS))
    return out.withColumns({c: F.round(c, 9) for c in [*(f"{k}_share" for k in _KINDS), "mean_snr_db", "mean_start"]})


@query(f"""WITH {v.RANKS}, e AS (SELECT condition, k AS snr FROM (SELECT DISTINCT condition FROM ranks), range(13) t(k)), m AS (SELECT condition, CAST(snr AS BIGINT) AS snr, count(*) AS queries, avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END) AS top1 FROM ranks GROUP BY ALL)
 SELECT condition, snr, coalesce(queries, 0) AS queries, round(top1, 9) AS top1 FROM e LEFT JOIN m USING (condition, snr)""")
def metrics_of_empty_groups(spark, sf):
    """A condition without queries has a row that says so."""
    r = v.ranks(spark, sf)
    expected = r.select("condition").distinct().withColumn("snr", F.explode(F.sequence(F.lit(0), F.lit(12))))
    measured = r.groupBy("condition", "snr").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)), 9).alias("top1"))
    return metrics.with_empty_groups(measured, expected, ["condition", "snr"]).select("condition", F.col("snr").cast("long").alias("snr"), "queries", "top1")


@query("""SELECT 'bg_noise' AS dataset, 'train/' || doc_id || '.wav' AS name, 'documents' AS collection, lang AS label, NULL::DOUBLE AS seconds, NULL::BIGINT AS angle FROM documents
 UNION ALL SELECT 'room_ir', 'test/pages/' || page_id || '.wav', 'pages', NULL, NULL, NULL FROM pages
 UNION ALL SELECT 'room_ir', 'train/parts/' || p_partkey || '.wav', 'parts', p_brand, p_size / 10.0::DOUBLE, p_partkey % 12 * 30 FROM part
 UNION ALL SELECT 'room_ir', CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END || '/waves/' || vec_id || '.wav', 'waves', CAST(label AS VARCHAR), NULL, NULL FROM embeddings
 UNION ALL SELECT 'room_ir', 'train/suppliers/' || s_suppkey || '.wav', 'suppliers', NULL, s_acctbal / 100::DOUBLE, NULL FROM supplier""")
def collected_sources(spark, sf):
    """Five collectors whose rows have unlike columns, as one listing."""
    def part(table, key, dataset, split, collection, **more):
        rows = v.table(spark, sf, table)
        relative = F.concat(F.col(key).cast("string"), F.lit(".wav"))
        return rows.select(F.lit(dataset).alias("dataset"), split.alias("split"), F.lit(collection).alias("collection"), relative.alias("relative"), F.concat(F.lit(f"/raw/{collection}/"), relative).alias("path"), *(c.alias(k) for k, c in more.items()))

    train, test = F.lit("train"), F.lit("test")
    rows = corpus.collect_sources([
        part("documents", "doc_id", "bg_noise", train, "documents", label=F.col("lang")),
        part("pages", "page_id", "room_ir", test, "pages"),
        part("part", "p_partkey", "room_ir", train, "parts", angle=(F.col("p_partkey") % 12 * 30).cast("long"), label=F.col("p_brand"), seconds=F.col("p_size") / F.lit(10.0)),
        part("embeddings", "vec_id", "room_ir", F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train"), "waves", label=F.col("label").cast("string")),
        part("supplier", "s_suppkey", "room_ir", train, "suppliers", seconds=F.col("s_acctbal").cast("double") / F.lit(100.0)),
    ])
    return rows.select("dataset", "name", "collection", "label", "seconds", "angle")


# -- evaluation from recipes to metrics

_ASKED = f"""{v.WAVES}, suites AS (SELECT suite_id, lo, hi FROM (VALUES ('noise_0_5db', 0, 5), ('noise_5_10db', 5, 10), ('noise_rir_0_5db', 0, 5), ('noise_rir_5_10db', 5, 10)) t(suite_id, lo, hi)),
 corpus AS (SELECT wave_id, 't' || wave_id AS track_id, suite_id, q AS query_seconds, 't' || wave_id || '__' || suite_id || '__' || q || 's' AS query_id, wave_id % 29 = 0 OR wave_id % 31 = 0 AS failed FROM waves, suites, (VALUES (2), (3)) l(q))"""
_WINDOWS = "SELECT query_id, w AS window_id FROM corpus, (VALUES (0), (5), (10)) t(w) WHERE NOT failed AND (w = 0 OR query_seconds = 3)"


@query(f"""{decoding._beam_sql(_WINDOWS, 10, 2).replace('WITH ', 'WITH ' + _ASKED + ', ', 1)}, r AS (SELECT c.*, b.rank FROM corpus c LEFT JOIN b2 b ON b.query_id = c.query_id AND b.prefix = lpad(CAST(wave_id % 100 AS VARCHAR), 2, '0'))
 SELECT suite_id, CAST(query_seconds AS DOUBLE) AS query_seconds, count(*) AS selected, count(*) FILTER (failed) AS failed, round(count(*) FILTER (rank = 1) / count(*)::DOUBLE, 9) AS top1, round(count(*) FILTER (rank <= 5) / count(*)::DOUBLE, 9) AS top5, round(sum(coalesce(1.0::DOUBLE / rank, 0)) / count(*), 9) AS mrr FROM r GROUP BY suite_id, query_seconds""")
def degraded_evaluation(spark, sf):
    """Every waveform as a track: recipes, noise, rooms, windows and joint beams, to metrics; silent tracks and recipes without a room are failures."""
    w = v.waves(spark, sf)
    i = F.col("wave_id")
    name = F.concat(F.lit("t"), i.cast("string"))
    tracks = w.select(name.alias("track_id"), F.when(i % 29 == 0, F.array_repeat(F.lit(0.0), 64)).otherwise(F.col("samples")).alias("samples"))
    noise = w.where("wave_id < 40").select(F.concat(F.lit("n"), i.cast("string")).alias("path"), F.transform("samples", lambda q: q + 0.01).alias("samples"))
    rooms = w.where("wave_id < 10").select(F.concat(F.lit("r"), i.cast("string")).alias("path"), F.array(*(F.lit(x) for x in (1.0, 0.5, 0.25))).alias("response"))
    recipes = w.select(
        name.alias("track_id"), F.lpad((i % 100).cast("string"), 2, "0").alias("code"), (i % 30).alias("start_sample"), F.concat(F.lit("n"), (i % 40).cast("string")).alias("noise_path"), (i % 50).alias("noise_offset_samples"),
        F.when(i % 31 != 0, F.concat(F.lit("r"), (i % 10).cast("string"))).alias("rir_path"), F.when(i % 31 == 0, "no valid room").alias("error"),
    )
    suites = evaluation.suites(spark, ((0, 5), (5, 10)))
    _, out = jobs.evaluate_degraded(recipes, tracks, noise, rooms, suites, decoding.SCORER, v.SEED, 10, 8, 10, (2, 3), steps=2, path=files.work_folder(spark, "windows"))
    return out.select("suite_id", "query_seconds", "selected", "failed", *(F.round(c, 9).alias(c) for c in ("top1", "top5", "mrr")))


# -- crops and their audit

_CROP_HASH = sql_uint64(str(v.SEED), "7", "batch_idx", "slot", "index", "'replacement'")


@query(f"""WITH RECURSIVE n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), slots AS (SELECT doc_id // 16 AS batch_idx, CAST(doc_id % 16 AS INTEGER) AS slot, doc_id % 13 AS index FROM documents),
 c AS (SELECT batch_idx, slot, index, list_filter(list_concat([index], list_filter(list_transform(range(n), lambda k: CAST((CAST(u % n AS BIGINT) + k) % n AS BIGINT)), lambda x: x <> index)[1:32]), lambda x: x % 4 <> 1) AS fine FROM (SELECT *, {_CROP_HASH} AS u FROM slots, n)),
 g AS (SELECT *, row_number() OVER (PARTITION BY batch_idx ORDER BY slot) - 1 AS k FROM c),
 r AS (SELECT batch_idx, -1::BIGINT AS k, [-1::BIGINT] AS used, NULL::BIGINT AS chosen, NULL::BIGINT AS index FROM (SELECT DISTINCT batch_idx FROM g)
  UNION ALL SELECT batch_idx, k, CASE WHEN x IS NULL THEN used ELSE list_append(used, x) END, x, index FROM (SELECT g.batch_idx, g.k, r.used, g.index, list_filter(g.fine, lambda y: NOT list_contains(r.used, y))[1] AS x FROM r JOIN g ON g.batch_idx = r.batch_idx AND g.k = r.k + 1))
 SELECT count(*) AS slots, count(*) FILTER (chosen <> index) AS replaced, count(*) FILTER (chosen IS NULL) AS skipped, 2 * count(chosen) AS rows FROM r WHERE k >= 0""")
def crop_job_audit(spark, sf):
    """What became of the slots of batches of sixteen, a quarter of whose tracks are silent: observed while the crops are written."""
    w = v.waves(spark, sf)
    i, d = F.col("wave_id"), F.col("doc_id")
    tracks = w.select(i.alias("index"), F.concat(F.lit("t"), i.cast("string")).alias("track_id"), F.when(i % 4 == 1, F.array_repeat(F.lit(0.0), 64)).otherwise(F.transform("samples", lambda q: q + 0.01)).alias("samples"))
    slots = v.table(spark, sf, "documents", "doc_id").select(F.lit(7).cast("long").alias("optimizer_step"), F.floor(d / 16).alias("batch_idx"), (d % 16).cast("int").alias("slot"), (d % 13).alias("index"))
    key = ["optimizer_step", "batch_idx", "slot"]
    noise = slots.select(*key, F.array(*(F.lit(x) for x in (0.5, -0.25, 0.125))).alias("noise"))
    rooms = slots.select(*key, F.array(F.lit(1.0), F.lit(0.5)).alias("response"))
    shares = {k: F.lit(0.25) for k in _KINDS}
    told = jobs.crop_job(slots, tracks, noise, rooms, shares, v.SEED, 8, 16, files.work_folder(spark, "crops"))
    return spark.createDataFrame([tuple(told[k] for k in ("slots", "replaced", "skipped", "rows"))], "slots long, replaced long, skipped long, rows long")


# -- streaming logs

_LINES = "step long, line long, metric string, value double"


def _append(rows, folder):
    rows.coalesce(2).write.mode("append").json(folder)


@query(f"WITH {v.LOG} SELECT metric, step FROM log WHERE line % 3 <> 1 GROUP BY metric, step")
def appended_once(spark, sf):
    """A log read as a stream in two runs, with keys that come again in the second: each key once."""
    rows = v.log(spark, sf)
    source, out, check = (files.work_folder(spark, n) for n in ("log-source", "log-once", "log-check"))
    for part in (rows.where("line % 3 = 0"), rows.where("line % 3 = 2 or line % 6 = 0")):
        _append(part, source)
        streams.append_new(streams.result_stream(spark, source, _LINES), ["metric", "step"], out, check).awaitTermination()
    return spark.read.schema(_LINES).parquet(out).select("metric", "step")


@query(f"WITH {v.LOG} SELECT metric, step, max(line) AS line, arg_max(value, line) AS value FROM log GROUP BY metric, step")
def last_writes(spark, sf):
    """The last write of each key, over three runs whose lines come in no order."""
    rows = v.log(spark, sf)
    source, out, check = (files.work_folder(spark, n) for n in ("writes-source", "writes", "writes-check"))
    for k in (1, 0, 2):
        _append(rows.where(F.col("line") % 3 == k), source)
        streams.upsert_latest(streams.result_stream(spark, source, _LINES), ["metric", "step"], "line", out, check, 8).awaitTermination()
    return streams.read_latest(spark, out, 2, _LINES).select("metric", "step", "line", "value")


@query(f"WITH {v.PATHS}, {v.ASSETS} SELECT doc_id, path FROM paths WHERE doc_id % 11 NOT IN (SELECT p_partkey % 40 FROM part WHERE p_partkey % 40 < 4)")
def streamed_without_rejects(spark, sf):
    """Files that come as a stream, without those that a table of rejects names."""
    p = v.paths(spark, sf).select("doc_id", "path")
    source, out, check = (files.work_folder(spark, n) for n in ("paths-source", "paths-kept", "paths-check"))
    _append(p, source)
    bad = v.table(spark, sf, "part", "p_partkey").select((F.col("p_partkey") % 40).alias("k")).where("k < 4").distinct()
    rejects = p.join(F.broadcast(bad), F.col("doc_id") % 11 == F.col("k"), "left_semi")
    kept = streams.without_rejects(streams.result_stream(spark, source, "doc_id long, path string"), rejects)
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, path string").parquet(out)


QUERIES, ORACLES = query.queries, query.oracles
