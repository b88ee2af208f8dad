"""Queries over files that Spark writes from the tables and reads again."""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import signals
from ..operators import catalogue, corpus, quantiser
from ..sources import files, recordings, reject_log, shard_job, token_shards
from ..streaming import batches
from . import jobs
from . import views as v
from .registry import Registry

query = Registry()

_FORMS = ((8, "pcm"), (16, "pcm"), (24, "pcm"), (32, "pcm"), (32, "float"), (64, "float"))
_REC = f"""{v.WAVES}, form AS (SELECT wave_id, 'w' || wave_id || '.wav' AS name, 8000 + 1000 * (wave_id % 5) AS rate, 1 + wave_id % 3 AS channels,
 CASE wave_id % 6 {' '.join(f'WHEN {k} THEN {b}' for k, (b, _) in enumerate(_FORMS))} END AS bits, CASE WHEN wave_id % 6 >= 4 THEN 'float' ELSE 'pcm' END AS kind, list_transform(samples, lambda q: greatest(-1.0, least(1.0, q)) / 2) AS x FROM waves)"""


def _recordings(spark, sf, broken: bool = False):
    """All waveforms as files of one to three channels (the same wave, halved and negated) in six forms."""
    folder = files.work_folder(spark, "recordings")
    i = F.col("wave_id")
    x = F.transform("samples", lambda q: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q)) / 2)
    pick = lambda k: F.element_at(F.array(*(F.lit(f[k]) for f in _FORMS)), (i % 6 + 1).cast("int"))
    w = v.waves(spark, sf).select(i, F.concat(F.lit("w"), i.cast("string"), F.lit(".wav")).alias("name"), x.alias("x"), (8000 + 1000 * (i % 5)).alias("rate"), pick(0).alias("bits"), pick(1).alias("kind"))
    more = F.array(F.col("x"), F.transform("x", lambda q: q / 2), F.transform("x", lambda q: -q))
    rows = w.select("name", F.slice(more, F.lit(1), (i % 3 + 1).cast("int")).alias("samples"), "rate", "bits", "kind")
    recordings.write_recordings(rows, folder).write.format("noop").mode("overwrite").save()
    return folder


@query(f"""WITH {_REC} SELECT name, kind, CAST(rate AS INTEGER) AS rate, CAST(channels AS INTEGER) AS channels, CAST(bits AS INTEGER) AS bits, CAST(len(x) AS BIGINT) AS frames, round(len(x) / CAST(rate AS DOUBLE), 9) AS duration,
 CAST(44 + (len(x) * channels * bits // 8) + (len(x) * channels * bits // 8) % 2 AS BIGINT) AS length FROM form""")
def recording_headers(spark, sf):
    """Durations and forms from headers alone."""
    got = recordings.read_recordings(spark, _recordings(spark, sf)).where("error is null")
    return got.select(P.basename(F.col("path")).alias("name"), "kind", "rate", "channels", "bits", "frames", F.round("duration", 9).alias("duration"), "length")


_LEVEL = "CASE WHEN kind = 'float' THEN 0 WHEN bits = 8 THEN 7 WHEN bits = 16 THEN 15 WHEN bits = 24 THEN 23 ELSE 31 END"


@query(f"""WITH {_REC}, c AS (SELECT name, kind, bits, k AS channel, list_transform(x, lambda q: CASE k WHEN 0 THEN q WHEN 1 THEN q / 2 ELSE -q END) AS x FROM form, range(3) t(k) WHERE k < channels)
 SELECT name, CAST(channel AS INTEGER) AS channel, array_to_string(list_transform(x, lambda q: CAST(CAST(round_even((CASE WHEN kind = 'float' THEN q ELSE round_even(q * pow(2.0, {_LEVEL}), 0) / pow(2.0, {_LEVEL}) END) * 1000000, 0) AS BIGINT) AS VARCHAR)), ' ') AS samples FROM c""")
def recording_channels(spark, sf):
    """Samples of every channel, to a millionth."""
    got = recordings.read_recordings(spark, _recordings(spark, sf), samples=True).where("error is null")
    each = got.select(P.basename(F.col("path")).alias("name"), F.posexplode("samples").alias("channel", "x"))
    return each.select("name", "channel", F.array_join(F.transform("x", lambda q: F.bround(q * 1_000_000).cast("long").cast("string")), " ").alias("samples"))


# -- flat token shards

def _shards(spark, sf):
    docs = jobs._store(spark, sf)[0].where("corpus_role = 'canonical_training'")
    bad = F.col("document_index") % 13 == 0
    rows = docs.select("document_index", "track_id", "code", F.when(bad, "failed").otherwise("ok").alias("status"), F.when(bad, 0).otherwise(F.size("tokens")).alias("token_count"), F.when(bad, "bad").alias("error"), "segment_start", "corpus_role", "tokens", F.floor(F.col("document_index") / 100).cast("int").alias("shard_id"))
    path = files.work_folder(spark, "shards")
    token_shards.write_shards(rows, path, "f1", vocabulary=jobs.VOCAB.total)
    return token_shards.read_index(spark, path, "f1", "canonical_training", "full")


_SHARDS = f"""{jobs._STORE}, flat_docs AS (SELECT document_index, track_id, code, segment_start, tokens, document_index // 100 AS shard_id, document_index % 13 <> 0 AS ok FROM docs WHERE corpus_role = 'canonical_training')"""


@query(f"""WITH {_SHARDS} SELECT document_index, track_id, code, CAST(shard_id AS INTEGER) AS shard_id, CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, CAST(CASE WHEN ok THEN len(tokens) ELSE 0 END AS INTEGER) AS token_count,
 CAST(coalesce(sum(CASE WHEN ok THEN len(tokens) ELSE 0 END) OVER (PARTITION BY shard_id ORDER BY document_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS token_offset, segment_start FROM flat_docs""")
def flat_shard_index(spark, sf):
    """Offsets of documents inside flat 16-bit shards of a hundred document numbers each."""
    return _shards(spark, sf).select("document_index", "track_id", "code", "shard_id", "status", "token_count", "token_offset", "segment_start")


@query(f"""WITH {_SHARDS} SELECT document_index, array_to_string(tokens[document_index % 7 + 1:document_index % 7 + 5], ' ') AS span FROM flat_docs WHERE ok""")
def flat_shard_spans(spark, sf):
    """Five tokens of each document, read by their offset in the shard."""
    rows = _shards(spark, sf).where("status = 'ok'").withColumns({"first": F.col("document_index") % 7, "n": F.lit(5)})
    return token_shards.read_tokens(rows, "first", "n").select("document_index", F.array_join("tokens", " ").alias("span"))


# -- reject log

@query(f"""WITH {v.ASSETS}, told AS (SELECT path, 'nine ' || min(p_partkey) AS error, 1 AS turn FROM assets WHERE p_partkey % 9 = 0 GROUP BY path UNION ALL SELECT path, 'six ' || min(p_partkey), 2 FROM assets WHERE p_partkey % 6 = 0 GROUP BY path
 UNION ALL SELECT path, 'all ' || min(p_partkey), 3 FROM assets WHERE p_partkey % 5 = 0 GROUP BY path) SELECT path, arg_min(error, turn) AS error FROM told GROUP BY path""")
def reject_log_commits(spark, sf):
    """Three writers' rejects, one after another, as one log: the first error of each path."""
    a = v.assets(spark, sf).select("p_partkey", "path")
    log = reject_log.RejectLog(spark, files.work_folder(spark, "rejects"))
    for n, word in ((9, "nine"), (6, "six"), (5, "all")):
        some = a.where(F.col("p_partkey") % n == 0).groupBy("path").agg(F.min("p_partkey").alias("k"))
        log.add(some.select("path", F.concat(F.lit(f"{word} "), F.col("k").cast("string")).alias("error")))
    return log.read()


# -- lines

_LINE = "CASE WHEN event_id % 13 = 0 THEN '{\"step\": ' || event_id WHEN event_id % 17 = 0 THEN '' ELSE '{\"step\": ' || event_id || '}' END"


@query(f"""WITH l AS (SELECT event_id % 7 AS part, row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) AS line, {_LINE} AS text FROM events) SELECT CAST(part AS INTEGER) AS part, line, text FROM l WHERE text <> '' AND right(text, 1) <> '}}'""")
def malformed_log_lines(spark, sf):
    """Line numbers of cut lines in seven logs with blank lines."""
    e = v.table(spark, sf, "events", "event_id")
    i = F.col("event_id")
    whole = F.concat(F.lit('{"step": '), i.cast("string"))
    rows = e.select((i % 7).cast("int").alias("part"), i, F.when(i % 13 == 0, whole).when(i % 17 == 0, "").otherwise(F.concat(whole, F.lit("}"))).alias("value"))
    path = files.work_folder(spark, "logs")
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    return files.malformed_lines(spark, path).select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("int").alias("part"), "line", "text")


# -- recordings at other rates

def _resampled_sql(old: int, new: int) -> str:
    cut, z = min(1.0, new / old), 32
    half = -(-z * old // new) if new < old else z
    u, x = f"least(1.0, abs(x) * {cut}::DOUBLE / {z})", f"(pi() * {cut}::DOUBLE * x)"
    kernel = f"(CASE WHEN x = 0 THEN 1.0 ELSE sin({x}) / {x} END) * (0.42 + 0.5 * cos(pi() * {u}) + 0.08 * cos(2 * pi() * {u}))"
    return f"""t{new} AS (SELECT m, m * {old} // {new} + k AS place, m * {old} / {new}.0::DOUBLE - (m * {old} // {new} + k) AS x FROM range({-(-64 * new // old)}) a(m), range({1 - half}, {half + 1}) b(k)),
 k{new} AS (SELECT m, place, {kernel} AS h, ((place % 126) + 126) % 126 AS q FROM t{new}), h{new} AS (SELECT m, place, q, h / sum(h) OVER (PARTITION BY m) AS h FROM k{new}),
 e{new} AS (SELECT m, h, CASE WHEN q <= 63 THEN q ELSE 126 - q END AS q, CASE WHEN q <= 63 THEN 1.0 ELSE -1.0 END AS sign, place FROM h{new}),
 y{new} AS (SELECT wave_id, m, sum(h * (x[1] + (x[64] - x[1]) * place / 63.0::DOUBLE + sign * (x[q + 1] - x[1] - (x[64] - x[1]) * q / 63.0::DOUBLE))) AS y FROM (SELECT wave_id, samples AS x FROM waves), e{new} GROUP BY wave_id, m)"""


@query(f"""WITH {v.WAVES}, {_resampled_sql(8, 12)}, {_resampled_sql(8, 5)} SELECT wave_id, rate, array_to_string(list(CAST(CAST(round(y * 100000) AS BIGINT) AS VARCHAR) ORDER BY m), ' ') AS samples FROM (SELECT *, 12 AS rate FROM y12 UNION ALL SELECT *, 5 FROM y5) GROUP BY wave_id, rate""")
def resampled_waves(spark, sf):
    """Waveforms of a rate of 8 at rates of 12 and 5, ends included."""
    w = v.waves(spark, sf).select("wave_id", "samples", F.explode(F.array(F.lit(12), F.lit(5))).alias("rate"))
    y = signals.resample(F.col("samples"), F.lit(8), F.col("rate"))
    return w.select("wave_id", "rate", F.array_join(F.transform(y, lambda q: F.round(q * 100_000).cast("long").cast("string")), " ").alias("samples"))


# -- rare labels

@query("""WITH RECURSIVE h AS (SELECT n_chars // 150 AS label, count(*) AS n FROM documents GROUP BY 1),
 r AS (SELECT list(struct_pack(label := label, n := n)) AS g, list(struct_pack(old := label, new := label)) AS goes, 0 AS step FROM h
  UNION ALL SELECT list_transform(list_filter(g, lambda x: x.label <> a), lambda x: struct_pack(label := x.label, n := CASE WHEN x.label = b THEN x.n + c ELSE x.n END)), list_transform(goes, lambda x: struct_pack(old := x.old, new := CASE WHEN x.new = a THEN b ELSE x.new END)), step + 1 FROM
   (SELECT *, list_min(list_transform(list_filter(g, lambda x: x.label <> a), lambda x: struct_pack(d := abs(x.label - a), label := x.label))).label AS b, list_filter(g, lambda x: x.label = a)[1].n AS c FROM
    (SELECT *, list_min(list_transform(list_filter(g, lambda x: x.n < 9), lambda x: x.label)) AS a FROM r WHERE len(g) > 1) WHERE a IS NOT NULL)),
 m AS (SELECT unnest(arg_max(goes, step)) AS x FROM r) SELECT doc_id, m.x.new AS label FROM documents JOIN m ON m.x.old = n_chars // 150""")
def merged_rare_labels(spark, sf):
    """Lengths in steps of 150 characters; labels of fewer than nine documents join their neighbours."""
    d = v.table(spark, sf, "documents", "doc_id", "n_chars")
    return corpus.apply_merge(d.select("doc_id", F.floor(F.col("n_chars") / 150).alias("label")), "label", 9)


# -- residual quantiser

def _picked(word: str, n: int) -> str:
    return f"(SELECT row_number() OVER (ORDER BY h, wave_id) - 1 AS code, samples AS c FROM (SELECT wave_id, samples, {v.hash_order(f"'{word}'", 'CAST(wave_id AS VARCHAR)')} AS h FROM waves ORDER BY h, wave_id LIMIT {n}))"


def _book(spark, sf, word: str, n: int) -> np.ndarray:
    """The n waveforms that come first in a hash order: a codebook of stated size."""
    h = F.substring(F.sha2(F.concat_ws(":", F.lit(word), F.col("wave_id").cast("string")), 256), 1, 16)
    return np.array([r["samples"] for r in v.waves(spark, sf).select("samples", "wave_id").orderBy(h, "wave_id").limit(n).collect()])


_DISTANCE = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_LEFT = "list_transform(list_zip(x, c), lambda p: p[1] - p[2])"


def _nearest_sql(rows: str, book: str) -> str:
    return f"(SELECT wave_id, x, code, c, d FROM (SELECT r.wave_id, r.x, b.code, b.c, {_DISTANCE.replace('x, c', 'r.x, b.c')} AS d FROM {rows} r, {book} b) QUALIFY row_number() OVER (PARTITION BY wave_id ORDER BY d, code) = 1)"


def _vectors(spark, sf):
    return v.waves(spark, sf).select("wave_id", F.col("samples").alias("x"))


@query(f"""WITH {v.WAVES}, book1 AS {_picked('one', 16)}, book2 AS (SELECT code, list_transform(c, lambda q: q / 2) AS c FROM {_picked('two', 16)}), r0 AS (SELECT wave_id, samples AS x FROM waves),
 s1 AS {_nearest_sql('r0', 'book1')}, r1 AS (SELECT wave_id, {_LEFT} AS x, code FROM s1), s2 AS {_nearest_sql('r1', 'book2')}
 SELECT s1.wave_id, CAST(s1.code AS INTEGER) AS first, CAST(s2.code AS INTEGER) AS second, round(s2.d, 6) AS error FROM s1 JOIN s2 USING (wave_id)""")
def vector_codes(spark, sf):
    """Codes of whole vectors by two given codebooks, the second for what the first leaves over."""
    got = quantiser.encode(_vectors(spark, sf), [_book(spark, sf, "one", 16), _book(spark, sf, "two", 16) / 2])
    return got.select("wave_id", F.element_at("codes", 1).alias("first"), F.element_at("codes", 2).alias("second"), F.round("error", 6).alias("error"))


def _lloyd_sql(steps: int) -> str:
    parts = [f"c0 AS {_picked('lloyd', 8)}", "r AS (SELECT wave_id, samples AS x FROM waves)"]
    for k in range(steps):
        parts.append(f"a{k} AS {_nearest_sql('r', f'c{k}')}")
        parts.append(f"m{k} AS (SELECT code, i, avg(x[i]) AS v FROM a{k}, range(1, 65) t(i) GROUP BY code, i)")
        parts.append(f"c{k + 1} AS (SELECT o.code, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN (SELECT code, list(v ORDER BY i) AS c FROM m{k} GROUP BY code) n USING (code))")
    return ", ".join([*parts, f"e AS {_nearest_sql('r', f'c{steps}')}"])


@query(f"WITH {v.WAVES}, {_lloyd_sql(3)} SELECT CAST(code AS INTEGER) AS code, count(*) AS n, round(sum(d), 6) AS error, round(any_value(c[1]), 9) AS first FROM e GROUP BY code")
def lloyd_codebook(spark, sf):
    """Three Lloyd steps from eight given entries: entries, their members and distortion."""
    rows = _vectors(spark, sf)
    book = quantiser.lloyd(rows, _book(spark, sf, "lloyd", 8), 3)
    entries = F.array(*(F.lit(float(x)) for x in book[:, 0]))
    got = quantiser.encode(rows, [book]).groupBy(F.element_at("codes", 1).alias("code")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("error"), 6).alias("error"))
    return got.withColumn("first", F.round(F.get(entries, F.col("code")), 9))


_MEL = lambda hz: 2595 * np.log10(1 + hz / 700)


@query(f"""WITH {v.WAVES}, w AS (SELECT n, 0.5 - 0.5 * cos(2 * pi() * n / 32) AS w FROM range(32) t(n)), f AS (SELECT wave_id, s, n, samples[s * 16 + n + 1] * w AS y FROM waves, range(3) a(s), w),
 p AS (SELECT wave_id, s, k, pow(sum(y * cos(2 * pi() * k * n / 32)), 2) + pow(sum(y * sin(2 * pi() * k * n / 32)), 2) AS power FROM f, range(17) b(k) GROUP BY wave_id, s, k),
 e AS (SELECT j, 700 * (pow(10, {_MEL(4000)}::DOUBLE * j / 7 / 2595) - 1) AS hz FROM range(8) c(j)),
 m AS (SELECT lo.j AS band, k, greatest(0, least((k * 250 - lo.hz) / (mid.hz - lo.hz), (hi.hz - k * 250) / (hi.hz - mid.hz))) AS h FROM e lo JOIN e mid ON mid.j = lo.j + 1 JOIN e hi ON hi.j = lo.j + 2, range(17) d(k))
 SELECT wave_id, CAST(s AS INTEGER) AS frame, CAST(band AS INTEGER) AS band, round(ln(greatest(1e-10, sum(power * h))), 6) AS level FROM p JOIN m USING (k) GROUP BY wave_id, s, band""")
def log_mel_frames(spark, sf):
    """Frames of 32 samples every 16, six bands, at a rate of 8000."""
    frames = v.waves(spark, sf).select("wave_id", F.posexplode(quantiser.log_mel(F.col("samples"), 8000, 32, 16, 6)).alias("frame", "levels"))
    return frames.select("wave_id", "frame", F.posexplode("levels").alias("band", "level")).withColumn("level", F.round("level", 6))


# -- jobs that do only what is missing

def _twice(spark, sf):
    """A token job run over all waveforms, then after some shards' input has changed, some lie in ruins and new ones have come: (path, job's output schema, what the second run did)."""
    i = F.col("wave_id")
    rows = v.waves(spark, sf).select(F.floor(i / 20).cast("int").alias("shard_id"), i, F.transform("samples", lambda q: F.floor(q * 100).cast("int")).alias("tokens"))

    def job(df):
        bad = F.col("wave_id") % 23 == 0
        return df.select("shard_id", "wave_id", F.when(~bad, F.slice("tokens", 1, 8)).alias("tokens"), F.when(bad, "unreadable").alias("error"))

    path = files.work_folder(spark, "shard-job")
    shard_job.run_shards(rows.where("shard_id % 7 <> 6"), job, path, "f1")
    kind = job(rows.limit(0)).schema
    ruined = shard_job.read_output(spark, path, kind).where("shard_id % 5 = 3 and wave_id % 2 = 0")
    keep = files.work_folder(spark, "ruins")
    ruined.write.parquet(keep)
    spark.read.parquet(keep).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_id").parquet(f"{path}/data")
    changed = rows.withColumn("tokens", F.when((F.col("shard_id") % 5 == 2) & (i % 20 == 4), F.reverse("tokens")).otherwise(F.col("tokens")))
    return path, kind, shard_job.run_shards(changed, job, path, "f1"), changed


_SHARD = f"{v.WAVES}, s AS (SELECT wave_id // 20 AS shard_id, wave_id, list_transform(samples, lambda q: CAST(floor(q * 100) AS INTEGER)) AS tokens FROM waves)"


@query(f"WITH {_SHARD} SELECT DISTINCT CAST(shard_id AS INTEGER) AS shard_id, CASE WHEN shard_id % 7 = 6 THEN 'missing' WHEN shard_id % 5 = 2 THEN 'input' ELSE 'damaged' END AS reason FROM s WHERE shard_id % 7 = 6 OR (shard_id % 5 = 2 AND shard_id IN (SELECT shard_id FROM s WHERE wave_id % 20 = 4)) OR shard_id % 5 = 3")
def shards_done_again(spark, sf):
    """What a second run does: shards that were missing, whose input has changed, or whose output is damaged."""
    return _twice(spark, sf)[2]


@query(f"WITH {_SHARD} SELECT wave_id, CAST(shard_id AS INTEGER) AS shard_id, CASE WHEN wave_id % 23 <> 0 THEN array_to_string(CASE WHEN shard_id % 5 = 2 AND wave_id % 20 = 4 THEN list_reverse(tokens) ELSE tokens END[1:8], ' ') END AS tokens, CASE WHEN wave_id % 23 = 0 THEN 'unreadable' END AS error FROM s")
def shards_after_two_runs(spark, sf):
    path, kind, _, _ = _twice(spark, sf)
    return shard_job.read_output(spark, path, kind).select("wave_id", "shard_id", F.array_join("tokens", " ").alias("tokens"), "error")


# -- batches as a stream

@query(f"""WITH {v.TRACKS}, cohort AS (SELECT * FROM (SELECT track_id, row_number() OVER (ORDER BY {v.hash_order(f"'{v.SEED}'", 'track_id', "'cohort'")}, track_id) - 1 AS pos FROM tracks) WHERE pos < 100),
 o AS (SELECT track_id, row_number() OVER (ORDER BY {v.hash_order(f"'{v.SEED + 2}'", 'track_id', "'batch'")}, track_id) - 1 AS place FROM cohort), f AS (SELECT track_id, place FROM o UNION ALL SELECT track_id, place + 100 FROM o WHERE place < 12),
 b AS (SELECT track_id, place // 16 AS batch_idx, CAST(place % 16 AS INTEGER) AS slot FROM f), e AS (SELECT * FROM b UNION ALL SELECT track_id, 7, slot FROM b WHERE batch_idx = 0)
 SELECT track_id, batch_idx, slot, CAST((2 * 8 + batch_idx) // 4 AS BIGINT) AS optimizer_step FROM e""")
def delivered_batches(spark, sf):
    """A batch plan as a stream that fails after one micro-batch of three and goes on from its checkpoint."""
    cohort = catalogue.sample_cohort(v.tracks(spark, sf), v.SEED, 100)
    plan = catalogue.batch_plan(cohort, v.SEED, 2, 100, 16, 4).select("track_id", "batch_idx", "slot", "optimizer_step")
    path, folder, check = (files.work_folder(spark, n) for n in ("plan", "delivered", "plan-checkpoint"))
    n = batches.write_plan(plan, path)
    first = batches.deliver(batches.plan_stream(spark, path, plan.schema, check, 3), folder, check, until=1)
    with contextlib.suppress(StreamingQueryException):
        first.awaitTermination(600)
    first.stop()
    batches.deliver_all(batches.plan_stream(spark, path, plan.schema, check, 3), folder, check, n)
    return batches.delivered(spark, folder, plan.schema).select("track_id", "batch_idx", "slot", "optimizer_step")


QUERIES, ORACLES = query.queries, query.oracles
