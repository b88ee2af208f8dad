"""Queries of whole jobs, token stores, keys and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import schedules as sc
from ..functions.hashing import sql_uint64
from ..functions.tokens import Vocabulary
from ..operators import catalogue, composites, evaluation, jobs, losses, quality, sampling, stores
from ..sources import files
from ..streaming.curriculum import curriculum_events
from . import decoding
from . import evaluation as ev
from . import views as v
from .registry import Registry

query = Registry()
S = v.SEED
VOCAB = Vocabulary(8)
_G = lambda x: f"format('{{:g}}', CAST({x} AS DOUBLE))"


# -- names

_RANGES = ((0.0, 2.5), (2.5, 7.25))


@query(f"""WITH {ev._RECIPES}, r AS (SELECT lo, hi, rir FROM (VALUES {', '.join(f'({a}::DOUBLE, {b}::DOUBLE)' for a, b in _RANGES)}) t(lo, hi), (VALUES (false), (true)) u(rir)),
 s AS (SELECT lo, hi, CASE WHEN rir THEN 'noise_rir' ELSE 'noise' END || '_' || {_G('lo')} || '_' || {_G('hi')} || 'db' AS suite_id FROM r)
 SELECT track_id || '__' || suite_id || '__' || {_G('q')} || 's' AS id, q AS query_seconds, round(lo + CAST({sql_uint64(str(S), 'track_id', "'paper-snr-range'", _G('lo'), _G('hi'))} AS DOUBLE) / pow(2.0, 64) * (hi - lo), 9) AS snr_db,
 regexp_replace(list_extract(string_split(path, '/'), -1), '(.)\\.[^.]*$', '\\1') AS reference_id FROM recipes, s, (VALUES (0.5::DOUBLE), (2.5::DOUBLE)) l(q)""")
def fractional_corpus(spark, sf):
    """SNR ranges and query lengths that are no whole numbers."""
    out = evaluation.query_corpus(ev._recipes(spark, sf)[0], evaluation.suites(spark, _RANGES), S, (0.5, 2.5))
    return out.select("id", "query_seconds", F.round("snr_db", 9).alias("snr_db"), P.reference_id(F.col("path")).alias("reference_id"))


_FORMS = ("'Deg' || n || '_x'", "'deg_' || n", "'angle-' || n || '_' || n || 'deg'", "'ANGLE' || n", "'ir' || n || '0' || n || 'deg.wav'", "'angle' || n || '1234'")


def _form(spark, sf):
    p = v.table(spark, sf, "part", "p_partkey", "p_size")
    n, lit = F.col("p_size").cast("string"), F.lit
    forms = [F.concat(lit("Deg"), n, lit("_x")), F.concat(lit("deg_"), n), F.concat(lit("angle-"), n, lit("_"), n, lit("deg")), F.concat(lit("ANGLE"), n), F.concat(lit("ir"), n, lit("0"), n, lit("deg.wav")), F.concat(lit("angle"), n, lit("1234"))]
    name = forms[-1]
    for k, f in enumerate(forms[:-1]):
        name = F.when(F.col("p_partkey") % 6 == k, f).otherwise(name)
    return p.select("p_partkey", name.alias("name"))


_FORM_SQL = "forms AS (SELECT p_partkey, CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(_FORMS)) + " END AS name FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) AS n FROM part))"


@query(f"""WITH {_FORM_SQL} SELECT p_partkey, name, CAST(nullif(regexp_extract(list_extract(regexp_extract_all(name, '(?:Deg|deg|angle[_-]?)[0-9]{{1,3}}|[0-9]{{1,3}}(?:Deg|deg)'), -1), '[0-9]+'), '') AS INTEGER) AS angle FROM forms""")
def angle_forms(spark, sf):
    return _form(spark, sf).select("p_partkey", "name", P.incident_angle(F.col("name")).alias("angle"))


_MICS = ("Rode", "RodeNT2A", "rode", "Mic_A", "mic")


@query(f"""WITH m AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'RodeNT2A/x.wav' WHEN 1 THEN 'mic/RODE_1.wav' WHEN 2 THEN 'Mic_A/rode_2.wav' WHEN 3 THEN 'a/MIC.wav' ELSE 'xmic/Rodex.wav' END AS path FROM part),
 f AS (SELECT *, list_extract(string_split(path, '/'), -1) AS file FROM m), k AS (SELECT unnest({list(_MICS)}) AS n, unnest(range({len(_MICS)})) AS o)
 SELECT p_partkey, path, coalesce((SELECT n FROM k WHERE starts_with(file, n) ORDER BY len(n) DESC, o LIMIT 1), (SELECT n FROM k WHERE contains(path, n) ORDER BY len(n) DESC, o LIMIT 1)) AS mic FROM f""")
def microphone_names(spark, sf):
    """Letters' case counts in microphones' names."""
    k = F.col("p_partkey") % 5
    path = F.when(k == 0, "RodeNT2A/x.wav").when(k == 1, "mic/RODE_1.wav").when(k == 2, "Mic_A/rode_2.wav").when(k == 3, "a/MIC.wav").otherwise("xmic/Rodex.wav")
    return v.table(spark, sf, "part", "p_partkey").select("p_partkey", path.alias("path")).withColumn("mic", P.microphone(F.col("path"), _MICS))


@query("""SELECT doc_id, CASE WHEN contains(lower(p), 'development') THEN 'train' WHEN contains(lower(p), 'evaluation') THEN 'test' END AS split FROM
 (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'TUT/Development/' WHEN 1 THEN 'TUT/x-evaluation/' ELSE 'TUT/other/' END || source AS p FROM documents)""")
def rule_split(spark, sf):
    d = v.table(spark, sf, "documents", "doc_id", "source")
    k = F.col("doc_id") % 3
    return d.select("doc_id", jobs.rule_split(F.concat(F.when(k == 0, "TUT/Development/").when(k == 1, "TUT/x-evaluation/").otherwise("TUT/other/"), "source")).alias("split"))


# -- corpus and catalogue jobs

_SOURCES = f"""{v.COPIES}, sources AS (SELECT digest, collection, relative, split, CASE WHEN collection = (SELECT min(source) FROM documents) THEN 'bg_noise' ELSE 'room_ir' END AS dataset FROM copies),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY split <> 'test', collection, relative) AS r FROM sources WHERE dataset <> 'bg_noise'),
 kept AS (SELECT digest, collection, relative, split, dataset FROM sources WHERE dataset = 'bg_noise' UNION ALL SELECT digest, collection, relative, split, dataset FROM ranked WHERE r = 1),
 done AS (SELECT *, CASE left(digest, 1) WHEN '0' THEN 'failed' WHEN '1' THEN 'existing' ELSE 'converted' END AS status FROM kept)"""


def _corpus_job(spark, sf):
    c = v.copies(spark, sf)
    first = v.table(spark, sf, "documents", "source").agg(F.min("source")).first()[0]
    sources = c.withColumn("dataset", F.when(F.col("collection") == first, "bg_noise").otherwise("room_ir"))
    expected = sources.groupBy("collection").agg((F.count(F.lit(1)) - (F.col("collection") > "r").cast("int")).alias("n"))
    h = F.substring("digest", 1, 1)
    return jobs.prepare_corpus(sources, expected, F.when(h == "0", "failed").when(h == "1", "existing").otherwise("converted"))


@query(f"""WITH {_SOURCES}, n AS (SELECT dataset, split, collection, count(*) AS n, count(*) FILTER (status = 'converted') AS c, count(*) FILTER (status = 'existing') AS e FROM done WHERE status <> 'failed' GROUP BY ALL),
 s AS (SELECT dataset, split, CAST(sum(n) AS BIGINT) AS files, CAST(sum(c) AS BIGINT) AS converted, CAST(sum(e) AS BIGINT) AS existing, string_agg(collection || '=' || n, ',' ORDER BY collection) AS collections FROM n GROUP BY ALL),
 b AS (SELECT dataset, split, count(*) AS failed FROM done WHERE status = 'failed' GROUP BY ALL)
 SELECT dataset, split, coalesce(files, 0) AS files, coalesce(converted, 0) AS converted, coalesce(existing, 0) AS existing, coalesce(failed, 0) AS failed, coalesce(collections, '') AS collections FROM s FULL JOIN b USING (dataset, split)""")
def corpus_job_summary(spark, sf):
    return _corpus_job(spark, sf)["summary"]


@query(f"WITH {_SOURCES} SELECT dataset, split, collection, relative, digest, status FROM done WHERE status <> 'failed'")
def corpus_job_manifest(spark, sf):
    return _corpus_job(spark, sf)["manifest"].select("dataset", "split", "collection", "relative", "digest", "status")


@query(f"WITH {_SOURCES}, f AS (SELECT collection, count(*) AS found FROM sources GROUP BY collection) SELECT collection, found, found - CAST(collection > 'r' AS INTEGER) AS expected FROM f WHERE collection > 'r'")
def corpus_job_mismatches(spark, sf):
    return _corpus_job(spark, sf)["mismatches"]


_CATALOGUE = f"""{v.PATHS}, listing AS (SELECT path, track_id, duration, CASE WHEN doc_id % 11 = 0 THEN 'unreadable' END AS error FROM paths),
 placed AS (SELECT *, row_number() OVER (ORDER BY {v.hash_order(f"'{S}'", 'path', "'catalogue'")}, path) - 1 AS place, error IS NULL AND duration >= 5.0 AS fine FROM listing),
 good AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY place) - 1 AS nth FROM placed WHERE fine) WHERE nth < 60)"""


def _catalogue_job(spark, sf):
    p = v.paths(spark, sf).select("path", "duration", F.when(F.col("doc_id") % 11 == 0, "unreadable").alias("error"))
    return catalogue.build_catalogue(p, S, 60)


@query(f"WITH {_CATALOGUE} SELECT path, track_id, duration, lpad(CAST(row_number() OVER (ORDER BY {v.hash_order(f"'{S}'", 'track_id', "'code'")}, track_id) - 1 AS VARCHAR), 5, '0') AS code FROM good")
def catalogue_job(spark, sf):
    """The first sixty readable files in hash order: a stated size."""
    return _catalogue_job(spark, sf)[0].select("path", "track_id", "duration", "code")


@query(f"WITH {_CATALOGUE} SELECT path, coalesce(error, 'too short') AS error FROM placed WHERE NOT fine AND place < (SELECT max(place) FROM good)")
def catalogue_job_rejects(spark, sf):
    return _catalogue_job(spark, sf)[1]


def _json(*pairs):
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {x}""" for k, x in pairs) + " || '}'"


_PATH = """'"' || path || '"'"""


@query(f"""WITH {v.PATHS}, f AS (SELECT path, doc_id * 7 AS bytes, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'training' END AS pool FROM paths)
 SELECT pool, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, sha256('[' || string_agg({_json(('bytes', 'CAST(bytes AS VARCHAR)'), ('path', _PATH))}, ',' ORDER BY path) || ']') AS fingerprint FROM f GROUP BY pool""")
def pool_manifests(spark, sf):
    f = v.paths(spark, sf).select("path", (F.col("doc_id") * 7).alias("bytes"), (F.col("doc_id") % 5 == 0).alias("held"))
    return jobs.pool_manifest(f.where(~F.col("held")), "training").unionByName(jobs.pool_manifest(f.where("held"), "validation"))


@query(f"""WITH {v.TRACKS} SELECT sha256('[' || string_agg({_json(('code', """'"' || code || '"'"""), ('path', _PATH), ('track_id', """'"' || track_id || '"'"""))}, ',' ORDER BY track_id) || ']') AS fingerprint FROM tracks WHERE code IS NOT NULL""")
def catalogue_fingerprint(spark, sf):
    return jobs.json_fingerprint(v.tracks(spark, sf).where("code is not null"), "track_id", ["track_id", "path", "code"])


_EVALUATION = f"""{v.TRACKS}, c AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {v.hash_order(f"'{S}'", 'track_id', "'cohort'")}, track_id) - 1 AS pos FROM tracks) WHERE pos < 100)"""


@query(f"WITH {_EVALUATION}, e AS (SELECT track_id, row_number() OVER (ORDER BY {v.hash_order("'5'", 'track_id', "'evaluation'")}, track_id) - 1 AS pos FROM c) SELECT track_id, pos FROM e WHERE pos < 20")
def checkpoint_cohort(spark, sf):
    """Twenty tracks of a cohort of a hundred: stated sizes."""
    return catalogue.select_cohort(catalogue.sample_cohort(v.tracks(spark, sf), S, 100), 100, sample_tracks=20, seed=5).select("track_id", "pos")


# -- recipes and keys

_POOLS = f"""{ev._RECIPES}, noise AS (SELECT CAST(p_partkey - 1 AS BIGINT) AS i, 'noise/' || p_partkey AS path, p_partkey * 40 AS samples, p_partkey % 53 = 7 AS valid FROM part),
 rooms AS (SELECT CAST(n_nationkey AS BIGINT) AS i, 'room/' || n_name AS path, n_nationkey = 3 AS valid FROM nation),
 nk AS (SELECT track_id, {sql_uint64("'validation-noise'", 'CAST(' + sql_uint64(str(S), 'track_id', "'paper-noise'") + ' AS VARCHAR)')} AS u FROM recipes),
 ns AS (SELECT track_id, u, CAST(CAST(u AS HUGEINT) % n AS BIGINT) AS start, n FROM nk, (SELECT count(*) AS n FROM noise)),
 nd AS (SELECT track_id, u, CAST((i - start + n) % n AS BIGINT) AS attempt, path AS noise_path, samples FROM (SELECT *, (SELECT coalesce(min(i) FILTER (i >= start), min(i)) FROM noise WHERE valid) AS i FROM ns) JOIN noise USING (i))"""


@query(f"""WITH {_POOLS} SELECT track_id, code, start_sample, noise_path, CAST({sql_uint64('u', 'attempt', "'offset'")} % CAST(greatest(samples - 200, 0) + 1 AS UBIGINT) AS BIGINT) AS noise_offset_samples, rooms.path AS rir_path, NULL::VARCHAR AS error
 FROM recipes JOIN nd USING (track_id), rooms WHERE rooms.valid""")
def degraded_recipes(spark, sf):
    """Query recipes with their held-out noise, its offset and their room, where few items of the pools are valid."""
    p, n = v.table(spark, sf, "part", "p_partkey"), v.table(spark, sf, "nation", "n_nationkey", "n_name")
    i, k = F.col("p_partkey"), F.col("n_nationkey")
    noise = p.select((i - 1).cast("long").alias("pool_idx"), F.concat(F.lit("noise/"), i.cast("string")).alias("path"), (i * 40).alias("samples"), (i % 53 == 7).alias("valid"))
    rooms = n.select(k.cast("long").alias("pool_idx"), F.concat(F.lit("room/"), "n_name").alias("path"), (k == 3).alias("valid"))
    return jobs.with_assets(ev._recipes(spark, sf)[0], noise, rooms, S, 200).select("track_id", "code", "start_sample", "noise_path", "noise_offset_samples", "rir_path", "error")


_PK = sql_uint64(str(S), "track_id", "'canonical'", "5", "'shifted'", "doc_id % 7")


@query(f"""WITH {v.PATHS}, p AS (SELECT doc_id, track_id, doc_id % 3 * 10000 AS optimizer_step, {_PK} AS pair_key FROM paths)
 SELECT doc_id, CAST(pair_key AS DECIMAL(20,0)) AS pair_key, CASE WHEN optimizer_step >= 10000 THEN CAST({sql_uint64(str(S), 'optimizer_step', '2', 'doc_id', 'pair_key', "'training-noise'")} AS DECIMAL(20,0)) END AS noise_key FROM p""")
def pair_keys(spark, sf):
    d = F.col("doc_id")
    pairs = v.paths(spark, sf).select("doc_id", "track_id", (d % 3 * 10_000).alias("optimizer_step"), F.lit(2).alias("batch_idx"), d.alias("pair"), F.lit("canonical").alias("anchor_view"), F.lit(5).alias("anchor_start"), F.lit("shifted").alias("other_view"), (d % 7).alias("other_start"))
    return jobs.pair_keys(pairs, S, 10_000).select("doc_id", "pair_key", "noise_key")


@query(f"WITH {v.PATHS} SELECT doc_id, CAST({sql_uint64(str(S), 'track_id', "'heldout'", 'doc_id % 5')} AS DECIMAL(20,0)) AS noise_key, CAST({sql_uint64("'train-noise'", sql_uint64('7', 'track_id'))} AS DECIMAL(20,0)) AS train_seed FROM paths")
def noise_keys(spark, sf):
    t = F.col("track_id")
    return v.paths(spark, sf).select("doc_id", jobs.position_key(S, t, F.lit("heldout"), F.col("doc_id") % 5).alias("noise_key"), composites.salted_seed("train-noise", F.lit(7), t).alias("train_seed"))


@query(f"""WITH {v.PATHS}, d AS (SELECT doc_id, {v.u64('3', '100', 'doc_id', 'track_id', "'apply'")} AS a, {v.u64('3', '100', 'doc_id', 'track_id', "'snr'")} AS s FROM paths)
 SELECT doc_id, CAST(a AS DOUBLE) / pow(2.0, 64) < 0.4 AS applied, round(5 + CAST(s AS DOUBLE) / pow(2.0, 64) * 15, 9) AS snr_db FROM d""")
def background_draws(spark, sf):
    on, snr = sampling.background_noise(F.lit(3), F.lit(100), F.col("doc_id"), F.col("track_id"), F.lit(0.4), F.lit(5.0), F.lit(20.0))
    return v.paths(spark, sf).select("doc_id", on.alias("applied"), F.round(snr, 9).alias("snr_db"))


_SLOTS = "slots AS (SELECT 7 AS optimizer_step, doc_id // 16 AS batch_idx, CAST(doc_id % 16 AS INTEGER) AS slot, doc_id % 13 AS index FROM documents WHERE doc_id IS NOT NULL)"
_HASH = sql_uint64(str(S), "optimizer_step", "batch_idx", "slot", "index", "'replacement'")


@query(f"""WITH RECURSIVE {_SLOTS}, c AS (SELECT *, list_concat([index], list_filter(list_transform(range(100), lambda k: CAST((CAST(u % 100 AS BIGINT) + k) % 100 AS BIGINT)), lambda x: x <> index)[1:8]) AS c FROM (SELECT *, {_HASH} AS u FROM slots)),
 g AS (SELECT *, list_filter(c, lambda x: x % 4 <> 1) AS fine, row_number() OVER (PARTITION BY batch_idx ORDER BY slot) - 1 AS k FROM c),
 r AS (SELECT batch_idx, -1::BIGINT AS k, [-1::BIGINT] AS used, NULL::BIGINT AS chosen, NULL::INTEGER AS slot, NULL::BIGINT AS index FROM (SELECT DISTINCT batch_idx FROM g)
  UNION ALL SELECT n.batch_idx, n.k, CASE WHEN n.x IS NULL THEN n.used ELSE list_append(n.used, n.x) END, n.x, n.slot, n.index FROM
   (SELECT g.batch_idx, g.k, r.used, g.slot, g.index, list_filter(g.fine, lambda y: NOT list_contains(r.used, y))[1] AS x FROM r JOIN g ON g.batch_idx = r.batch_idx AND g.k = r.k + 1) n)
 SELECT batch_idx, slot, index, chosen FROM r WHERE k >= 0""")
def identity_replacement(spark, sf):
    d = F.col("doc_id")
    rows = v.table(spark, sf, "documents", "doc_id").where("doc_id is not null").select(F.lit(7).cast("long").alias("optimizer_step"), F.floor(d / 16).alias("batch_idx"), (d % 16).cast("int").alias("slot"), (d % 13).alias("index"))
    return composites.replace_identities(rows, 100, {k for k in range(100) if k % 4 != 1}, S, retries=8).select("batch_idx", "slot", "index", "chosen")


# -- passes

_PASS = f"cohort AS (SELECT * FROM (SELECT track_id, row_number() OVER (ORDER BY {v.hash_order(f"'{S}'", 'track_id', "'cohort'")}, track_id) - 1 AS pos FROM tracks) WHERE pos < 50)"


@query(f"""WITH {v.TRACKS}, {_PASS}, o AS (SELECT track_id, r, row_number() OVER (PARTITION BY r ORDER BY {v.hash_order(f"CAST({S} + 2 * 3 + r AS VARCHAR)", 'track_id', "'pass'")}, track_id) - 1 AS place FROM cohort, range(3) t(r)),
 f AS (SELECT track_id, r, place FROM o UNION ALL SELECT track_id, r, place + 50 FROM o WHERE place < 14),
 b AS (SELECT track_id, place // 16 + r * 4 AS batch_idx, CAST(place % 16 AS INTEGER) AS slot, s AS segment FROM f, range(6) q(s) WHERE s // 2 = r),
 a AS (SELECT * FROM b UNION ALL SELECT track_id, 12 + k, slot, segment FROM b, range(3) e(k) WHERE batch_idx = k % 5)
 SELECT track_id, batch_idx, slot, segment FROM a WHERE slot BETWEEN 4 AND 7""")
def catalogue_pass(spark, sf):
    """Fifty tracks of six segments, two a batch: the part of the second of four workers."""
    some = catalogue.sample_cohort(v.tracks(spark, sf), S, 50).select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("segment"))
    return jobs.rank_slice(jobs.pass_batches(some, 50, 16, 2, 6, S, 2, 5), 16, 4, 1).select("track_id", "batch_idx", "slot", "segment")


@query(f"""WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY {sql_uint64(str(S), 'conv_id', "'canonical'", 'turn')}, turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
 SELECT conv_id AS track_id, max(turn) FILTER (p = 6 % n) AS anchor_start, max(turn) FILTER (p = 7 % n) AS other_start FROM s GROUP BY conv_id""")
def canonical_pairs(spark, sf):
    c = v.table(spark, sf, "conversations", "conv_id", "turn").select(F.col("conv_id").alias("track_id"), F.lit("canonical").alias("view"), F.col("turn").alias("start"))
    return catalogue.canonical_pairs(c, S, 3)


@query("WITH s AS (SELECT DISTINCT event_id * 37 % 240000 AS step FROM events) SELECT step, round(a + b, 9) AS noise, round(c + b, 9) AS room FROM (SELECT step, " + ", ".join(f"{sc.sql_piecewise('step', sc.FIXED_RUN, k)} AS {n}" for k, n in ((1, "a"), (2, "c"), (3, "b"))) + " FROM s)")
def schedule_probabilities(spark, sf):
    steps = v.table(spark, sf, "events", "event_id").select((F.col("event_id") * 37 % 240_000).alias("step")).distinct()
    at = lambda k: sc.piecewise(F.col("step"), sc.FIXED_RUN, k)
    return steps.select("step", F.round(sc.background_probability(at(1), at(3)), 9).alias("noise"), F.round(sc.room_probability(at(2), at(3)), 9).alias("room"))


_PROBES = "probes AS (SELECT event_type || '-' || (event_id // 200) AS run_id, event_id % 200 * 600 AS step, (event_id * 7919 % 1000) / 1000.0::DOUBLE AS exact, (event_id * 104729 % 1000) / 1000.0::DOUBLE AS top1, event_id % 3 <> 0 AS active FROM events)"


@query(f"""WITH RECURSIVE {_PROBES}, p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS k FROM probes),
 r AS (SELECT run_id, -1::BIGINT AS k, NULL::BIGINT AS step, 'gated' AS phase, 0::BIGINT AS lag, 0::BIGINT AS stopped, 0::BIGINT AS since, 0::BIGINT AS streak, 0.0::DOUBLE AS baseline, false AS recovered, NULL::VARCHAR AS reading FROM (SELECT DISTINCT run_id FROM p)
  UNION ALL SELECT run_id, k, step, CASE reading WHEN 'reached' THEN 'open' WHEN 'healed' THEN 'open' WHEN 'dropped' THEN 'recovering' ELSE phase END,
   CASE reading WHEN 'reached' THEN step - 20000 WHEN 'healed' THEN step - stopped ELSE lag END, CASE WHEN reading = 'dropped' THEN least(70000, greatest(least(step, 20000), step - lag)) ELSE stopped END, CASE WHEN reading = 'dropped' THEN step ELSE since END,
   CASE WHEN reading IN ('dropped', 'healed') THEN 0 WHEN reading IN ('not yet', 'overdue') THEN run ELSE streak END, CASE WHEN reading = 'reached' THEN top1 ELSE baseline END, recovered OR reading = 'dropped', reading FROM
   (SELECT *, CASE phase WHEN 'gated' THEN CASE WHEN step < 20000 THEN 'early' WHEN exact >= 0.9 THEN 'reached' WHEN step - 20000 >= 30000 THEN 'overdue' ELSE 'missed' END
     WHEN 'open' THEN CASE WHEN good OR NOT active THEN 'fine' WHEN recovered THEN 'dropped again' ELSE 'dropped' END
     ELSE CASE WHEN run >= 2 THEN 'healed' WHEN step - since >= 20000 THEN 'overdue' ELSE 'not yet' END END AS reading FROM
    (SELECT p.run_id, p.k, p.step, p.exact, p.top1, p.active, r.phase, r.lag, r.stopped, r.since, r.streak, r.baseline, r.recovered, p.top1 >= r.baseline - 0.3::DOUBLE AS good, CASE WHEN p.top1 >= r.baseline - 0.3::DOUBLE THEN r.streak + 1 ELSE 0 END AS run
     FROM r JOIN p ON p.run_id = r.run_id AND p.k = r.k + 1)))
 SELECT run_id, step AS global_step, CASE reading WHEN 'reached' THEN 'gate_opened' WHEN 'missed' THEN 'gate_waiting' WHEN 'dropped' THEN 'recovery_started' WHEN 'healed' THEN 'recovery_completed' WHEN 'not yet' THEN 'recovery_waiting' END AS event,
  reading IN ('overdue', 'dropped again') AS failed, CAST(CASE phase WHEN 'gated' THEN least(step, 20000) WHEN 'recovering' THEN stopped ELSE least(70000, greatest(least(step, 20000), step - lag)) END AS BIGINT) AS effective_step, CASE WHEN recovered THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM r WHERE k >= 0""")
def curriculum_trace(spark, sf):
    """The curriculum of runs of up to two hundred probes."""
    e = F.col("event_id")
    rows = v.table(spark, sf, "events", "event_id", "event_type").select(
        F.concat_ws("-", "event_type", F.floor(e / 200).cast("string")).alias("run_id"), (e % 200 * 600).alias("global_step"), (e * 7919 % 1000 / F.lit(1000.0)).alias("exact"), (e * 104729 % 1000 / F.lit(1000.0)).alias("top1"), (e % 3 != 0).alias("active"))
    out = curriculum_events(rows, threshold=0.9, drop=0.3)
    return out.select("run_id", "global_step", "event", F.col("failure").isNotNull().alias("failed"), "effective_step", "multiplier")


# -- token stores

_STORE = f"""{v.CODES}, {decoding._FLAT}, docs AS (SELECT wave_id * 3 + i AS document_index, 't' || (wave_id // 2) AS track_id, lpad(CAST(CASE WHEN wave_id % 31 = 0 THEN wave_id ELSE wave_id // 2 END % 100000 AS VARCHAR), 5, '0') AS code,
 CASE WHEN i = 2 THEN 'heldout_evaluation' ELSE 'canonical_training' END AS corpus_role, CASE WHEN i = 2 THEN 2.5::DOUBLE ELSE (wave_id % 2) * 10 + i * 5.0::DOUBLE END AS segment_start, tokens FROM flat, range(3) r(i) WHERE wave_id % 17 <> 0 OR i <> 1)"""
_CHOSEN = "chosen AS (SELECT DISTINCT track_id FROM docs WHERE right(track_id, 1) <> '3')"
_VIEWS = "v AS (SELECT d.*, CASE corpus_role WHEN 'heldout_evaluation' THEN 'heldout' ELSE 'canonical' END AS view_type, CAST(round(segment_start * 1000) AS BIGINT) AS start_key FROM docs d JOIN chosen USING (track_id))"


def _store(spark, sf):
    flat = decoding._flat(spark, sf).select("wave_id", "tokens").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("wave_id % 17 <> 0 or i <> 1")
    w, i = F.col("wave_id"), F.col("i")
    docs = flat.select(
        (w * 3 + i).alias("document_index"), F.concat(F.lit("t"), F.floor(w / 2).cast("string")).alias("track_id"), F.lpad((F.when(w % 31 == 0, w).otherwise(F.floor(w / 2)) % 100_000).cast("string"), 5, "0").alias("code"),
        F.when(i == 2, "heldout_evaluation").otherwise("canonical_training").alias("corpus_role"), F.when(i == 2, 2.5).otherwise((w % 2) * 10 + i * 5.0).alias("segment_start"), "tokens")
    tracks = docs.select("track_id").where("right(track_id, 1) <> '3'").distinct()
    return docs, tracks


def _views(spark, sf):
    docs, tracks = _store(spark, sf)
    return stores.views([docs.where("corpus_role = 'canonical_training'"), docs.where("corpus_role = 'heldout_evaluation'")], tracks), tracks


@query(f"WITH {_STORE}, {_CHOSEN} SELECT document_index, track_id FROM docs JOIN chosen USING (track_id)")
def selected_tracks(spark, sf):
    docs, tracks = _store(spark, sf)
    return stores.selected(docs, tracks).select("document_index", "track_id")


@query(f"""WITH {_STORE}, {_CHOSEN}, {_VIEWS}, w AS (SELECT track_id, view_type, start_key FROM chosen, (VALUES ('canonical', 0), ('canonical', 5000), ('heldout', 2500)) p(view_type, start_key)),
 l AS (SELECT track_id, view_type, start_key, max(document_index) AS document_index, arg_max(array_to_string(tokens, ' '), document_index) AS tokens FROM v GROUP BY ALL)
 SELECT track_id, view_type, CAST(start_key AS BIGINT) AS start_key, document_index, tokens FROM w LEFT JOIN l USING (track_id, view_type, start_key)""")
def cached_positions(spark, sf):
    rows, tracks = _views(spark, sf)
    positions = spark.createDataFrame([("canonical", 0.0), ("canonical", 5.0), ("heldout", 2.5)], "view_type string, start double")
    return stores.at_positions(rows, tracks, positions).select("track_id", "view_type", "start_key", "document_index", F.array_join("tokens", " ").alias("tokens"))


@query(f"""WITH {_STORE}, {_CHOSEN}, {_VIEWS}, e AS (SELECT track_id, view_type, grid FROM chosen, (VALUES ('canonical', [0, 5000, 10000, 15000]), ('heldout', [2500, 2500])) g(view_type, grid)),
 h AS (SELECT track_id, view_type, list(start_key ORDER BY start_key) AS starts FROM v GROUP BY ALL)
 SELECT track_id, 'starts of ' || view_type AS rule FROM e LEFT JOIN h USING (track_id, view_type) WHERE starts IS DISTINCT FROM grid UNION ALL SELECT track_id, 'codes' FROM v GROUP BY track_id HAVING count(DISTINCT code) > 1""")
def grid_violations(spark, sf):
    rows, tracks = _views(spark, sf)
    return stores.grid_violations(rows, tracks, {"canonical": [0.0, 5.0, 10.0, 15.0], "heldout": [2.5, 2.5]})


@query(f"""WITH {_STORE}, {_CHOSEN}, {_VIEWS}, c AS (SELECT track_id, start_key, tokens AS x FROM v WHERE view_type = 'canonical'), f AS (SELECT track_id, start_key, CASE WHEN document_index % 19 = 0 THEN tokens[1:3] ELSE tokens END AS y FROM v WHERE view_type = 'canonical' AND document_index % 23 <> 0)
 SELECT track_id, start_key FROM c FULL JOIN f USING (track_id, start_key) WHERE x IS DISTINCT FROM y""")
def token_equivalence(spark, sf):
    rows = _views(spark, sf)[0].where("view_type = 'canonical'")
    fresh = rows.where("document_index % 23 <> 0").withColumn("tokens", F.when(F.col("document_index") % 19 == 0, F.slice("tokens", 1, 3)).otherwise(F.col("tokens")))
    return stores.token_differences(rows, fresh)


@query(f"WITH {v.WAVES} SELECT wave_id FROM waves WHERE wave_id % 4 = 2 AND wave_id % 3 = 1")
def prefetched_waves(spark, sf):
    w = v.waves(spark, sf).select("wave_id", (F.col("wave_id") % 4).alias("planned_optimizer_step"), (F.col("wave_id") % 3).alias("planned_batch_idx"))
    return stores.prefetched(w, 2, 1).select("wave_id")


@query(f"""WITH {_STORE} SELECT document_index, array_to_string(tokens[2:4], ' ') AS span FROM docs WHERE corpus_role = 'canonical_training' AND document_index % 13 <> 0""")
def token_store_round_trip(spark, sf):
    """Written by shard with its fingerprint, checked, and read again."""
    docs = _store(spark, sf)[0].where("corpus_role = 'canonical_training'")
    bad = F.col("document_index") % 13 == 0
    rows = docs.select("document_index", "track_id", "code", F.when(bad, "failed").otherwise("ok").alias("status"), F.lit(0).cast("long").alias("token_offset"), F.size("tokens").alias("token_count"), F.when(bad, "bad").alias("error"), "corpus_role", "tokens", (F.col("document_index") % 4).cast("int").alias("shard_id"))
    path = files.work_folder(spark, "tokens")
    files.write_token_store(rows, path, VOCAB.total, "canonical_training", "f1")
    return files.read_token_store(spark, path, VOCAB.total, "canonical_training", "f1").select("document_index", F.array_join(files.span(F.col("tokens"), F.lit(1), F.lit(3)), " ").alias("span"))


# -- files

@query(f"WITH {v.TRACKS} SELECT path, track_id, code, duration FROM tracks WHERE code IS NOT NULL")
def catalogue_round_trip(spark, sf):
    """A catalogue as JSON lines, written and read with its checks."""
    path = files.work_folder(spark, "catalogue")
    files.write_jsonl(v.tracks(spark, sf).where("code is not null").select("path", "track_id", "code", "duration"), path)
    return files.read_catalogue(spark, path)


@query(f"""WITH {v.RANKS} SELECT CAST(query_id AS VARCHAR) AS track_id, suite_id || '-' || line || '-' || written AS suite_id, CAST(snr AS DOUBLE) AS query_seconds, rank AS correct_rank, 'f' AS protocol_fingerprint FROM ranks""")
def resume_log_round_trip(spark, sf):
    """Results appended in two parts as JSON lines, and read again as the log that a run resumes from."""
    r = v.ranks(spark, sf).select(
        F.lit("f").alias("protocol_fingerprint"), F.lit("ok").alias("status"), F.col("query_id").cast("string").alias("track_id"), F.concat_ws("-", "suite_id", F.col("line").cast("string"), F.col("written").cast("string")).alias("suite_id"), F.col("snr").cast("double").alias("query_seconds"), F.col("rank").cast("int").alias("correct_rank"))
    path = files.work_folder(spark, "results")
    files.append_results(r.where("correct_rank is null"), path)
    files.append_results(r.where("correct_rank is not null"), path)
    return files.read_results(spark, path, "f").select("track_id", "suite_id", "query_seconds", "correct_rank", "protocol_fingerprint")


@query(f"""WITH {v.WAVES} SELECT 'w' || wave_id || '.wav' AS name, 8000 AS rate, array_to_string(list_transform(samples, lambda q: CAST(CAST(round_even(greatest(-1.0, least(1.0, q)) * 32767, 0) AS BIGINT) AS VARCHAR)), ' ') AS pcm FROM waves""")
def wav_round_trip(spark, sf):
    """All waveforms written as WAV files below the shared folder and decoded."""
    folder = files.work_folder(spark, "wav")
    w = v.waves(spark, sf).select(F.concat(F.lit("w"), F.col("wave_id").cast("string"), F.lit(".wav")).alias("name"), F.transform("samples", lambda q: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q))).alias("samples"))
    files.convert_files(w, folder, 8000).write.format("noop").mode("overwrite").save()
    got = files.decode_wavs(files.audio_files(spark, folder, content=True))
    return got.select(P.basename(F.col("path")).alias("name"), "rate", F.array_join(F.transform("samples", lambda q: F.round(q * 32767).cast("long").cast("string")), " ").alias("pcm"))


@query(f"WITH {v.ASSETS}, k AS (SELECT path, 'old' AS error FROM assets WHERE p_partkey % 9 = 0 UNION ALL SELECT path, 'new' FROM assets WHERE p_partkey % 6 = 0 AND p_partkey % 9 <> 0 GROUP BY path) SELECT p_partkey, path FROM assets WHERE path NOT IN (SELECT path FROM k)")
def rejects_left_out(spark, sf):
    a = v.assets(spark, sf).select("p_partkey", "path")
    tag = lambda df, e: df.select("path", F.lit(e).alias("error"))
    known = files.add_rejects(tag(a.where("p_partkey % 9 = 0"), "old"), tag(a.where("p_partkey % 6 = 0"), "new"))
    return files.without_rejects(a, known)


# -- checks and composites

@query(f"""WITH {v.TRACKS}, q AS (SELECT track_id, CASE WHEN doc_id % 9 = 0 THEN 'xxxxx' ELSE code END AS code, doc_id FROM tracks WHERE doc_id % 4 = 0 UNION ALL SELECT track_id, code, doc_id FROM tracks WHERE doc_id % 20 = 0), c AS (SELECT track_id, code FROM tracks WHERE doc_id % 12 <> 0), x AS (SELECT track_id FROM tracks WHERE doc_id % 7 = 0)
 SELECT track_id, 'repeated' AS rule FROM q GROUP BY track_id HAVING count(*) > 1 UNION ALL SELECT track_id, 'unknown' FROM q WHERE track_id NOT IN (SELECT track_id FROM c)
 UNION ALL SELECT q.track_id, 'code' FROM q JOIN c USING (track_id) WHERE q.code IS DISTINCT FROM c.code UNION ALL SELECT track_id, 'excluded' FROM q WHERE track_id IN (SELECT track_id FROM x)""")
def prescribed_violations(spark, sf):
    t = v.tracks(spark, sf).select("doc_id", "track_id", "code")
    d = F.col("doc_id")
    q = t.where(d % 4 == 0).withColumn("code", F.when(d % 9 == 0, "xxxxx").otherwise(F.col("code"))).unionByName(t.where(d % 20 == 0))
    return quality.prescribed_violations(q, t.where(d % 12 != 0), t.where(d % 7 == 0))


@query(f"""WITH {v.RANKS} SELECT condition, avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END) AS mean, count(*) AS n FROM ranks WHERE query_id IN (SELECT query_id FROM ranks GROUP BY query_id HAVING count(DISTINCT condition) = (SELECT count(DISTINCT condition) FROM ranks)) GROUP BY condition""")
def paired_diagnostic(spark, sf):
    r = v.ranks(spark, sf).select(F.col("query_id").alias("track_id"), "condition", F.coalesce(F.col("rank") == 1, F.lit(False)).alias("hit"))
    return composites.paired_means(r, "condition", "hit")


@query(f"""WITH {v.WAVES}, r AS (SELECT wave_id // 2 AS pair_id, wave_id % 2 AS role, wave_id, 'k' || (wave_id // 2) AS track_id FROM waves) SELECT a.pair_id, a.track_id, a.wave_id AS anchor, b.wave_id AS secondary FROM r a JOIN r b ON a.pair_id = b.pair_id AND a.role = 0 AND b.role = 1""")
def paired_rows(spark, sf):
    w = F.col("wave_id")
    rows = v.waves(spark, sf).select(F.floor(w / 2).alias("pair_id"), F.when(w % 2 == 0, "anchor").otherwise("secondary").alias("role"), "wave_id", F.concat(F.lit("k"), F.floor(w / 2).cast("string")).alias("track_id"))
    return losses.pair_rows(rows).select("pair_id", "track_id", F.col("anchor.wave_id").alias("anchor"), F.col("secondary.wave_id").alias("secondary"))


@query(f"WITH {v.CODES}, {decoding._FLAT} SELECT count(*) FILTER (wave_id % 8 <> 0) AS ok, count(*) FILTER (wave_id % 8 = 0) AS failed, CAST(sum(len(tokens)) FILTER (wave_id % 8 <> 0) AS BIGINT) AS tokens, count(*) = 7 AS complete FROM flat")
def token_report(spark, sf):
    bad = F.col("wave_id") % 8 == 0
    rows = decoding._flat(spark, sf).select(F.when(~bad, F.col("tokens")).alias("tokens"), F.when(bad, "bad").alias("error"))
    return composites.token_report(rows, 7)


@query(f"WITH {v.CODES}, {decoding._FLAT}, d AS (SELECT wave_id, list_concat([8192], tokens, [8193], {decoding._DIGITS}, [8204]) AS ids, list_transform(tokens, lambda t: CAST((t + 1) % 1024 AS INTEGER)) AS noisy FROM flat) SELECT wave_id, array_to_string(list_concat(ids[1:1], noisy, ids[len(noisy) + 2:]), ' ') AS ids FROM d")
def noisy_documents(spark, sf):
    code = F.lpad((F.col("wave_id") % 100_000).cast("string"), 5, "0")
    rows = decoding._flat(spark, sf).select("wave_id", VOCAB.document(F.col("tokens"), code).alias("ids"), F.transform("tokens", lambda t: (t + 1) % 1024).alias("noisy"))
    return rows.select("wave_id", F.array_join(VOCAB.replace_audio(F.col("ids"), F.col("noisy")), " ").alias("ids"))


@query(f"WITH {v.PATHS} SELECT doc_id, doc_id % 40 / 4.0::DOUBLE AS start, abs(doc_id % 40 / 4.0 / 2.5 - round_even(doc_id % 40 / 4.0 / 2.5, 0)) < 1e-9 AS canonical FROM paths")
def canonical_starts(spark, sf):
    s = F.col("doc_id") % 40 / 4.0
    return v.paths(spark, sf).select("doc_id", s.alias("start"), quality.on_grid(s, F.lit(2.5)).alias("canonical"))


@query(f"WITH {_EVALUATION}, n AS (SELECT count(*) AS n, count(DISTINCT track_id) AS d FROM (SELECT track_id FROM c UNION ALL SELECT track_id FROM c WHERE pos < 3)) SELECT 'count' AS rule FROM n WHERE n <> 100 UNION ALL SELECT 'repeated' FROM n WHERE n <> d")
def cohort_rules(spark, sf):
    c = catalogue.sample_cohort(v.tracks(spark, sf), S, 100)
    return catalogue.cohort_violations(c.unionByName(c.where("pos < 3")), 100)


@query(f"WITH {_STORE} SELECT DISTINCT corpus_role FROM docs")
def several_roles(spark, sf):
    return quality.one_value(_store(spark, sf)[0], "corpus_role")


_TRY = lambda a: f"CAST({v.u64(str(S), 'track_id', "'anchor'", str(a), "'crop-start'")} % CAST(greatest(most, 0) + 1 AS UBIGINT) AS BIGINT)"


@query(f"""WITH {v.PATHS}, m AS (SELECT track_id, CAST(floor(duration * 10) AS BIGINT) AS most FROM paths), t AS (SELECT track_id, most, [{', '.join(f"CASE WHEN most <= 0 THEN 0 ELSE {_TRY(a)} END" for a in range(4))}] AS s FROM m),
 k AS (SELECT track_id, s, list_filter(range(1, 5), lambda a: s[a] % 3 = 0)[1] AS a FROM t) SELECT track_id, s[a] AS start, CAST(a - 1 AS INTEGER) AS attempt FROM k""")
def crop_retries(spark, sf):
    most = F.floor(F.col("duration") * 10).cast("long")
    return composites.crop_with_retry(v.paths(spark, sf), [F.lit(S)], F.col("track_id"), "anchor", most, lambda s: s % 3 == 0).select("track_id", "start", "attempt")


@query(f"""WITH {v.PATHS}, m AS (SELECT track_id, c AS condition, snr AS snr_db FROM paths, (VALUES ('clean', NULL::DOUBLE), ('rir', NULL), ('noise', 0), ('noise', 5), ('noise_rir', 0), ('noise_rir', 5)) t(c, snr)) SELECT * FROM m""")
def monitor_conditions(spark, sf):
    return composites.conditions_by_manifest(v.paths(spark, sf).select("track_id"), [0.0, 5.0])


@query(f"""WITH {v.WAVES}, c AS (SELECT wave_id, samples AS x, [1.0::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE, 0.125::DOUBLE] AS h FROM waves), d AS (SELECT wave_id, list_transform(range(1, 65), lambda n: list_sum(list_transform(range(1, least(n, 4) + 1), lambda k: h[k] * x[n - k + 1]))) AS y FROM c)
 SELECT wave_id, array_to_string(list_transform(list_transform(y[9:64], lambda q: q / list_max(list_transform(y, lambda w: abs(w)))), lambda q: CAST(CAST(round(q * 1000000) AS BIGINT) AS VARCHAR)), ' ') AS wave FROM d""")
def suite_waveforms(spark, sf):
    """Queries in a room, with silent noise: the response over past and query, scaled by the whole context's peak."""
    h = F.array(*(F.lit(x) for x in (1.0, 0.5, 0.25, 0.125)))
    wave = composites.suite_waveform(F.col("samples"), F.lit(8), F.array(F.lit(0.0)), h, F.lit(5.0), F.lit(True))
    return v.waves(spark, sf).select("wave_id", F.array_join(F.transform(wave, lambda q: F.round(q * 1_000_000).cast("long").cast("string")), " ").alias("wave"))


# -- evaluation

def _identified(width: int) -> str:
    one = f"({decoding._beam_sql(decoding._ONE, 1)} SELECT query_id, prefix AS greedy FROM b5)"
    many = f"({decoding._beam_sql(decoding._ONE, width)} SELECT query_id, list(prefix ORDER BY rank) AS beam FROM b5 GROUP BY query_id)"
    return f"found AS (SELECT query_id, greedy, beam FROM {one} JOIN {many} USING (query_id))"


_TOLD = "told AS (SELECT *, CASE query_id % 3 WHEN 0 THEN greedy WHEN 1 THEN beam[3] ELSE '00000' END AS code, CASE WHEN query_id % 2 = 0 THEN 'canonical' ELSE 'heldout' END AS view_type, CAST(query_id % 4 * 2500 AS BIGINT) AS start_key FROM found), r AS (SELECT *, nullif(coalesce(list_position(beam, code), 0), 0) AS rank FROM told)"
_GENERATION = "count(*) AS queries, avg(CASE WHEN greedy = code THEN 1.0::DOUBLE ELSE 0 END) AS greedy_top1, 0.0::DOUBLE AS invalid_code_rate, avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS top1, avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS top5, avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS top10, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr"


def _true_codes(spark, sf):
    """Queries with true codes that are the greedy one, third in the beam, or absent: stored, so that no stage holds two searches and none is made again."""
    q = v.table(spark, sf, "embeddings", "vec_id").select(F.col("vec_id").alias("query_id"))
    found = composites.identify(q.withColumn("window_id", F.lit(0)), decoding.SCORER, 5)
    i = F.col("query_id")
    code = F.when(i % 3 == 0, F.col("greedy")).when(i % 3 == 1, F.element_at("beam", 3)).otherwise("00000")
    told = found.select("query_id", code.alias("code"), F.when(i % 2 == 0, "canonical").otherwise("heldout").alias("view_type"), (i % 4 * 2500).alias("start_key"))
    path = files.work_folder(spark, "true-codes")
    told.write.parquet(path)
    return spark.read.schema(told.schema).parquet(path)


@query(f"WITH {_identified(5)}, {_TOLD} SELECT view_type, start_key, {_GENERATION} FROM r GROUP BY GROUPING SETS ((view_type), (view_type, start_key))")
def position_metrics(spark, sf):
    _, out = jobs.evaluate_positions(_true_codes(spark, sf), decoding.SCORER, 5)
    return out.withColumn("mrr", F.round("mrr", 9))


@query(f"""WITH {v.WAVES}, {decoding._LOGITS}, {decoding._TOK}, {_identified(5)}, {_TOLD}, u AS (SELECT *, query_id // 4 AS track FROM r WHERE query_id % 16 <> 5 AND query_id // 4 % 9 <> 0),
 f AS (SELECT wave_id, sum(loss * w) / sum(w) AS loss, avg(loss) FILTER (family = 'audio') AS audio_loss, avg(loss) FILTER (family = 'digits') AS digit_loss, avg(loss) FILTER (family = 'boundary') AS boundary_loss, avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END) FILTER (family = 'digits') AS digit_accuracy, min(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END) FILTER (family = 'digits') AS exact
  FROM (SELECT *, CASE WHEN family = 'digits' THEN 32.0::DOUBLE ELSE 1 END AS w FROM tok) WHERE wave_id IN (SELECT query_id FROM u) GROUP BY wave_id),
 m AS (SELECT round(avg(loss), 9) AS loss, round(avg(audio_loss), 9) AS audio_loss, round(avg(digit_loss), 9) AS digit_loss, round(avg(boundary_loss), 9) AS boundary_loss, round(avg(digit_accuracy), 9) AS digit_accuracy, round(avg(exact), 9) AS exact_accuracy, round(exp(least(20.0, avg(audio_loss))), 6) AS audio_perplexity FROM f),
 g AS (SELECT {_GENERATION}, count(DISTINCT track) AS evaluated_tracks, round(avg((query_id % 7) / 10.0::DOUBLE), 9) AS mean_latency_seconds FROM u), s AS (SELECT count(DISTINCT query_id // 4) AS selected_tracks FROM r)
 SELECT g.*, s.selected_tracks, s.selected_tracks - g.evaluated_tracks AS skipped_tracks, m.* FROM g, s, m""")
def segment_metrics(spark, sf):
    """Evaluation by track and position with rejected files, generation and teacher-forced losses."""
    i = F.col("query_id")
    queries = _true_codes(spark, sf).select("query_id", "code", F.floor(i / 4).alias("track_id"), F.concat(F.lit("p"), i.cast("string")).alias("path"), (i % 7 / F.lit(10.0)).alias("seconds"))
    rejects = queries.where((i % 16 == 5) | (F.floor(i / 4) % 9 == 0)).select("path")
    tokens = decoding._logits(spark, sf).select(F.col("wave_id").alias("query_id"), "loss", "family", "correct")
    out = jobs.evaluate_segments(queries, tokens, rejects, decoding.SCORER, 5, 32.0)
    return out.withColumns({c: F.round(c, 6 if c == "audio_perplexity" else 9) for c in ("mrr", "mean_latency_seconds", "loss", "audio_loss", "digit_loss", "boundary_loss", "digit_accuracy", "exact_accuracy", "audio_perplexity")})


@query(f"""WITH {_identified(5)}, {_TOLD}, m AS (SELECT *, CASE WHEN query_id % 4 = 0 THEN 'clean' ELSE 'noise' END AS condition, CASE WHEN query_id % 4 <> 0 THEN query_id % 3 * 5.0::DOUBLE END AS snr_db FROM r)
 SELECT 'condition' AS level, condition, NULL::DOUBLE AS snr_db, {_GENERATION} FROM m GROUP BY condition UNION ALL SELECT 'snr', condition, snr_db, {_GENERATION} FROM m GROUP BY condition, snr_db""")
def monitor_probe(spark, sf):
    i = F.col("query_id")
    rows = _true_codes(spark, sf).select("query_id", "code", F.when(i % 4 == 0, "clean").otherwise("noise").alias("condition"), F.when(i % 4 != 0, i % 3 * F.lit(5.0)).alias("snr_db"))
    return jobs.monitor_probe(rows, decoding.SCORER, 5).withColumn("mrr", F.round("mrr", 9))


@query(f"""WITH {v.EXTERNAL} SELECT sha256('[' || string_agg('"' || source_id || '"', ',' ORDER BY source_id) || ']') AS fingerprint FROM (SELECT DISTINCT source_id FROM external WHERE source_id IS NOT NULL)""")
def exclusion_fingerprint(spark, sf):
    return jobs.ids_fingerprint(evaluation.exclusion(v.external(spark, sf), "source_id")[0], "source_id")


@query(f"WITH {ev._RECIPES}, q AS (SELECT track_id, 2.0::DOUBLE AS query_seconds, 's' || (query_pos % 3) AS suite_id, code FROM recipes), r AS (SELECT track_id, 2.0::DOUBLE AS query_seconds, 's1' AS suite_id, query_pos AS rank FROM recipes) SELECT track_id, suite_id, rank, code FROM r JOIN q USING (track_id, suite_id, query_seconds)")
def corpus_lookup(spark, sf):
    r = ev._recipes(spark, sf)[0]
    corpus = r.select("track_id", F.lit(2.0).alias("query_seconds"), F.concat(F.lit("s"), (F.col("query_pos") % 3).cast("string")).alias("suite_id"), "code")
    results = r.select("track_id", F.lit(2.0).alias("query_seconds"), F.lit("s1").alias("suite_id"), F.col("query_pos").alias("rank"))
    return stores.corpus_lookup(results, corpus).select("track_id", "suite_id", "rank", "code")


QUERIES, ORACLES = query.queries, query.oracles
