"""Queries over waveforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import signals as sg
from ..functions.tokens import residual_codes
from ..operators import sampling
from . import views as v
from .registry import Registry

query = Registry()

_RMS = lambda x: f"sqrt(list_sum(list_transform({x}, lambda q: q * q)) / len({x}))"
_TEXT = lambda x: f"array_to_string(list_transform({x}, lambda q: CAST(CAST(round(q * 1000000) AS BIGINT) AS VARCHAR)), ' ')"


def _text(x):
    """An array as text of whole millionths: both engines print integers alike."""
    return F.array_join(F.transform(x, lambda q: F.round(q * 1_000_000).cast("long").cast("string")), " ")


@query(f"WITH {v.WAVES} SELECT wave_id, round({_RMS('samples')}, 9) AS rms, round(list_max(list_transform(samples, lambda x: abs(x))), 9) AS peak FROM waves")
def rms(spark, sf):
    x = F.col("samples")
    return v.waves(spark, sf).select("wave_id", F.round(sg.rms(x), 9).alias("rms"), F.round(sg.peak(x), 9).alias("peak"))


_MIX = f"""p AS (SELECT a.wave_id, a.samples AS s, b.samples AS n FROM waves a JOIN waves b ON b.wave_id = a.wave_id + 1),
 m AS (SELECT wave_id, s, n, {_RMS('s')} / (greatest({_RMS('n')}, 1e-8) * pow(10.0, 5 / 20.0)) AS k FROM p),
 x AS (SELECT wave_id, s, list_transform(range(1, 65), lambda i: s[i] + n[i] * k) AS y FROM m),
 z AS (SELECT wave_id, s, list_transform(y, lambda q: q * least(1.0, 0.999 / greatest(list_max(list_transform(y, lambda w: abs(w))), 1e-8))) AS y FROM x)"""


def _pairs(spark, sf):
    w = v.waves(spark, sf).select("wave_id", "samples")
    return w.join(w.select((F.col("wave_id") - 1).alias("wave_id"), F.col("samples").alias("noise")), "wave_id")


@query(f"WITH {v.WAVES}, {_MIX} SELECT wave_id, {_TEXT('y')} AS mixed FROM z")
def snr_mix(spark, sf):
    return _pairs(spark, sf).select("wave_id", _text(sg.mix(F.col("samples"), F.col("noise"), F.lit(5.0))).alias("mixed"))


_CONV = "list_transform(range(1, 65), lambda n: list_sum(list_transform(range(1, least(n, 4) + 1), lambda k: h[k] * x[n - k + 1])))"


@query(f"WITH {v.WAVES}, c AS (SELECT wave_id, samples AS x, [1.0::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE, 0.125::DOUBLE] AS h FROM waves) SELECT wave_id, {_TEXT(_CONV)} AS wet FROM c")
def convolve_direct(spark, sf):
    h = F.array(*(F.lit(x) for x in (1.0, 0.5, 0.25, 0.125)))
    return v.waves(spark, sf).select("wave_id", _text(sg.convolve_direct(F.col("samples"), h)).alias("wet"))


@query(f"WITH {v.WAVES}, c AS (SELECT wave_id, samples AS x, [1.0::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE, 0.125::DOUBLE] AS h FROM waves) SELECT wave_id, {_TEXT(_CONV)} AS wet FROM c")
def convolve_fft(spark, sf):
    h = F.array(*(F.lit(x) for x in (1.0, 0.5, 0.25, 0.125)))
    return v.waves(spark, sf).select("wave_id", _text(sg.convolve_fft(F.col("samples"), h)).alias("wet"))


_WET = f"c AS (SELECT wave_id, samples AS x, [1.0::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE, 0.125::DOUBLE] AS h FROM waves), d AS (SELECT wave_id, {_CONV} AS y FROM c)"


@query(f"WITH {v.WAVES}, {_WET} SELECT wave_id, {_TEXT('list_transform(y[25:64], lambda q: q / list_max(list_transform(y, lambda w: abs(w))))')} AS wet FROM d")
def full_wet(spark, sf):
    h = F.array(*(F.lit(x) for x in (1.0, 0.5, 0.25, 0.125)))
    return v.waves(spark, sf).select("wave_id", _text(sg.full_wet(F.col("samples"), h, F.lit(24))).alias("wet"))


_SEV = """e AS (SELECT wave_id, room, samples[list_position(list_transform(samples, lambda x: abs(x)), list_max(list_transform(samples, lambda x: abs(x)))):64] AS t FROM waves),
 f AS (SELECT wave_id, room, list_transform(t, lambda x: x * x) AS q FROM e),
 sev AS (SELECT wave_id, room, len(list_filter(range(1, len(q) + 1), lambda i: list_sum(q[1:i]) < 0.99::DOUBLE * list_sum(q))) / CAST(CASE WHEN room % 2 = 0 THEN 8000 ELSE 16000 END AS DOUBLE) AS score FROM f)"""


def _rate():
    """Recordings of two rates: severity counts in seconds."""
    return F.when(F.col("room") % 2 == 0, 8000).otherwise(16_000)


@query(f"WITH {v.WAVES}, {_SEV} SELECT wave_id, score FROM sev")
def severity(spark, sf):
    return v.waves(spark, sf).select("wave_id", sg.severity(F.col("samples"), _rate()).alias("score"))


@query(f"""WITH {v.WAVES}, {_SEV} SELECT wave_id, room, score FROM (SELECT *, row_number() OVER (PARTITION BY room ORDER BY score, wave_id) AS r, count(*) OVER (PARTITION BY room) AS n FROM sev) WHERE r <= greatest(1, ceil(n / 3.0::DOUBLE))""")
def severity_prefix(spark, sf):
    """The mildest third of each room's responses."""
    from pyspark.sql import Window

    rows = v.waves(spark, sf).select("wave_id", "room", sg.severity(F.col("samples"), _rate()).alias("score"))
    n = F.count(F.lit(1)).over(Window.partitionBy("room"))
    r = F.row_number().over(Window.partitionBy("room").orderBy("score", "wave_id"))
    return rows.withColumns({"r": r, "n": n}).where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") / 3.0))).select("wave_id", "room", "score")


@query(f"""WITH {v.WAVES}, o AS (SELECT wave_id, samples, list_sort(list_transform(samples, lambda x: abs(x))) AS a FROM waves)
 SELECT wave_id, {_TEXT('list_transform(samples, lambda q: q / greatest(a[60] + (a[61] - a[60]) * (63 * 0.95::DOUBLE - 59), 1e-8))')} AS x FROM o""")
def quantile_norm(spark, sf):
    return v.waves(spark, sf).select("wave_id", _text(sg.quantile_normalize(F.col("samples"))).alias("x"))


@query(f"""WITH {v.WAVES} SELECT wave_id, CASE WHEN wave_id % 7 = 0 THEN 'length' WHEN wave_id % 11 = 0 THEN 'silent' END AS reason FROM waves""")
def waveform_check(spark, sf):
    i = F.col("wave_id")
    x = F.when(i % 7 == 0, F.slice("samples", 1, 60)).when(i % 11 == 0, F.array_repeat(F.lit(0.0), 64)).otherwise(F.col("samples"))
    return v.waves(spark, sf).select("wave_id", sg.invalid_reason(x, F.lit(64)).alias("reason"))


@query(f"""WITH {v.WAVES} SELECT wave_id, {_TEXT("list_concat(list_transform(range(CAST(20 - least(wave_id % 40, 20) AS BIGINT)), lambda i: 0.0::DOUBLE), samples[CAST(wave_id % 40 - least(wave_id % 40, 20) + 1 AS BIGINT):CAST(wave_id % 40 + 16 AS BIGINT)])")} AS x FROM waves""")
def with_context(spark, sf):
    return v.waves(spark, sf).select("wave_id", _text(sg.with_context(F.col("samples"), (F.col("wave_id") % 40).cast("int"), F.lit(20), F.lit(16))).alias("x"))


@query(f"WITH {v.WAVES} SELECT wave_id, {_TEXT('samples[1:16]')} AS head, {_TEXT('list_concat(samples, samples, samples)[1:150]')} AS tiled, {_TEXT('samples[9:28]')} AS cut FROM waves")
def slices(spark, sf):
    x = F.col("samples")
    return v.waves(spark, sf).select("wave_id", _text(sg.prefix(x, F.lit(16))).alias("head"), _text(sg.tile(x, F.lit(150))).alias("tiled"), _text(sg.load_slice(x, F.lit(8), F.lit(1.0), F.lit(2.5))).alias("cut"))


@query(f"WITH {v.WAVES} SELECT wave_id, {_TEXT('list_transform(range(1, 33), lambda i: (samples[i] + samples[i + 32]) / 2)')} AS mono, greatest(0, 48 - greatest(0, least(48, 64 - CAST(wave_id % 80 AS INTEGER)))) AS padded FROM waves")
def channels_and_padding(spark, sf):
    x = F.col("samples")
    two = F.array(F.slice(x, 1, 32), F.slice(x, 33, 32))
    return v.waves(spark, sf).select("wave_id", _text(sg.channel_mean(two)).alias("mono"), sg.padded_samples(F.lit(64), (F.col("wave_id") % 80).cast("int"), F.lit(48)).alias("padded"))


_STARTS = "CASE WHEN wave_id % 200 < 16 THEN [] ELSE list_sort(list_distinct(list_concat(range(0, wave_id % 200 - 15, 12), [wave_id % 200 - 16]))) END"


@query(f"WITH {v.WAVES} SELECT wave_id, array_to_string({_STARTS}, ' ') AS starts FROM waves")
def sliding_windows(spark, sf):
    q = F.col("wave_id") % 200
    return v.waves(spark, sf).select("wave_id", F.array_join(sg.window_starts(q, F.lit(16), F.lit(12)), " ").alias("starts"))


@query(f"WITH {v.WAVES}, s AS (SELECT wave_id, samples, unnest([0, 12, 24, 36, 48]) AS start FROM waves) SELECT wave_id, CAST(start AS BIGINT) AS start, round({_RMS('samples[start + 1:start + 16]')}, 9) AS rms FROM s")
def window_extract(spark, sf):
    rows = v.waves(spark, sf).withColumn("start", F.explode(sg.window_starts(F.lit(64), F.lit(16), F.lit(12))))
    return rows.select("wave_id", "start", F.round(sg.rms(F.slice("samples", (F.col("start") + 1).cast("int"), 16)), 9).alias("rms"))


@query(f"""WITH {v.WAVES}, {_SEV}, a AS (SELECT wave_id, score + (wave_id % 10) / 100000.0::DOUBLE AS score FROM sev WHERE wave_id % 5 = 0), b AS (SELECT wave_id AS ir, score FROM sev WHERE wave_id % 5 <> 0),
 c AS (SELECT a.wave_id, b.ir, b.score, row_number() OVER (PARTITION BY a.wave_id ORDER BY abs(a.score - b.score), {v.u64('9', 'a.wave_id', 'b.ir')}, b.ir) AS r FROM a, b) SELECT wave_id, ir, score AS matched FROM c WHERE r = 1""")
def nearest_severity(spark, sf):
    rows = v.waves(spark, sf).select("wave_id", sg.severity(F.col("samples"), _rate()).alias("score"))
    left = rows.where("wave_id % 5 = 0").withColumn("score", F.col("score") + (F.col("wave_id") % 10) / 100000.0)
    return sampling.nearest_match(left, rows.where("wave_id % 5 <> 0").select(F.col("wave_id").alias("ir"), "score"), "wave_id", "score", "ir", 9)


_NEAR = lambda x: f"list_position(list_transform([-0.2::DOUBLE, -0.1::DOUBLE, 0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE], lambda c: abs({x} - c)), list_min(list_transform([-0.2::DOUBLE, -0.1::DOUBLE, 0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE], lambda c: abs({x} - c)))) - 1"


@query(f"WITH {v.WAVES} SELECT wave_id, array_to_string(list_transform(samples, lambda x: CAST({_NEAR('x')} AS VARCHAR)), ' ') AS book0 FROM waves")
def residual_quantise(spark, sf):
    books = [[-0.2, -0.1, 0.0, 0.1, 0.2], [-0.04, 0.0, 0.04]]
    codes = residual_codes(F.col("samples"), books)
    return v.waves(spark, sf).select("wave_id", F.array_join(F.transform(F.element_at(codes, 1), lambda x: x.cast("string")), " ").alias("book0"))


QUERIES, ORACLES = query.queries, query.oracles
