"""Golden values and properties of expressions."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaylark.functions import hashing, paths, schedules, signals, tokens


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


DRAWS = {"1337:track:paper-snr-range:0:5": (18141598067945747811, 0.9834580018812805), "7:abc:crop-start": (168444857142191430, 0.009131414002878719), "same": (677529369334489940, 0.03672894070775939), "1337:0:category": (12346990255011702883, 0.669331682907052)}


def test_draws(spark):
    for text, (u, f) in DRAWS.items():
        parts = text.split(":")
        assert hashing.py_uint64(*parts) == u and hashing.py_uniform(*parts) == f
        r = one(spark, hashing.stable_uint64(*map(F.lit, parts)).alias("u"), hashing.stable_uniform(*map(F.lit, parts)).alias("f"))
        assert int(r["u"]) == u and r["f"] == f


def test_paths(spark):
    df = spark.createDataFrame([("a/b/000012.wav", "000012"), ("7.mp3", "000007"), ("x/1234567.wav", "1234567"), ("x/12a.wav", None), ("irs/Hall/x.wav", None)], "p string, want string")
    for r in df.select("p", "want", paths.source_id(F.col("p")).alias("got"), paths.room_identity(F.col("p")).alias("room"), paths.openair_room(F.col("p")).alias("open")).collect():
        assert r["got"] == r["want"]
        parts = r["p"].split("/")
        stem = parts[-1].rsplit(".", 1)[0]
        assert r["room"] == ("/".join(parts[:2]) if len(parts) > 2 else f"{parts[0]}/{stem}" if len(parts) == 2 else stem)
    assert one(spark, paths.openair_room(F.lit("data/IRs/Hall/x.wav")).alias("x"))["x"] == "Hall"
    assert one(spark, paths.first_room(F.lit("air_binaural_Meeting_1.mat")).alias("x"))["x"] == "meeting"
    assert one(spark, paths.microphone(F.lit("d/shure_sm57_a.wav"), ["shure", "shure_sm57", "akg"]).alias("x"))["x"] == "shure_sm57"
    assert one(spark, paths.microphone(F.lit("akg/unknown.wav"), ["shure", "akg"]).alias("x"))["x"] == "akg"
    for name, angle in (("Deg030", 30), ("angle_45_x_90deg", 90), ("angle-7", 7), ("none", None), ("deg_30", None), ("ANGLE45", None), ("0450deg", 450), ("angle1234", 123)):
        assert one(spark, paths.incident_angle(F.lit(name)).alias("x"))["x"] == angle
    assert one(spark, paths.microphone(F.lit("d/Shure_1.wav"), ["shure", "Shu"]).alias("x"))["x"] == "Shu"
    for x in (0.0, 5.0, 2.5, 1234567.0, 0.00001234, 100000.0, 0.1 + 0.2, -2.5, 999999.5, 1e-7, 123456.0):
        assert one(spark, paths.g_text(F.lit(x)).alias("x"))["x"] == f"{x:g}"
    assert one(spark, paths.snr_range_id(F.lit(0), F.lit(2.5)).alias("x"))["x"] == "0_2.5db"
    assert one(spark, paths.record_id(F.lit("t"), F.lit("s"), F.lit(2.5)).alias("x"))["x"] == "t__s__2.5s"
    assert one(spark, paths.safe_name(F.lit("a b/ü.c")).alias("x"))["x"] == "a_b_.c"
    with pytest.raises(Exception, match="empty query name"):
        one(spark, paths.safe_name(F.lit("")))
    with pytest.raises(Exception, match="no database size"):
        one(spark, paths.database_size(F.lit("small")))


@pytest.mark.parametrize("phases, step, want", [
    (schedules.BACKGROUND, 22_500, (0.125,)), (schedules.BACKGROUND, 30_000, (0.375,)), (schedules.BACKGROUND, 40_000, (0.625,)),
    (schedules.CONSISTENCY, 25_000, (0.125, 0.025)), (schedules.CONSISTENCY, 35_000, (0.375, 0.075)), (schedules.CONSISTENCY, 47_500, (0.625, 0.1)),
    (schedules.SHORT_RAMP, 22_500, (0.375, 0.05)),
    (schedules.FIXED_RUN, 56_250, (0.625, 0.375, 0, 0)), (schedules.FIXED_RUN, 93_750, (0.25, 0.65, 0.1, 0)), (schedules.FIXED_RUN, 106_250, (0.25, 0.45, 0.2, 0.1)),
    (schedules.CURRICULUM, 20_000, (0.7, 0.15, 0.15, 0)), (schedules.CURRICULUM, 45_000, (0.25, 0.325, 0.3, 0.125)), (schedules.CURRICULUM, 60_000, (0.1, 0.35, 0.3, 0.25)),
])
def test_schedule_values(spark, phases, step, want):
    got = one(spark, *(schedules.piecewise(F.lit(step), phases, k).alias(f"c{k}") for k in range(len(want))))
    assert list(got) == pytest.approx(want)
    assert [schedules.py_piecewise(step, phases, k) for k in range(len(want))] == pytest.approx(want)


def test_severity_quantiles_and_rates(spark):
    for step, want in ((10_000, 1 / 3), (30_000, 2 / 3), (60_000, 1.0), (9_999, None)):
        assert schedules.py_piecewise(step, schedules.CURRICULUM, 5) == (want if want is None else pytest.approx(want))
    for step, want in ((0, 0), (250, 0.5), (500, 1), (60_000, 1), (100_000, 0.75), (140_000, 0.5), (182_500, 0.275), (225_000, 0.05)):
        assert one(spark, schedules.learning_rate_multiplier(F.lit(step)).alias("x"))["x"] == pytest.approx(want)
    for step, want in ((15_000, 0), (22_500, 0.05), (30_000, 0.1), (225_000, 0.1)):
        assert one(spark, schedules.distillation_weight(F.lit(step)).alias("x"))["x"] == pytest.approx(want)
    c = schedules.family_coefficients(F.lit(400.0), F.lit(5.0), F.lit(2.0), F.lit(32.0))
    assert list(one(spark, *(v.alias(k) for k, v in c.items()))) == pytest.approx([400 / 562, 160 / 562, 2 / 562])
    assert [schedules.batch_exposure(q, 25_000)["length"] for q in (2, 4, 6, 8)] == [108, 208, 308, 408]
    assert schedules.scaled(30_000, 10_000) == 12_000


@pytest.mark.parametrize("q, w, h, want", [
    (48_000, 48_000, 12_000, [0]), (72_000, 48_000, 12_000, [0, 12_000, 24_000]), (120_000, 48_000, 12_000, list(range(0, 72_001, 12_000))), (240_000, 48_000, 12_000, list(range(0, 192_001, 12_000))), (50_000, 48_000, 12_000, [0, 2_000]), (10, 48_000, 12_000, []),
])
def test_window_starts(spark, q, w, h, want):
    assert one(spark, signals.window_starts(F.lit(q), F.lit(w), F.lit(h)).alias("x"))["x"] == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(16, 400), st.integers(1, 60))
def test_windows_cover_the_query(spark, q, h):
    got = one(spark, signals.window_starts(F.lit(q), F.lit(16), F.lit(h)).alias("x"))["x"]
    assert got[0] == 0 and got[-1] == q - 16 and got == sorted(set(got)) and max(np.diff([*got, q - 16]), default=0) <= h


def test_signals(spark):
    rng = np.random.default_rng(0)
    x, n = rng.normal(size=48).tolist(), rng.normal(size=48).tolist()
    df = spark.createDataFrame([(x, n)], "x array<double>, n array<double>")
    m = np.array(df.select(signals.mix(F.col("x"), F.col("n"), F.lit(5.0)).alias("m")).first()["m"])
    raw = np.array(x) + np.array(n) * np.sqrt(np.mean(np.square(x)) / np.mean(np.square(n))) / 10 ** (5 / 20)
    assert np.allclose(m, raw * min(1, 0.999 / np.abs(raw).max()))
    silent = df.select(signals.mix(F.array_repeat(F.lit(0.0), 48), F.col("n"), F.lit(5.0)).alias("m")).first()["m"]
    assert silent == [0.0] * 48
    h = [1.0, 0.5, -0.25]
    want = np.convolve(x, h)[:48]
    col = F.array(*map(F.lit, h))
    both = df.select(signals.convolve_direct(F.col("x"), col).alias("a"), signals.convolve_fft(F.col("x"), col).alias("b")).first()
    assert np.allclose(both["a"], want) and np.allclose(both["b"], want)
    impulse = [0.0] * 7 + [1.0] + [0.0] * 8
    wet = spark.createDataFrame([(impulse,)], "x array<double>").select(signals.full_wet(F.col("x"), F.array(F.lit(1.0), F.lit(0.5)), F.lit(8)).alias("w")).first()["w"]
    assert wet == pytest.approx([0.5] + [0.0] * 7, abs=1e-12)
    q = one(spark, signals.quantile_normalize(F.array(*map(F.lit, (3.0, 1.0, 2.0, 10.0, -7.0, 4.0)))).alias("x"))["x"]
    assert q == pytest.approx([v / 9.25 for v in (3, 1, 2, 10, -7, 4)])
    assert one(spark, signals.severity(F.array_repeat(F.lit(0.0), 4), F.lit(8000)).alias("x"))["x"] == math.inf
    assert one(spark, signals.tile(F.array(F.lit(1.0), F.lit(2.0)), F.lit(5)).alias("x"))["x"] == [1, 2, 1, 2, 1]


def test_tokens(spark):
    v = tokens.Vocabulary(2)
    assert (v.bos, v.id_mark, v.eos, v.total) == (2048, 2049, 2060, 2061) and tokens.Vocabulary.from_dict(v.to_dict()) == v
    r = one(spark, v.audio_token(F.lit(1), F.lit(17)).alias("t"), v.flatten(F.array(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (1, 2, 3))))).alias("f"), v.document(F.array(F.lit(1), F.lit(1025)), F.lit("12345")).alias("d"), v.decode_code(v.encode_code(F.lit("01234"))).alias("c"))
    assert r["t"] == 1041 and r["f"] == [1, 1025, 2, 1026, 3, 1027] and r["c"] == "01234"
    assert r["d"] == [2048, 1, 1025, 2049, 2051, 2052, 2053, 2054, 2055, 2060]
    m = one(spark, *(c.alias(k) for k, c in v.masks(F.lit(2)).items()))
    assert [sum(m[k]) for k in ("audio", "digits", "boundary")] == [2, 5, 2] and m["digits"].index(True) == 3
    doc = F.array(*map(F.lit, r["d"]))
    assert one(spark, v.replace_audio(doc, F.array(F.lit(77), F.lit(1101))).alias("x"))["x"][:4] == [2048, 77, 1101, 2049]
    assert one(spark, v.pad(doc, F.lit(12)).alias("x"))["x"][-2:] == [2048, 2048]
    for bad in (v.audio_token(F.lit(2), F.lit(0)), v.encode_code(F.lit("12"))):
        with pytest.raises(Exception, match="range|code"):
            one(spark, bad)
    with pytest.raises(ValueError):
        tokens.Vocabulary(64)
    assert not one(spark, v.layout_ok(F.array(F.lit(1025), F.lit(1))).alias("x"))["x"]


def test_residual_codes(spark):
    rng = random.Random(0)
    x = [rng.uniform(-0.3, 0.3) for _ in range(20)]
    books = [[-0.2, 0.0, 0.2], [-0.05, 0.0, 0.05]]
    got = one(spark, tokens.residual_codes(F.array(*map(F.lit, x)), books).alias("x"))["x"]
    for i, v in enumerate(x):
        for q, book in enumerate(books):
            k = min(range(3), key=lambda k: (abs(v - book[k]), k))
            assert got[q][i] == k
            v -= book[k]


def test_resample_is_band_limited(spark):
    at = lambda rate, n, hz: np.sin(2 * np.pi * hz * np.arange(n) / rate)
    rows = [(at(8000, 800, 1000).tolist(), 8000, 16000), (at(16000, 1600, 1000).tolist(), 16000, 8000), (at(16000, 1600, 6000).tolist(), 16000, 8000), ([], 8000, 16000), (at(8000, 80, 100).tolist(), 8000, 8000)]
    got = [np.array(r["y"]) for r in spark.createDataFrame(rows, "x array<double>, f int, g int").select(signals.resample(F.col("x"), F.col("f"), F.col("g")).alias("y")).collect()]
    inside = slice(70, -70)
    assert got[0][inside] == pytest.approx(at(16000, 1600, 1000)[inside], abs=1e-4) and got[1][inside] == pytest.approx(at(8000, 800, 1000)[inside], abs=1e-4)
    assert np.abs(got[2][inside]).max() < 1e-3 and len(got[2]) == 800 and not len(got[3]) and got[4] == pytest.approx(at(8000, 80, 100))


@pytest.mark.parametrize(("old", "new"), [(2, 3), (44_100, 48_000), (48_000, 16_000), (16_000, 44_100), (8, 5), (1, 7)])
def test_resample_is_the_direct_sum(old, new, monkeypatch):
    """The bank of kernels in blocks against a direct sinc sum over all places, ends included; lines stay lines up to their ends."""
    rng = np.random.default_rng(old)
    for n in (1, 2, 7, 101, 700):
        a = rng.normal(size=n)
        line = np.linspace(3, 2, n) if n > 1 else np.array([3.0])
        count, cut = math.ceil(n * new / old), min(1.0, new / old)
        at = np.arange(count) * old / new
        places = np.arange(-math.ceil(signals.CROSSINGS / cut) - 1, n + math.ceil(signals.CROSSINGS / cut) + 2)
        weight = signals.sinc_kernel(at[:, None] - places, cut)
        direct = (weight @ signals.beyond_ends(a, places)) / weight.sum(1)
        got = signals.polyphase(a, old, new)
        assert len(got) == count and np.abs(got - direct).max() < 1e-9
        assert np.abs(signals.polyphase(line, old, new) - (line[0] + at * ((line[-1] - line[0]) / max(1, n - 1)))).max() < 1e-3
        monkeypatch.setattr(signals, "RESAMPLE_BLOCK", 5)
        assert np.abs(signals.polyphase(a, old, new) - got).max() < 1e-12
        monkeypatch.undo()
    assert len(signals.polyphase(np.zeros(0), old, new)) == 0
