"""Composite jobs on small waveforms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylark.functions.hashing import py_uint64
from quaylark.operators import composites, corpus, decode, metrics


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, f"t{i}", rng.normal(size=40).tolist(), rng.normal(size=7).tolist(), [1.0, 0.5] if i % 2 else [0.0, 0.0]) for i in range(60)]
    return spark.createDataFrame(rows, "pair_id int, track_id string, samples array<double>, noise array<double>, response array<double>")


def test_crop_pairs(pairs):
    shares = dict(clean=F.lit(0.25), noise=F.lit(0.25), rir=F.lit(0.25), noise_rir=F.lit(0.25))
    rows = composites.crop_pairs(pairs, [F.lit(7), F.lit(1), F.lit(0)], shares, 4, 16).collect()
    assert len(rows) == 120 and all(len(r["wave"]) == 16 for r in rows)
    by = {(r["pair_id"], r["role"]): r for r in rows}
    kinds = set()
    for i in range(60):
        a, b = by[i, "anchor"], by[i, "secondary"]
        kinds.add((b["category"], b["fallback"]))
        if b["fallback"]:
            assert i % 2 == 0 and b["category"] == "clean" and b["wave"] == a["wave"] and b["start"] == a["start"] and not b["degraded"]
        elif b["category"] == "clean":
            assert a["start"] != b["start"]
        else:
            assert a["start"] == b["start"] and b["degraded"] and a["wave"] != b["wave"]
    assert {k for k, _ in kinds} == {"clean", "noise", "rir", "noise_rir"} and ("clean", True) in kinds


def test_retry(pairs):
    most = F.size("samples") - 16
    got = composites.crop_with_retry(pairs, [F.lit(1)], F.col("track_id"), "anchor", most, lambda s: s % 2 == 0).collect()
    assert all(r["start"] is None or r["start"] % 2 == 0 for r in got) and any(r["attempt"] for r in got)
    avoid = composites.crop_with_retry(pairs, [F.lit(1)], F.col("track_id"), "anchor", most, lambda s: F.lit(True), avoid=F.lit(3)).collect()
    assert all(r["start"] != 3 for r in avoid)


def test_replacement(spark):
    rows = spark.createDataFrame([(1, 0, s, i) for s, i in enumerate([5, 5, 7, 9])] + [(1, 1, 0, 5)] + [(2, 0, s, i) for s, i in enumerate([5, 5, 7, 9])], "optimizer_step long, batch_idx long, slot int, index long")
    fine = {5, *range(10, 50)}
    got = composites.replace_identities(rows, 50, fine, 3).collect()
    for step in (1, 2):
        first = {r["slot"]: r["chosen"] for r in got if (r["optimizer_step"], r["batch_idx"]) == (step, 0)}
        used = set()
        for slot, index in enumerate([5, 5, 7, 9]):  # the sequence begins at a hash of seed, step, batch, slot and index
            begin = py_uint64(3, step, 0, slot, index, "replacement") % 50
            want = next(c for c in [index, *((begin + k) % 50 for k in range(50))] if c in fine and c not in used)
            used.add(want)
            assert first[slot] == want
    assert [r["chosen"] for r in got if r["batch_idx"] == 1] == [5]
    assert composites.replace_identities(rows, 50, set(), 3).where("chosen is not null").count() == 0


def test_waveforms(spark, pairs):
    manifest = pairs.withColumn("start_sample", F.when(F.col("pair_id") < 3, 10_000).otherwise(5))
    good, skipped = composites.evaluation_waveforms(manifest, 8, 16)
    assert good.count() == 57 and {r["reason"] for r in skipped.collect()} == {"silent"}
    both = pairs.select(composites.suite_waveform(F.col("samples"), F.lit(8), F.col("noise"), F.array(F.lit(1.0), F.lit(0.5)), F.lit(5.0), F.col("pair_id") % 2 == 0).alias("w"))
    assert {len(r["w"]) for r in both.collect()} == {32}
    assert composites.conditions_by_manifest(manifest, [0.0, 5.0]).count() == 360


def test_token_job(spark, pairs):
    def quantize(waves):
        if any(w[0] > 1 for w in waves):
            raise ValueError("loud")
        return [[int(len(w)), 1] for w in waves]

    docs = pairs.select(F.col("pair_id").cast("long").alias("document_index"), "samples")
    rows = composites.tokenize_documents(docs, quantize)
    loud = docs.where(F.element_at("samples", 1) > 1).count()
    r = composites.token_report(rows, 60).first()
    assert 0 < loud == r["failed"] and r["ok"] == 60 - loud and r["tokens"] == 2 * r["ok"] and r["complete"]
    assert composites.is_deterministic(docs, quantize)


def test_evaluation(spark, pairs):
    scorer = decode.HashScorer(2)
    queries = pairs.select(F.col("pair_id").alias("query_id"), "samples").limit(8)
    top = decode.beams_as_arrays(decode.joint_beam(queries.select("query_id", F.explode(F.array(F.lit(0), F.lit(12), F.lit(24)).cast("array<long>")).alias("window_id")), scorer, 4, 2))
    asked = queries.join(top, "query_id").select("query_id", F.element_at("beam", 2).alias("code"), F.when(F.col("query_id") == 0, F.array(F.lit(1.0))).otherwise(F.col("samples")).alias("samples"), F.lit(0.5).alias("latency"), F.lit("s").alias("suite_id"))
    rows, m = composites.evaluate_joint(asked, scorer, 4, 16, 12, ["suite_id"], 2)
    got = m.first()
    assert (got["selected"], got["failed"]) == (8, 1) and got["top5"] == pytest.approx(7 / 8) and got["mrr"] == pytest.approx(3.5 / 8)
    assert rows.where("failed").first()["reason"] == "short"
    ids = composites.identify(queries.select("query_id"), scorer, 3, 2).collect()
    assert len(ids) == 8 and all(r["beam"] and len(r["greedy"]) == 2 for r in ids)
    means = composites.paired_means(spark.createDataFrame([("a", "clean", True), ("a", "seen", False), ("b", "clean", True)], "track_id string, condition string, hit boolean"), "condition", "hit").collect()
    assert {r["condition"]: (r["mean"], r["n"]) for r in means} == {"clean": (1.0, 1), "seen": (0.0, 1)}


def test_waveforms_of_an_evaluation_are_made_once(spark, pairs, sf_dir, tmp_path):
    """With a path the windows are stored: no step of the beams makes samples again, and the results are the same."""
    from quaylark.plans import catalogue

    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def heard(x):
        made.add(1)
        return x

    asked = pairs.select(F.col("pair_id").alias("query_id"), F.lit("01").alias("code"), heard("samples").alias("samples"), F.lit(0.5).alias("latency"), F.lit("s").alias("suite_id"))
    rows, m = composites.evaluate_joint(asked, decode.HashScorer(2), 4, 16, 12, ["suite_id"], 2, f"file://{tmp_path}/windows")
    got = sorted(map(str, rows.collect()))
    assert m.first()["selected"] == made.value == pairs.count()
    assert got == sorted(map(str, composites.evaluate_joint(asked, decode.HashScorer(2), 4, 16, 12, ["suite_id"], 2)[0].collect()))
    plan = catalogue.QUERIES["degraded_evaluation"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_collected_sources(spark):
    row = lambda d, c, r, **k: spark.createDataFrame([(d, "train", c, r, f"/raw/{r}", *k.values())], f"dataset string, split string, collection string, relative string, path string{''.join(f', {x} int' for x in k)}")
    got = corpus.collect_sources([row("bg_noise", "a", "x.wav", angle=3), row("room_ir", "b", "x.wav", rate=7)]).collect()
    assert {(r["name"], r["angle"], r["rate"]) for r in got} == {("train/x.wav", 3, None), ("train/b/x.wav", None, 7)}
    with pytest.raises(ValueError, match="one name"):
        corpus.collect_sources([row("room_ir", "a", "x.wav"), row("room_ir", "a", "x.wav")])
    with pytest.raises(ValueError, match="incomplete"):
        corpus.collect_sources([row("room_ir", "a", "x.wav").withColumn("split", F.lit(None).cast("string"))])
    with pytest.raises(ValueError, match="has no relative, path"):
        corpus.collect_sources([row("room_ir", "a", "x.wav").drop("relative", "path")])


def test_empty_groups(spark):
    rows = spark.createDataFrame([("a", "t1", "noise", 5.0, 3), ("a", "t1", "clean", None, 4), ("a", "t2", "noise", 7.0, 4)], "batch string, track_id string, category string, snr_db double, start_sample int")
    r = metrics.augmentation_stats(rows, ["batch"], ["clean", "noise", "rir"]).first()
    assert (r["rows"], r["rir_share"], r["mean_snr_db"], r["first_start"], r["last_start"], r["collisions"], r["starts_differ"]) == (3, 0, 6, 3, 4, 1, False)
    expected = spark.createDataFrame([("a",), ("b",)], "batch string")
    told = {x["batch"]: (x["rows"], x["mean_snr_db"]) for x in metrics.with_empty_groups(metrics.augmentation_stats(rows, ["batch"], ["clean"]), expected, ["batch"], "rows").collect()}
    assert told == {"a": (3, 6.0), "b": (0, None)}


def test_crop_job(spark, tmp_path):
    """Rows and audit of one pass: replaced identities are different within a batch, noisy pairs share their start, silent rooms fall back, and what is left over is skipped."""
    rng = np.random.default_rng(3)
    wave = lambda k: [0.0] * 40 if k in (1, 7) else rng.normal(size=10).tolist() if k == 2 else rng.normal(size=40).tolist()
    tracks = spark.createDataFrame([(k, f"t{k}", wave(k)) for k in range(12)], "index long, track_id string, samples array<double>")
    slots = spark.createDataFrame([(5, b, s, k) for b, plan in enumerate([[0, 1, 2, 3], [4, 4, 5, 7], list(range(12))]) for s, k in enumerate(plan)], "optimizer_step long, batch_idx long, slot int, index long")
    key = ["optimizer_step", "batch_idx", "slot"]
    noise = slots.select(*key, F.array(*(F.lit(float(x)) for x in rng.normal(size=6))).alias("noise"))
    rooms = slots.select(*key, F.when(F.col("slot") % 2 == 0, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(1.0), F.lit(0.5))).alias("response"))
    shares = {"clean": F.lit(0.25), "noise": F.lit(0.25), "rir": F.lit(0.25), "noise_rir": F.lit(0.25)}
    from quaylark.operators.jobs import crop_job

    audit = crop_job(slots, tracks, noise, rooms, shares, 3, 8, 16, f"file://{tmp_path}/crops")
    rows = spark.read.parquet(f"file://{tmp_path}/crops").collect()
    # 12 tracks, 9 of them usable: the batch of all twelve skips three; the others replace their unusable and repeated ones.
    assert audit["slots"] == 20 and audit["skipped"] == 3 and audit["rows"] == len(rows) == 34
    by = {}
    for r in rows:
        by.setdefault((r["batch_idx"], r["slot"]), {})[r["role"]] = r
    assert len(by) == 17 and audit["replaced"] == sum(p["anchor"]["track_id"] != f"t{p['anchor']['index']}" for p in by.values()) >= 4
    for b in range(3):
        used = [p["anchor"]["track_id"] for (x, _), p in by.items() if x == b]
        assert len(used) == len(set(used)) and not {"t1", "t2", "t7"} & set(used)
    for p in by.values():
        a, s = p["anchor"], p["secondary"]
        assert a["track_id"] == s["track_id"] and not a["degraded"] and len(a["wave"]) == len(s["wave"]) == 16
        if s["degraded"] or s["fallback"]:
            assert s["start"] == a["start"]
        if s["fallback"]:
            assert s["wave"] == a["wave"] and s["category"] == "clean"
    second = [p["secondary"] for p in by.values()]
    assert audit["fallbacks"] == sum(r["fallback"] for r in second) and audit["degraded"] == sum(r["degraded"] for r in second) > 0
