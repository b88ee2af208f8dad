"""Operators on hand-made tables: goldens, errors, files, streams."""

import hashlib
import itertools
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylark.functions.tokens import Vocabulary
from quaylark.operators import catalogue, corpus, curves, decode, evaluation, losses, metrics, quality, sampling
from quaylark.sources import files, settings
from quaylark.streaming import curriculum, streams


@pytest.fixture(scope="module")
def tracks(spark):
    rows = [(f"{i}.wav", f"track-{i:03d}", f"{i:05d}", 10.0 + i % 5) for i in range(40)]
    return spark.createDataFrame(rows, files.CATALOGUE)


def test_metrics(spark):
    rows = spark.createDataFrame([(1, False, True, 1.0), (7, False, False, 1.0), (None, True, False, 2.0)], "rank int, failed boolean, eos boolean, latency double")
    m = metrics.joint_metrics(rows, [], eos="eos").first()
    assert (m["selected"], m["evaluated"], m["failed"]) == (3, 2, 1)
    assert (m["top1"], m["top5"], m["top10"], m["mrr"], m["eos_rate"], m["qps"]) == pytest.approx((1 / 3, 1 / 3, 2 / 3, (1 + 1 / 7) / 3, 1 / 3, 0.5))
    gen = spark.createDataFrame([("a", "a", ["a", "b"], True), ("b", "a", ["c", "b"], True)], "code string, greedy string, beam array<string>, ended boolean")
    g = metrics.generation_metrics(gen, []).first()
    assert (g["greedy_top1"], g["top1"], g["top5"], g["mrr"]) == (0.5, 0.5, 1.0, 0.75)


def test_codes_and_catalogue(spark, tracks):
    coded = catalogue.assign_codes(tracks.drop("code"), 1).collect()
    assert sorted(r["code"] for r in coded) == [f"{i:05d}" for i in range(40)]
    assert coded != catalogue.assign_codes(tracks.drop("code"), 2).collect()
    listing = spark.createDataFrame([(f"{i}.wav", 6.0 if i % 3 else 1.0, "broken" if i % 7 == 0 else None) for i in range(60)], "path string, duration double, error string")
    records, rejected = catalogue.build_catalogue(listing, 3, 20)
    got = records.collect()
    assert len(got) == 20 and len({r["code"] for r in got}) == 20 and all(len(r["track_id"]) == 20 for r in got)
    fine = {f"{i}.wav" for i in range(60) if i % 3 and i % 7}
    assert {r["path"] for r in got} <= fine and not {r["path"] for r in rejected.collect()} & fine


def test_cohorts(spark, tracks):
    c = catalogue.sample_cohort(tracks, 9, 10)
    assert [r["pos"] for r in c.orderBy("pos").collect()] == list(range(10))
    assert {r["track_id"] for r in c.collect()} == {r["track_id"] for r in catalogue.sample_cohort(tracks.repartition(7), 9, 10).collect()}
    assert catalogue.select_cohort(c, 10, max_tracks=3).count() == 3 and catalogue.select_cohort(c, 10, sample_tracks=4, seed=2).count() == 4
    for bad in (dict(expected=11), dict(expected=10, max_tracks=1, sample_tracks=1)):
        with pytest.raises(ValueError):
            catalogue.select_cohort(c, **bad)
    found, missing = catalogue.in_cohort_order(c, tracks.where("track_id <> 'track-001'"))
    assert found.count() + missing.count() == 10
    assert catalogue.cohort_violations(c.unionByName(c), 10).count() == 2


@pytest.mark.parametrize("n, batch, accumulate", [(10, 10, 8), (40, 16, 4), (7, 3, 2)])
def test_batches(spark, n, batch, accumulate):
    cohort = spark.createDataFrame([(f"t{i}",) for i in range(n)], "track_id string")
    rows = catalogue.batch_plan(cohort, 1, 3, n, batch, accumulate).collect()
    length = -(-(-(-n // batch)) // accumulate) * accumulate
    assert sorted({r["batch_idx"] for r in rows}) == list(range(length)) and len(rows) == length * batch
    assert {r["track_id"] for r in rows} == {f"t{i}" for i in range(n)}
    assert all(r["optimizer_step"] == (3 * length + r["batch_idx"]) // accumulate for r in rows)


def test_resume_offset():
    assert (312 * 8 + 0) // 8 + catalogue.resume_offset(312, 312, 0, 10, 10, 8) == 312


def test_view_rotation_covers_all(spark):
    rows = spark.createDataFrame([("t", "canonical", s) for s in range(6)] + [("t", "shifted", s) for s in range(5)], "track_id string, view string, start int")
    seen = {(r["view"], r["start"]) for p in range(20) for r in catalogue.view_rotation(rows, 4, p).collect()}
    assert len(seen) == 11


def test_sampling(spark, tracks):
    starts = tracks.select(sampling.start_sample(F.lit(192_000), F.lit(1), F.col("track_id"), F.lit("anchor")).alias("a"), sampling.start_sample(F.lit(192_000), F.lit(1), F.col("track_id"), F.lit("other")).alias("b"), sampling.start_sample(F.lit(-5), F.lit(1), F.col("track_id")).alias("z")).collect()
    assert all(0 <= r["a"] <= 192_000 and r["z"] == 0 for r in starts) and any(r["a"] != r["b"] for r in starts)
    full = F.array(*(F.lit(k).cast("long") for k in range(3)))
    assert tracks.select(sampling.start_sample(F.lit(2), F.col("track_id"), reserved=full).alias("x")).where("x is not null").count() == 0
    many = spark.range(20_000).withColumnRenamed("id", "key")
    out = sampling.consistency_noise(many, [F.lit(7), F.lit(60_000), F.lit(3), F.lit(0), F.col("key")], F.lit(1.0), [F.lit(w) for w in (0.4, 0.3, 0.2, 0.1)], F.lit("steady"))
    n = {r["snr_bin"]: r["count"] / 20_000 for r in out.groupBy("snr_bin").count().collect()}
    assert [n[b] for b in ("very_hard", "hard", "medium", "easy")] == pytest.approx([0.4, 0.3, 0.2, 0.1], abs=0.015)
    assert out.where("snr_db = 0").count() / 20_000 == pytest.approx(0.1, abs=0.01)
    on, snr = sampling.background_noise(F.lit(7), F.lit(1), F.lit(0), F.col("key"), F.lit(0.75), F.lit(0.0), F.lit(30.0))
    assert many.where(on).count() / 20_000 == pytest.approx(0.75, abs=0.015) and many.where((snr < 0) | (snr >= 30)).count() == 0


def test_splits_and_matches(spark):
    rows = spark.createDataFrame([(i, i % 4 if i < 30 else 0) for i in range(200)], "id int, label int")
    split = sampling.stratified_split(rows, "label", "id", 0.2, 27)
    for r in split.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert r["t"] == math.ceil(0.2 * r["n"])
    groups = sampling.group_split(rows, "label", 0.25, 27)
    assert groups.groupBy("label").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0 and groups.where("split = 'test'").select("label").distinct().count() == 1
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 100, 60) / 1.0, rng.integers(0, 100, 20) / 1.0
    left = spark.createDataFrame([(i, float(x)) for i, x in enumerate(a)], "k int, s double")
    right = spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "ir int, s double")
    for ranges in (1, 4, 256):
        got = sampling.nearest_match(left, right, "k", "s", "ir", 1, ranges=ranges).collect()
        assert len(got) == 60 and all(abs(a[r["k"]] - r["matched"]) == np.abs(b - a[r["k"]]).min() and b[r["ir"]] == r["matched"] for r in got)


def test_matches_of_one_value_stay_arrays_and_windows_look_back(spark):
    """Many items of one value: against a plain search; no window of the plans looks ahead, and no pair becomes a row."""
    left, right = [(k, 0.25 * (k % 3)) for k in range(30)], [(i, float(i % 2)) for i in range(2500)]
    made = spark.createDataFrame(left, "k long, s double"), spark.createDataFrame(right, "ir long, s double")
    got = sampling.nearest_match(*made, "k", "s", "ir", 1)
    draw = lambda k, i: hashlib.sha256(f"1:{k}:{i}".encode()).hexdigest()[:16]
    want = {(k, *min(right, key=lambda r: (abs(r[1] - v), draw(k, r[0]), r[0]))) for k, v in left}
    assert {tuple(r) for r in got.collect()} == want
    plans = [got, sampling.draw_from_pool(spark.range(9).withColumnRenamed("id", "key"), spark.range(50).withColumnRenamed("id", "pool_idx"), F.col("key"), "salt", F.lit(True))]
    text = [p._jdf.queryExecution().optimizedPlan().toString() for p in plans]
    assert all("currentrow$(), unboundedfollowing$()" not in x for x in text) and "explode(items" not in text[0]


def test_manifest_and_corpus(spark):
    cohort = spark.createDataFrame([(f"t{i}", f"{i:06d}", f"{i:05d}", 12.0) for i in range(4)], "track_id string, source_id string, code string, duration double")
    excluded = spark.createDataFrame([("000001",)], "source_id string")
    recipes, left = evaluation.manifest(cohort, excluded, 2, 1337, 10.0, 100)
    assert recipes.count() == 2 and [r["track_id"] for r in left.collect()] == ["t1"] and recipes.where("track_id = 't1'").count() == 0
    suites = evaluation.suites(spark)
    assert [r["suite_id"] for r in suites.orderBy("suite_pos").collect()] == ["noise_0_5db", "noise_5_10db", "noise_10_20db", "noise_rir_0_5db", "noise_rir_5_10db", "noise_rir_10_20db"]
    out = evaluation.expect_count(evaluation.query_corpus(recipes, suites, 1337), 36)
    assert out.groupBy("track_id", "snr_low").agg(F.count_distinct("snr_db").alias("n")).where("n > 1").count() == 0
    assert evaluation.pending(out, out.where("query_seconds = 2")).count() == 24
    with pytest.raises(ValueError):
        evaluation.expect_count(out, 35)
    bad = quality.prescribed_violations(cohort.unionByName(cohort.limit(1)).withColumn("code", F.when(F.col("track_id") == "t2", "99999").otherwise(F.col("code"))), cohort, cohort.where("track_id = 't1'"))
    assert {r["rule"] for r in bad.collect()} == {"repeated", "code", "excluded"}


def test_beam_against_brute_force(spark):
    scorer = decode.HashScorer(3)
    windows = spark.createDataFrame([(q, w) for q in range(3) for w in range(2)], "query_id int, window_id int")
    every = windows.join(spark.createDataFrame([("".join(p),) for n in range(3) for p in itertools.product("0123456789", repeat=n)], "prefix string"))
    logits = {(r["query_id"], r["window_id"], r["prefix"]): np.array(r["logits"]) for r in scorer.logits(every).collect()}
    lp = {k: v - v.max() - np.log(np.exp(v - v.max()).sum()) for k, v in logits.items()}
    got = decode.joint_beam(windows, scorer, 10, steps=3).collect()
    for q in range(3):
        beam = [("", 0.0)]
        for _ in range(3):
            cand = [(p + str(d), s + np.mean([lp[q, w, p][d] for w in range(2)])) for p, s in beam for d in range(10)]
            beam = sorted(cand, key=lambda x: (-round(x[1], 12), x[0]))[:10]
        mine = sorted((r["rank"], r["code"], r["score"]) for r in got if r["query_id"] == q)
        assert [c for _, c, _ in mine] == [c for c, _ in beam] and [s for _, _, s in mine] == pytest.approx([s for _, s in beam])
    queries = windows.select("query_id").distinct()
    one = {r["query_id"]: r["code"] for r in decode.beam(queries, scorer, 1, steps=3).collect()}
    assert one == {r["query_id"]: r["code"] for r in decode.greedy(queries, scorer, steps=3).collect()}
    table = decode.TableScorer(scorer.logits(every.withColumn("prefix", F.col("prefix"))))
    assert sorted(map(tuple, decode.joint_beam(windows, table, 4, steps=2).collect())) == sorted(map(tuple, decode.joint_beam(windows, scorer, 4, steps=2).collect()))
    ended = decode.beam(queries, scorer, 3, steps=2, ends="score")
    assert ended.where("rank = 1 and ended").count() == 3
    assert all(len(r["beam"]) == 3 for r in decode.beams_as_arrays(ended).collect())


def test_log_softmax_works_each_part_out_once(spark):
    x = [0.5, -2.0, 7.25, 7.25]
    told = decode.log_softmax(F.col("x"))
    assert str(told).count("array_max") == 1
    got = spark.createDataFrame([(x,), (None,)], "x array<double>").select(told.alias("y")).collect()
    norm = math.log(sum(map(math.exp, x)))
    assert got[0]["y"] == pytest.approx([v - norm for v in x]) and got[1]["y"] is None


@pytest.mark.parametrize("ends", [None, "score", "flag"])
def test_beams_are_not_put_into_one_task(spark, ends):
    """A query's id becomes hundreds of rows, so the tasks must not be sized by the ids."""
    queries = spark.range(640).select(F.col("id").alias("query_id"))
    windows = queries.withColumn("window_id", F.explode(F.array(F.lit(0), F.lit(1))))
    for found in (decode.joint_beam(windows, decode.HashScorer(1), 3, 2, ends), decode.beam(queries, decode.HashScorer(1), 3, 2, ends)):
        rows = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("query_id").alias("n")).collect()
        assert len(rows) > decode.LEAST_TASKS // 2 and max(r["n"] for r in rows) < 64 and sum(r["n"] for r in rows) == 640


def test_lines_without_code_have_no_part_in_a_fingerprint(spark):
    rows = spark.createDataFrame([("b", "00002", 1), ("x", None, 0), ("a", "00001", 2)], "track_id string, code string, pos int")
    assert catalogue.mapping_fingerprint(rows, "pos").first()[0] == hashlib.sha256(b"b:00002\na:00001").hexdigest()
    assert catalogue.mapping_fingerprint(rows.where("code is null"), "pos").first()[0] is None


def test_losses(spark):
    pairs = spark.createDataFrame([(1, [0.0] * 10, [0.0] * 10)], "k int, teacher array<double>, student array<double>")
    assert losses.distillation(pairs, ["k"], 2.0).first()["kd_loss"] == 0
    assert losses.distillation(pairs.limit(0), []).first()["kd_loss"] == 0
    x = F.array(*map(F.lit, (1.0, 2.0, 3.0)))
    assert spark.range(1).select(losses.cross_entropy(x, F.lit(2)).alias("x")).first()["x"] == pytest.approx(-math.log(math.exp(3) / sum(map(math.exp, (1, 2, 3)))))
    rows = spark.createDataFrame([(1, "anchor", "a"), (1, "secondary", "b")], "pair_id int, role string, track_id string")
    with pytest.raises(Exception, match="two tracks"):
        losses.pair_rows(rows).collect()


def plain_merge(counts, least):
    """A rare label's rows are relabelled, again and again."""
    rows = [(k, k) for k, n in counts.items() for _ in range(n)]
    while len(size := Counter(new for _, new in rows)) > 1 and (rare := sorted(k for k, n in size.items() if n < least)):
        near = min((k for k in size if k != rare[0]), key=lambda k: (abs(k - rare[0]), k))
        rows = [(old, near if new == rare[0] else new) for old, new in rows]
    return dict(rows)


def test_corpus(spark):
    merged = lambda counts, least: {r["old"]: r["new"] for r in corpus.merge_rare_labels(spark.createDataFrame(list(counts.items()), "label int, n int"), least).collect()}
    assert merged({1: 1, 2: 5, 4: 1, 9: 7}, 3) == {1: 2, 2: 2, 4: 2, 9: 9}
    assert merged({3: 1}, 5) == {3: 3} and merged({}, 5) == {}
    assert merged({1: 1, 3: 1, 5: 1, 7: 1, 20: 9}, 4) == dict.fromkeys((1, 3, 5, 7), 7) | {20: 20} == plain_merge({1: 1, 3: 1, 5: 1, 7: 1, 20: 9}, 4)
    rng = np.random.default_rng(1)
    for least in (2, 6):
        counts = {int(k): int(n) for k, n in zip(rng.choice(200, 30, replace=False), rng.integers(1, 8, 30), strict=True)}
        assert merged(counts, least) == plain_merge(counts, least)
    rows = spark.createDataFrame([(1,), (2,), (2,), (2,)], "label int")
    assert [r["label"] for r in corpus.apply_merge(rows, "label", 2).collect()] == [2, 2, 2, 2]
    assets = spark.createDataFrame([("d", "b", "x", "train"), ("d", "c", "y", "test"), ("d", "a", "z", "train"), ("e", "a", "w", "train")], "digest string, collection string, relative string, split string")
    assert {r["digest"]: r["relative"] for r in corpus.dedupe_keepers(assets).collect()} == {"d": "y", "e": "w"}
    assert sorted((r["removed"], r["cross_split"]) for r in corpus.dedupe_audit(assets).collect()) == [("train/a/z", True), ("train/b/x", True)]
    same_path = spark.createDataFrame([("d", "a", "x", "train"), ("d", "b", "x", "train")], assets.schema)
    assert [tuple(r) for r in corpus.dedupe_audit(same_path).collect()] == [("d", "train/a/x", "train/b/x", False)]


def test_curves(spark):
    log = spark.createDataFrame([(1, 1, 5.0), (1, 2, 4.0), (2, 3, float("nan")), (2, 4, 1.0), (0, 5, 1.0), (3, 6, 1.0), (4, 7, 1.0), (5, 8, float("inf"))], "step int, line int, value double")
    points = curves.curve(log, [])
    assert sorted(map(tuple, points.collect())) == [(1, 4.0), (2, 1.0), (3, 1.0), (4, 1.0)]
    assert curves.onset(points.withColumn("k", F.lit(1)), ["k"], 2.0, 2).first()["onset"] == 2
    assert curves.onset(points.withColumn("k", F.lit(1)), ["k"], 2.0, 5).count() == 0
    with pytest.raises(ValueError):
        curves.require_points(points.limit(0), "loss")


def test_quality(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "key string, value string")
    b = spark.createDataFrame([("x", "1"), ("y", "3"), ("z", "4")], "key string, value string")
    assert sorted((r["key"], r["left"], r["right"]) for r in quality.metadata_differences(a, b).collect()) == [("y", "2", "3"), ("z", None, "4")]
    assert quality.one_value(a, "key").count() == 2 and quality.one_value(a.limit(1), "key").count() == 0
    g = spark.createDataFrame([(2.5,), (5.0,), (7.4999999999,)], "s double").select(quality.on_grid(F.col("s"), F.lit(2.5)).alias("x"), quality.on_grid(F.col("s"), F.lit(5.0)).alias("y"))
    assert [tuple(r) for r in g.collect()] == [(True, False), (True, True), (True, False)]
    assert spark.range(1).select(quality.missing_keys(["a", "b"], F.array(F.lit("a"))).alias("x")).first()["x"] == ["b"]


def test_token_store(spark, tmp_path):
    rows = [(i, f"t{i // 2}", f"{i // 2:05d}", "p", i * 5.0, 5.0, "ok" if i < 9 else "failed", 0, 2, 1, None if i < 9 else "bad", "canonical", "train", None, 0, [i, 1024 + i], i // 4) for i in range(10)]
    schema = files.TOKENS.add("shard_id", "integer")
    df = spark.createDataFrame(rows, schema)
    files.write_token_store(df, f"{tmp_path}/store", Vocabulary(2).total, "train", "f")
    got = files.read_token_store(spark, f"{tmp_path}/store", Vocabulary(2).total, "train", "f")
    assert got.count() == 9 and [r["x"] for r in got.orderBy("document_index").select(files.span(F.col("tokens"), F.lit(1), F.lit(1)).alias("x")).limit(2).collect()] == [[1024], [1025]]
    assert [r["document_index"] for r in got.collect()] == list(range(9))
    with pytest.raises(ValueError, match="other tokenizer"):
        files.read_token_store(spark, f"{tmp_path}/store", Vocabulary(2).total, "train", "g")
    for bad in (df.withColumn("token_offset", F.lit(-1).cast("long")), df.withColumn("corpus_role", F.lit("other")), df.withColumn("token_count", F.lit(3))):
        with pytest.raises(ValueError, match="token store"):
            files.write_token_store(bad, f"{tmp_path}/bad", Vocabulary(2).total, "train", "f")


def test_files(spark, tracks, tmp_path):
    files.write_jsonl(tracks, f"{tmp_path}/c")
    assert files.read_catalogue(spark, f"{tmp_path}/c").count() == 40
    files.write_jsonl(tracks.withColumn("code", F.lit("00000")), f"{tmp_path}/d")
    with pytest.raises(ValueError, match="repeated codes"):
        files.read_catalogue(spark, f"{tmp_path}/d")
    files.write_csv(tracks, f"{tmp_path}/csv", ["track_id", "absent", "code"])
    assert spark.read.csv(f"{tmp_path}/csv", header=True).columns == ["track_id", "absent", "code"]
    waves = spark.createDataFrame([("a.wav", [0.0, 0.5, -0.5]), ("b.wav", [])], "name string, samples array<double>")
    folder = f"file://{tmp_path}/wavs"
    assert {r["name"]: r["status"] for r in files.convert_files(waves, folder, 8000).collect()} == {"a.wav": "converted", "b.wav": "failed"}
    assert files.convert_files(waves, folder, 8000).where("status = 'existing'").count() == 1
    (tmp_path / "wavs/bad.WAV").write_bytes(b"no")
    (tmp_path / "wavs/x.txt").write_text("x")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.decode_wavs(files.audio_files(spark, folder, content=True)).collect()}
    assert set(got) == {"a.wav", "bad.WAV"} and got["bad.WAV"]["error"] and got["a.wav"]["samples"] == pytest.approx([0, 0.5, -0.5], abs=1e-4)
    assert files.audio_files(spark, f"{tmp_path}/nowhere").count() == 0 and files.file_digests(spark, folder).count() == 3
    rejects = files.add_rejects(spark.createDataFrame([("a", "1")], "path string, error string"), spark.createDataFrame([("a", "2"), ("b", "3")], "path string, error string"))
    assert sorted(map(tuple, rejects.collect())) == [("a", "1"), ("b", "3")]
    files.write_json(f"{tmp_path}/x.json", {"b": 1, "a": [2]})
    assert files.read_json(f"{tmp_path}/x.json") == {"a": [2], "b": 1} and files.output_paths("r.json")["csv"] == "r.csv"
    assert files.track_ids({"track_ids": ["a", "b"]}, 2) == ["a", "b"]
    with pytest.raises(ValueError):
        files.track_ids(["a", "a"], 2)


def test_results_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"protocol_fingerprint":"p","status":"ok","track_id":"t","suite_id":"s","query_seconds":2.0,"correct_rank":1}\n')
    assert files.read_results(spark, f"{tmp_path}/log.jsonl", "p").count() == 1
    with pytest.raises(ValueError, match="other protocol"):
        files.read_results(spark, f"{tmp_path}/log.jsonl", "q")
    # What is appended can be resumed from; nulls are written out and keys of all levels sorted.
    rows = [("p", "ok", t, "s", 2.0, None, None, True, None, [1], [("00001", -1.0, True)]) for t in ("a", "b")]
    for r in rows:
        files.append_results(spark.createDataFrame([r], files.RESULT), f"{tmp_path}/log")
    assert sorted(map(tuple, files.read_results(spark, f"{tmp_path}/log", "p").select("track_id", "top1_eos_valid", "window_starts").collect())) == [("a", True, [1]), ("b", True, [1])]
    line = json.loads(spark.read.text(f"{tmp_path}/log").first()[0])
    assert line["error"] is None and list(line) == sorted(line) and list(line["beam"][0]) == ["code", "ended_with_eos", "mean_log_probability"]


def test_sealed_documents(tmp_path):
    content = {"configuration": {"protocol": "v1", "n": 1}, "recipes": [{"track_id": "a"}], "queries": [1, 2]}
    path = f"{tmp_path}/manifest.json"
    assert files.reusable_recipes(path, "v1") is None
    files.write_json(path, files.sealed(content))
    assert files.reusable_recipes(path, "v1") == [{"track_id": "a"}]
    assert files.check_manifest(files.read_json(path), content["configuration"], 2) == content
    for broken, protocol in ((files.sealed(content) | {"queries": []}, "v1"), (files.sealed(content), "v2"), (files.sealed(content | {"recipes": 3}), "v1")):
        files.write_json(path, broken)
        with pytest.raises(ValueError):
            files.reusable_recipes(path, protocol)
    for configuration, n in (({}, 2), (content["configuration"], 3)):
        with pytest.raises(ValueError):
            files.check_manifest(files.sealed(content), configuration, n)


def test_settings(tmp_path):
    base = {"train": {"steps": 1}, "x": 1}
    assert settings.with_overrides(base, train__steps=5, x=None, new__y=2) == {"train": {"steps": 5}, "x": 1, "new": {"y": 2}} and base["train"]["steps"] == 1
    settings.save(f"{tmp_path}/c.yaml", base)
    assert settings.load(f"{tmp_path}/c.yaml") == base
    meta = dict.fromkeys(settings.REQUIRED, "x")
    assert settings.check_metadata(meta, "x") and settings.check_profile({"codebooks": 8, "tracks": 25_000})["weight"] == 32
    for bad in (lambda: settings.check_metadata(meta, "y"), lambda: settings.check_metadata({}, "x"), lambda: settings.check_profile({"codebooks": 3, "tracks": 1}), lambda: settings.check_profile({"codebooks": 8, "tracks": 1, "digit_weight": 1})):
        with pytest.raises(ValueError):
            bad()
    assert settings.unexpected_keys({"a": 1, "b": 2}, {"a"}) == ["b"]


TRACE = [(10_000, 0.9, 0.9, False), (20_000, 0.49, 0.7, False), (25_000, 0.5, 0.8, False), (30_000, 0.8, 0.74, True), (32_500, 0.8, 0.75, True), (35_000, 0.8, 0.76, True), (40_000, 0.8, 0.1, True)]
TOLD = [None, "gate_waiting", "gate_opened", "recovery_started", "recovery_waiting", "recovery_completed", None]


def test_curriculum_gate_and_recovery():
    limits, state, told = curriculum.Limits(), curriculum.State(), []
    assert (limits.clean, limits.hard_limit) == (20_000, 120_000)
    clock = []
    for t in TRACE:
        state, event, failure = curriculum.advance(state, curriculum.Probe(*t), limits)
        told.append(event)
        clock.append(curriculum.effective_step(state, t[0], limits))
    assert told == TOLD and "second time" in failure and curriculum.multiplier(state) == 0.5
    assert clock == [10_000, 20_000, 20_000, 25_000, 25_000, 25_000, 30_000]
    assert curriculum.effective_step(state, 42_500, limits) == 32_500 and curriculum.effective_step(state, 200_000, limits) == 70_000
    gated = curriculum.State()
    assert curriculum.effective_step(gated, 25_000, limits) == 20_000
    assert "gate allowance" in curriculum.advance(gated, curriculum.Probe(50_000, 0.49, 0.7, False), limits)[2]
    state = gated
    for t in ((20_000, 0.5, 0.8, False), (25_000, 0.8, 0.7, True)):
        state = curriculum.advance(state, curriculum.Probe(*t), limits)[0]
    assert state.phase == "recovering" and curriculum.advance(state, curriculum.Probe(44_999, 0.8, 0.7, True), limits)[1] == "recovery_waiting"
    assert "recover within" in curriculum.advance(state, curriculum.Probe(45_000, 0.8, 0.7, True), limits)[2]
    quiet = curriculum.advance(state._replace(phase="open"), curriculum.Probe(30_000, 0.8, 0.1, False), limits)
    assert quiet[1:] == (None, None)


def test_curriculum_streams(spark, tmp_path):
    rows = spark.createDataFrame([("r", *t) for t in TRACE], "run_id string, global_step long, exact double, top1 double, active boolean")
    got = curriculum.curriculum_events(rows).orderBy("global_step").collect()
    assert [r["event"] for r in got] == TOLD and got[3]["multiplier"] == 0.5 and got[-1]["failure"]
    for part in (rows.where("global_step < 26000"), rows.where("global_step > 26000")):
        part.coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = curriculum.curriculum_stream(streams.result_stream(spark, f"{tmp_path}/in", rows.schema))
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert [r["event"] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("global_step").collect()] == TOLD


def test_streams(spark, tmp_path):
    schema = "track_id string, step int, line int, value double"
    source = lambda: streams.result_stream(spark, f"{tmp_path}/in", schema)
    for part in ([("a", 1, 1, 1.0), ("a", 1, 2, 2.0)], [("a", 1, 3, 3.0), ("b", 2, 4, 4.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        streams.append_new(source(), ["track_id", "step"], f"{tmp_path}/new", f"{tmp_path}/ck1").awaitTermination()
        q = streams.upsert_latest(source(), ["track_id", "step"], "line", f"{tmp_path}/last", f"{tmp_path}/ck2")
        q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/new").count() == 2
    assert sorted((r["track_id"], r["value"]) for r in streams.read_latest(spark, f"{tmp_path}/last", 1, schema).collect()) == [("a", 3.0), ("b", 4.0)]


# -- pools and passes

def test_pool_draws_pass_over_all_invalid_items(spark):
    """200 recipes, a pool of 100 whose first 30 alone are valid: all come out, with the first valid item around the end."""
    from quaylark.operators.sampling import draw_from_pool

    pool = spark.range(100).select(F.col("id").alias("pool_idx"))
    keys = spark.range(200).select(F.col("id").cast("string").alias("key"))
    seed = lambda k: int(hashlib.sha256(f"salt:{k}".encode()).hexdigest()[:16], 16)
    for width, fine in ((7, lambda i: i < 30), (1000, lambda i: i == 99), (1, lambda i: i % 40 == 13)):
        got = draw_from_pool(keys, pool, F.col("key"), "salt", F.udf(fine, "boolean")("pool_idx"), width=width).collect()
        assert len(got) == 200
        for r in got:
            start = seed(r["key"]) % 100
            first = next(t for t in range(100) if fine((start + t) % 100))
            assert (r["attempt"], r["pool_idx"]) == (first, (start + first) % 100)
    none = draw_from_pool(keys, pool, F.col("key"), "salt", F.lit(False)).collect()
    assert len(none) == 200 and all(r["pool_idx"] is None for r in none)
    assert draw_from_pool(keys, pool.limit(0), F.col("key"), "salt", F.lit(True)).where("pool_idx is null").count() == 200


def test_recipes_without_assets_are_error_rows(spark):
    from quaylark.operators.jobs import with_assets

    recipes = spark.range(200).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("track_id"))
    noise = spark.range(100).select(F.col("id").alias("pool_idx"), F.col("id").cast("string").alias("path"), F.lit(500).alias("samples"), (F.col("id") < 30).alias("valid"))
    rooms = noise.select("pool_idx", "path", "valid")
    fine = with_assets(recipes, noise, rooms, 1, 200)
    assert fine.count() == 200 and fine.where("error is null and noise_path < 30 and rir_path < 30 and noise_offset_samples between 0 and 300").count() == 200
    assert with_assets(recipes, noise, rooms.withColumn("valid", F.lit(False)), 1, 200).where("error = 'no valid room' and noise_path is not null").count() == 200
    assert with_assets(recipes, noise.limit(0), rooms.limit(0), 1, 200).where("error = 'no valid noise, no valid room'").count() == 200


def test_canonical_pairs_go_through_all_starts(spark):
    """n/2 passes see each start once; an odd number of starts goes on around."""
    rows = spark.createDataFrame([(t, "canonical", s) for t, n in (("a", 6), ("b", 8), ("c", 5)) for s in range(n)], "track_id string, view string, start int")
    passes = [{r["track_id"]: (r["anchor_start"], r["other_start"]) for r in catalogue.canonical_pairs(rows, 3, p).collect()} for p in range(5)]
    assert sorted(s for p in passes[:3] for s in p["a"]) == list(range(6)) and sorted(s for p in passes[:4] for s in p["b"]) == list(range(8))
    assert passes[3]["a"] == passes[0]["a"]
    assert Counter(s for p in passes for s in p["c"]) == dict.fromkeys(range(5), 2)


@pytest.mark.parametrize("n_windows", [1, 3])
def test_ends_against_all_codes(spark, n_windows):
    """A beam as wide as all codes of two digits, with ends: a brute force over every code, whose order the ends change."""
    scorer = decode.HashScorer(11)
    windows = spark.range(4).select(F.col("id").alias("query_id")).withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))))
    prefixes = spark.createDataFrame([("",)] + [(str(a),) for a in range(10)] + [(f"{a}{b}",) for a in range(10) for b in range(10)], "prefix string")
    table = {(r["query_id"], r["window_id"], r["prefix"]): (r["logits"], r["others"]) for r in scorer.logits(windows.crossJoin(prefixes)).collect()}
    soft = lambda x: np.array(x) - np.log(np.exp(np.array(x)).sum())
    changed = 0
    for width, kind in ((100, "score"), (100, "flag"), (4, "score"), (4, "flag")):
        got = {}
        for r in decode.joint_beam(windows, scorer, width, 2, kind).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["code"], r["score"], r["ended"]))
        plain = {}
        for r in decode.joint_beam(windows, scorer, width, 2).collect():
            plain.setdefault(r["query_id"], []).append((r["rank"], r["code"]))
        for i in range(4):
            mean = lambda prefix: np.mean([soft(table[i, w, prefix][0]) for w in range(n_windows)], axis=0)  # noqa: B023, E731
            digits = {f"{a}{b}": mean("")[a] + mean(str(a))[b] for a in range(10) for b in range(10)}
            if width == 4:
                first = sorted(range(10), key=lambda a: (-mean("")[a], a))[:4]
                digits = {c: s for c, s in digits.items() if int(c[0]) in first}
                digits = dict(sorted(digits.items(), key=lambda x: (-round(x[1], 12), x[0]))[:4])
            last = {c: np.mean([soft([*table[i, w, c][1], *table[i, w, c][0]]) for w in range(n_windows)], axis=0) for c in digits}
            if kind == "score":
                want = sorted(((s + last[c][0], c, True) for c, s in digits.items()), key=lambda x: (-round(x[0], 12), x[1]))
            else:
                want = sorted(((s, c, bool(last[c][0] >= last[c].max())) for c, s in digits.items()), key=lambda x: (-round(x[0], 12), x[1]))
            assert [(c, e) for _, c, _, e in sorted(got[i])] == [(c, e) for _, c, e in want]
            assert np.allclose([s for _, _, s, _ in sorted(got[i])], [s for s, _, _ in want], atol=1e-9)
            changed += [c for _, c, *_ in sorted(got[i])] != [c for _, c in sorted(plain[i])]
    assert changed >= 4
    one = windows.where("window_id = 0").withColumn("prefix", F.lit("12"))
    for r in scorer.logits(one).select("logits", "others", decode.end_log_probability(F.col("logits"), F.col("others")).alias("p"), decode.end_is_best(F.col("logits"), F.col("others")).alias("b")).collect():
        assert math.isclose(r["p"], soft([*r["others"], *r["logits"]])[0]) and r["b"] == (r["others"][0] > max([*r["logits"], r["others"][1]]))


@pytest.mark.parametrize("name", ["segment_metrics", "monitor_probe", "position_metrics"])
def test_evaluation_searches_once(spark, sf_dir, name):
    from quaylark.plans import jobs as plans

    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") <= 2 * decode.DIGITS  # one beam; each step's window and its filter may name it


def test_tasks_of_a_search_grow_with_its_queries(spark, monkeypatch):
    """No task has more windows on average than stated, whatever the session's shuffle partitions; the beams are the same."""
    queries = spark.range(500).withColumnRenamed("id", "query_id")
    windows = queries.withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(1))))
    search = lambda: (decode.beam(queries, decode.HashScorer(1), 3, 2), decode.joint_beam(windows, decode.HashScorer(1), 3, 2))
    want = [sorted(map(str, x.collect())) for x in search()]
    monkeypatch.setattr(decode, "MOST_WINDOWS", 5, raising=False)
    some = search()
    assert [x.rdd.getNumPartitions() for x in some] == [100, 200]
    assert [sorted(map(str, x.collect())) for x in some] == want
