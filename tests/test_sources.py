"""Data sources: recordings, flat token shards, the commit log, line numbers."""

import gzip
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylark.sources import files
from quaylark.sources import recordings as rec
from quaylark.sources import reject_log as rl
from quaylark.sources import token_shards as ts


# -- recordings

def _element(kind, data, order="<"):
    return struct.pack(f"{order}II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def mat_bytes(name, x, order="<", code=9, compressed=False, small_name=False):
    """A MAT 5 file of one real array, written here apart from the reader."""
    types = {9: "f8", 7: "f4", 3: "i2"}
    label = struct.pack(f"{order}HH" if order == "<" else f"{order}HH", *((1, len(name)) if order == "<" else (len(name), 1))) + name.encode().ljust(4, b"\0") if small_name else _element(1, name.encode(), order)
    body = _element(6, struct.pack(f"{order}II", 6, 0), order) + _element(5, np.array(x.shape, f"{order}i4").tobytes(), order) + label + _element(code, x.astype(order + types[code]).tobytes(order="F"), order)
    matrix = _element(14, body, order)
    if compressed:
        packed = zlib.compress(matrix)
        matrix = struct.pack(f"{order}II", 15, len(packed)) + packed
    other = _element(14, _element(6, struct.pack(f"{order}II", 6, 0), order) + _element(5, np.array([1, 1], f"{order}i4").tobytes(), order) + _element(1, b"fs", order) + _element(9, np.array([48000.0], f"{order}f8").tobytes(), order), order)
    return b"MATLAB 5.0 MAT-file".ljust(124, b" ") + (b"\x00\x01IM" if order == "<" else b"\x01\x00MI") + other + matrix


def test_recordings(spark, tmp_path):
    rng = np.random.default_rng(1)
    (tmp_path / "deep/er").mkdir(parents=True)
    want, put = {}, lambda name, data: (tmp_path / name).write_bytes(data)
    for bits, kind in ((8, "pcm"), (16, "pcm"), (24, "pcm"), (32, "pcm"), (32, "float"), (64, "float")):
        for n in (1, 2, 5):
            x = rng.uniform(-1, 1, (n, 37))
            name = f"deep/{kind}{bits}_{n}.WAV"
            put(name, rec.wav_bytes(x, 16_000, bits, kind))
            want[name] = (16_000, n, 37, x, 2.0 ** (1 - bits) if kind == "pcm" else 1e-7)
    x = rng.uniform(-1, 1, (2, 50))
    for name, data, shape in (
        ("wide.mat", mat_bytes("h_air", x), x), ("tall.mat", mat_bytes("h_air", x.T.copy()), x), ("one.mat", mat_bytes("h_air", x[:1]), x[:1]), ("column.mat", mat_bytes("h_air", x[:1].T.copy()), x[:1]),
        ("big.mat", mat_bytes("h_air", x, ">", 7), x), ("packed.mat", mat_bytes("h_air", x, compressed=True), x), ("cube.mat", mat_bytes("h_air", x.reshape(1, 2, 50)), x),
    ):
        put("deep/er/" + name, data)
        want["deep/er/" + name] = (48_000, len(shape), shape.shape[1], shape, 1e-6)
    # In extensible form, with a chunk of odd size before the data.
    form = struct.pack("<HHIIHHHHIH14s", 0xFFFE, 1, 8000, 16_000, 2, 16, 22, 16, 0, 1, b"\0" * 14)
    data = np.array([0, 16384, -32768], "<i2").tobytes()
    put("ext.wav", b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", len(form)) + form + b"LIST\x03\0\0\0abc\0data" + struct.pack("<I", len(data)) + data)
    want["ext.wav"] = (8000, 1, 3, np.array([[0, 0.5, -1]]), 1e-9)
    whole = rec.wav_bytes(x, 8000)
    broken = {
        "cut.wav": whole[:-7], "head.wav": whole[:30], "text.wav": b"not a wave file at all", "none.wav": b"", "adpcm.wav": whole[:20] + b"\x02\0" + whole[22:], "nodata.wav": whole[:36], "other.mat": mat_bytes("h_other", x),
        "cut.mat": mat_bytes("h_air", x)[:-100], "cutz.mat": mat_bytes("h_air", x, compressed=True)[:-20], "deep4.mat": mat_bytes("h_air", rng.uniform(size=(3, 4, 5))), "empty.mat": b"",
    }
    for name, content in broken.items():
        put(name, content)
    put("empty.wav", rec.wav_bytes(np.zeros((1, 0)), 8000))
    put("notes.txt", b"no recording")
    rows = {os.path.relpath(r["path"], tmp_path): r for r in rec.read_recordings(spark, str(tmp_path), samples=True, partitionBytes="2000").collect()}
    assert rows.keys() == want.keys() | broken.keys() | {"empty.wav"}
    for name, (rate, channels, frames, samples, close) in want.items():
        r = rows[name]
        assert (r["error"], r["rate"], r["channels"], r["frames"], r["duration"]) == (None, rate, channels, frames, frames / rate), name
        assert np.abs(np.array(r["samples"]) - samples).max() <= close, name
    assert all(rows[name]["error"] and rows[name]["samples"] is None and rows[name]["frames"] is None for name in broken)
    assert rows["empty.wav"]["error"] == "empty" and rows["empty.wav"]["frames"] == 0
    heads = rec.read_recordings(spark, str(tmp_path))
    assert "samples" not in heads.columns and heads.rdd.getNumPartitions() < rec.read_recordings(spark, str(tmp_path), samples=True, partitionBytes="2000").rdd.getNumPartitions()
    again = {os.path.relpath(r["path"], tmp_path): r for r in heads.collect()}
    assert all(again[n][c] == rows[n][c] for n in rows for c in heads.columns)
    assert {os.path.relpath(r["path"], tmp_path) for r in rec.durations(spark, str(tmp_path)).collect()} == want.keys()
    assert rec.read_recordings(spark, str(tmp_path / "missing")).count() == 0


def test_headers_alone_are_read(tmp_path):
    """Without samples a file of any size costs a few small reads."""
    path = tmp_path / "long.wav"
    path.write_bytes(rec.wav_bytes(np.zeros((2, 500_000)), 8000))
    read = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            data = self.f.read(n)
            read.append(len(data))
            return data

    with open(path, "rb") as f:
        head = rec._wav_header(Counting(f), path.stat().st_size)
    assert head["frames"] == 500_000 and sum(read) < 200


def test_written_recordings(spark, tmp_path):
    rows = spark.createDataFrame([("a.wav", [[0.5, -0.25]], 8000, 16, "pcm"), ("b.wav", [[float("nan")]], 8000, 16, "pcm"), ("c.wav", None, 8000, 16, "pcm")], "name string, samples array<array<double>>, rate int, bits int, kind string")
    told = {r["name"]: r for r in rec.write_recordings(rows, str(tmp_path)).collect()}
    assert told["a.wav"]["status"] == "converted" and told["b.wav"]["status"] == told["c.wav"]["status"] == "failed"
    assert rec.write_recordings(rows.limit(1), str(tmp_path)).first()["status"] == "existing"
    assert rec.read_recordings(spark, str(tmp_path), samples=True).select("samples").collect()[0][0] == [[0.5, -0.25]]
    assert sorted(os.listdir(tmp_path)) == ["a.wav"]


# -- flat token shards

ROWS = "shard_id int, document_index long, track_id string, status string, tokens array<int>, token_count int, error string"


def _rows(spark, n=40, shards=4):
    rng = np.random.default_rng(n)
    out = []
    for i in range(n):
        ok = i % 7 != 3
        t = rng.integers(0, 8192, rng.integers(0, 30)).tolist()
        out.append((i % shards, i, f"t{i}", "ok" if ok else "failed", t if ok else None, len(t) if ok else 0, None if ok else "bad"))
    return out, spark.createDataFrame(out, ROWS).repartition(5)


def test_token_shards(spark, tmp_path):
    want, df = _rows(spark)
    ts.write_shards(df, str(tmp_path), "f", vocabulary=8192, tokenizer={"name": "t"})
    assert sorted(os.listdir(tmp_path)) == sorted(f"{ts.stem(s)}{p}" for s in range(4) for p in ts.PARTS)
    index = ts.read_index(spark, str(tmp_path), "f", "canonical_training", "full")
    rows = {r["document_index"]: r for r in ts.read_tokens(index).collect()}
    assert all(rows[i]["tokens"] == (t or []) and rows[i]["shard_id"] == s and rows[i]["status"] == st and rows[i]["error"] == e for s, i, _, st, t, _, e in want) and len(rows) == len(want)
    for s in range(4):  # numpy maps what the index says
        flat = np.load(tmp_path / f"{ts.stem(s)}.tokens.npy", mmap_mode="r")
        assert flat.dtype == np.uint16 and flat.tolist() == [x for sh, _, _, _, t, _, _ in want if sh == s for x in t or []]
    spans = ts.read_tokens(index.withColumns({"a": F.lit(3), "n": F.lit(4)}), "a", "n")
    assert {r["document_index"]: r["tokens"] for r in spans.collect()} == {i: (t or [])[3:7] for _, i, _, _, t, _, _ in want}
    for args, said in ((("other",), "another tokenizer"), (("f", "heldout_evaluation"), "role")):
        with pytest.raises(Exception, match=said):
            ts.read_index(spark, str(tmp_path), *args).collect()
    with pytest.raises(Exception, match="exists"):
        ts.write_shards(df.where("shard_id = 2"), str(tmp_path), "f")
    assert not os.path.exists(tmp_path / "_temporary") and ts.read_index(spark, str(tmp_path), "f").count() == 40
    ts.write_shards(df.where("shard_id < 2"), str(tmp_path), "g", mode="overwrite")
    assert len(os.listdir(tmp_path)) == 6 and ts.read_index(spark, str(tmp_path), "g").count() == 20
    with pytest.raises(Exception, match="no token shards"):
        ts.read_index(spark, str(tmp_path / "none"), "g").collect()


@pytest.mark.parametrize("fault", ["count", "range", "role", "killed"])
def test_no_half_shard(spark, tmp_path, fault):
    """A task that fails or dies after others have written their shards leaves nothing that a reader sees, and no temporary files."""
    _, df = _rows(spark)
    last = F.col("document_index") == 39
    if fault == "killed":
        import signal

        def die(x):
            import time

            if x == 39:
                time.sleep(2)  # the other shards are written by then
                os.kill(os.getpid(), signal.SIGKILL)
            return x

        bad = df.withColumn("token_count", F.when(last, F.udf(die, "long")("document_index").cast("int") * 0 - 1).otherwise(F.col("token_count")))
    else:
        bad = {"count": df.withColumn("token_count", F.when(last, 99).otherwise(F.col("token_count"))), "range": df.withColumn("tokens", F.when(last, F.array_repeat(F.lit(70_000), F.size("tokens"))).otherwise(F.col("tokens"))),
               "role": df.withColumn("corpus_role", F.when(last, "heldout_evaluation").otherwise("canonical_training"))}[fault]
    with pytest.raises(Exception):  # noqa: B017
        ts.write_shards(bad, str(tmp_path), "f", vocabulary=8192)
    assert not [n for _, _, names in os.walk(tmp_path) for n in names]
    ts.write_shards(df, str(tmp_path), "f", vocabulary=8192)
    assert ts.read_index(spark, str(tmp_path), "f").count() == 40


def test_damaged_shards(spark, tmp_path):
    _, df = _rows(spark)
    for k, (part, hurt, said) in enumerate([
        (".tokens.npy", lambda b: b[:-2], "token array"), (".tokens.npy", lambda b: b.replace(b"<u2", b"<u4"), "flat uint16"), (".index.jsonl", lambda b: b.split(b"\n", 1)[1], "index"), (".meta.json", lambda b: b.replace(b"true", b"false"), "complete"),
        (".tokens.npy", lambda b: b[:-2] + b"\xff\xff", "vocabulary"),
    ]):
        root = tmp_path / str(k)
        ts.write_shards(df, str(root), "f", vocabulary=8192)
        path = root / f"{ts.stem(1)}{part}"
        path.write_bytes(hurt(path.read_bytes()))
        with pytest.raises(Exception, match=said):
            ts.read_index(spark, str(root), "f", check="full").collect()
        os.remove(root / f"{ts.stem(1)}.meta.json")  # without it the shard is not there
        assert {r["shard_id"] for r in ts.read_index(spark, str(root), "f").collect()} == {0, 2, 3}


# -- reject log

def _rejects(spark, paths, error):
    return spark.createDataFrame([(f"p{i}", error) for i in paths], rl.REJECTS)


def test_reject_log(spark, tmp_path):
    log = rl.RejectLog(spark, f"file://{tmp_path}/log")
    assert log.version() == 0 and log.read().count() == 0
    assert log.add(_rejects(spark, [], "none")) == 0
    assert log.add(_rejects(spark, range(10), "first")) == 1
    assert log.add(_rejects(spark, range(5, 15), "second").unionByName(_rejects(spark, range(12, 15), "a")).unionByName(spark.createDataFrame([(None, "x")], rl.REJECTS))) == 2
    assert log.add(_rejects(spark, range(15), "third")) == 2
    want = {f"p{i}": "first" if i < 10 else "second" if i < 12 else "a" for i in range(15)}
    assert {r["path"]: r["error"] for r in log.read().collect()} == want and log.read(1).count() == 10
    files = spark.createDataFrame([(f"p{i}",) for i in range(20)], "path string")
    assert log.contains(files).count() == 15 and sorted(r[0] for r in log.without(files).collect()) == [f"p{i}" for i in range(15, 20)]


def test_reject_log_conflict(spark, tmp_path, monkeypatch):
    """Another writer commits between this one's reading and its commit, twice: its paths win, the rest is added once."""
    log, other = rl.RejectLog(spark, str(tmp_path)), rl.RejectLog(spark, str(tmp_path))
    create, turns = rl._create, []

    def slow(spark_, path, content):
        if len(turns) < 2:
            turns.append(path)
            monkeypatch.setattr(rl, "_create", create)
            other.add(_rejects(spark, [len(turns), len(turns) + 10], f"other {len(turns)}"))
            monkeypatch.setattr(rl, "_create", slow)
        return create(spark_, path, content)

    monkeypatch.setattr(rl, "_create", slow)
    assert log.add(_rejects(spark, range(6), "mine")) == 3
    assert {r["path"]: r["error"] for r in log.read().collect()} == {f"p{i}": "mine" for i in range(6)} | {"p1": "other 1", "p11": "other 1", "p2": "other 2", "p12": "other 2"}
    assert log.read().count() == 8


def test_reject_log_of_concurrent_jobs(spark, tmp_path, monkeypatch):
    """Several Spark jobs at once add overlapping paths, over folds of the log: each path once, with the error of its first commit."""
    from concurrent.futures import ThreadPoolExecutor

    monkeypatch.setattr(rl, "FOLD_AFTER", 3)

    def work(k):
        log = rl.RejectLog(spark, str(tmp_path))
        return [log.add(_rejects(spark, range(7 * t + k, 7 * t + k + 12), f"{k}:{t}")) for t in range(3)]

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(work, range(4)))
    log = rl.RejectLog(spark, str(tmp_path))
    rows = log.read().collect()
    assert len(rows) == len({r["path"] for r in rows}) and {r["path"] for r in rows} == {f"p{i}" for t in range(3) for k in range(4) for i in range(7 * t + k, 7 * t + k + 12)}
    first = {}
    for n in range(1, log.version() + 1):
        for r in log.read(n).collect():
            first.setdefault(r["path"], r["error"])
    assert {r["path"]: r["error"] for r in rows} == first


def test_reject_log_after_a_lost_writer(spark, tmp_path, monkeypatch):
    """A writer that dies before its commit leaves data that nobody reads."""
    log = rl.RejectLog(spark, str(tmp_path))
    log.add(_rejects(spark, range(3), "first"))
    with monkeypatch.context() as m:
        m.setattr(rl, "_create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            log.add(_rejects(spark, range(9), "lost"))
    assert log.read().count() == 3
    assert log.add(_rejects(spark, range(9), "second")) == 2 and log.read().count() == 9


# -- lines

def test_malformed_lines(spark, tmp_path):
    """Path, line and text of each wrong line, in files cut into several splits, of several files in one split, and packed ones."""
    import gzip

    from quaylark.sources import files

    rng = np.random.default_rng(3)
    want = set()
    for k, n in enumerate((1, 900, 7, 2000, 0)):
        lines = []
        for i in range(n):
            kind = rng.integers(0, 40)
            text = '{"step": ' if kind == 0 else "[1, 2]" if kind == 1 else "7" if kind == 2 else "" if kind < 6 else "   " if kind == 6 else json.dumps({"step": i, "text": "x" * int(rng.integers(0, 60))})
            lines.append(text)
            if kind <= 2:
                want.add((f"f{k}.jsonl", i + 1, text))
        (tmp_path / f"f{k}.jsonl").write_text("\n".join(lines) + ("\n" if k % 2 else ""))
    (tmp_path / "g.jsonl.gz").write_bytes(gzip.compress(b'{"a": 1}\n\nbad\n'))
    want.add(("g.jsonl.gz", 3, "bad"))
    for size in ("1000", "20000", "100m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {(os.path.basename(r["path"]), r["line"], r["text"]) for r in files.malformed_lines(spark, str(tmp_path)).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == want, size
    first = sorted((n, line) for n, line, _ in want)[0]
    with pytest.raises(ValueError, match=f"malformed: .*{first[0]}:{first[1]}"):
        files.read_log(spark, str(tmp_path), "step int")
    assert files.read_log(spark, str(tmp_path / "f4.jsonl"), "step int").count() == 0


# -- jobs that do only what is missing

def test_shard_job(spark, tmp_path):
    """A second run writes nothing; a damaged or foreign shard alone is done again; a run that died is made good."""
    from quaylark.sources import shard_job as sj

    rows = spark.range(60).select((F.col("id") % 6).cast("int").alias("shard_id"), "id", F.sequence(F.lit(0), (F.col("id") % 4).cast("int")).alias("tokens"))
    calls = []

    def job(df):
        calls.append(1)
        return df.withColumn("error", F.when(F.col("id") % 10 == 0, "bad"))

    path = f"file://{tmp_path}/job"
    files_of = lambda: {(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(tmp_path / "job/data") for n in names if n.startswith("part-")}
    assert sorted(map(tuple, sj.run_shards(rows, job, path, "f").collect())) == [(k, "missing") for k in range(6)]
    before = files_of()
    assert sj.run_shards(rows.repartition(5), job, path, "f").count() == 0 and files_of() == before
    kind = job(rows.limit(0)).schema
    assert sj.shard_report(spark, path, kind, rows).first().asDict() == {"ok": 54, "failed": 6, "tokens": sum(1 + i % 4 for i in range(60) if i % 10), "complete": True}
    assert not sj.shard_report(spark, path, kind, spark.range(7).select(F.col("id").cast("int").alias("shard_id"))).first()["complete"]
    for (d, n) in before:
        if d.endswith("shard_id=2"):
            os.remove(os.path.join(d, n))
        if d.endswith("shard_id=4"):
            rows.where("shard_id = 4 and id < 20").drop("shard_id").withColumn("error", F.lit(None).cast("string")).coalesce(1).write.mode("overwrite").parquet(d)
    assert sorted(map(tuple, sj.run_shards(rows, job, path, "f").collect())) == [(2, "missing"), (4, "damaged")]
    assert {k: t for k, t in files_of().items() if "shard_id=2" not in k[0] and "shard_id=4" not in k[0]} == {k: t for k, t in before.items() if "shard_id=2" not in k[0] and "shard_id=4" not in k[0]}
    assert sj.run_shards(rows.where("id <> 7"), job, path, "f").collect()[0].asDict() == {"shard_id": 1, "reason": "input"}
    assert sj.read_output(spark, path, kind).count() == 59
    # A run of another job dies after its data is written and before its lines are.
    from pyspark.sql import DataFrameWriter

    write = DataFrameWriter.parquet

    def dying(self, p, *a, **k):
        if p.endswith("/ledger"):
            raise KeyboardInterrupt
        write(self, p, *a, **k)

    DataFrameWriter.parquet = dying
    try:
        with pytest.raises(KeyboardInterrupt):
            sj.run_shards(rows, job, path, "g")
    finally:
        DataFrameWriter.parquet = write
    assert sj.run_shards(rows, job, path, "g").count() == 6 and sj.run_shards(rows, job, path, "g").count() == 0 and sj.read_output(spark, path, kind).count() == 60


def test_many_small_files_are_few_tasks(spark, tmp_path):
    rows = spark.range(600).select(F.format_string("d%d/f%d.wav", F.col("id") % 3, "id").alias("name"), F.col("id").cast("string").alias("content")).coalesce(1)
    folder = f"file://{tmp_path}/many"
    files.write_files(rows, folder)
    found = files.whole_files(spark, folder)
    assert found.rdd.getNumPartitions() <= max(4, 4 * spark.sparkContext.defaultParallelism)
    assert {(r["path"].rsplit("/", 1)[1], bytes(r["content"])) for r in found.collect()} == {(f"f{k}.wav", str(k).encode()) for k in range(600)}


def _as_reader(spark, root):
    return sorted(map(tuple, spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length", "content").collect()))


def test_listing_is_that_of_the_reader(spark, tmp_path, monkeypatch):
    for name in ("a b/ü%20/x=1 #.wav", "a b/p.WAV", "a b/z.wav.gz", "_k=v/p.wav", "_gone/p.wav", ".gone/p.wav", "_metadata_x/p.wav", "c/d/e/f/g/.h.wav", "c/d/e/f/g/h.wav", "c/p._COPYING_", "q.txt", "_metadata", "_SUCCESS", "none"):
        at = tmp_path / "root" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(gzip.compress(b"x") if name.endswith("gz") else name.encode())
    (tmp_path / "root/empty.wav").write_bytes(b"")
    (tmp_path / "root/void").mkdir()
    (tmp_path / "root/nowhere.wav").symlink_to(tmp_path / "not there")
    (tmp_path / "root/linked").symlink_to(tmp_path / "root/c", target_is_directory=True)
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.listed.link./in", f"file://{tmp_path}/root")  # Arrow opens no such store
    whole = str(tmp_path / "root")
    for root, entries in (("viewfs://listed/in", 2), (f"{whole}/a b", 2), (f"{whole}/*", 2), (f"{whole}/q.txt", 2), (f"file://{whole}/", 10_000), (whole, 2)):  # one task walks all, or leaves folders to others
        monkeypatch.setattr(files, "ENTRIES", entries)
        monkeypatch.setattr(files, "CONTENT_BYTES", entries * 10)
        found = files.whole_files(spark, root)
        assert found.columns == ["path", "modificationTime", "length", "content"] and sorted(map(tuple, found.collect())) == _as_reader(spark, root)
    assert any("/level2/" in x for x in files.audio_files(spark, whole).inputFiles())
    void = files.whole_files(spark, f"{tmp_path}/root/void")
    assert void.columns == found.columns and void.count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.whole_files(spark, f"{tmp_path}/nowhere")
    names = {r["path"].rsplit("/", 1)[1] for r in files.audio_files(spark, whole).collect()}
    assert names == {"x=1 #.wav", "p.WAV", "p.wav", "h.wav"}


def test_the_driver_lists_no_files(spark, tmp_path):
    rows = spark.range(600).select(F.format_string("d%d/f%d.wav", F.col("id") % 3, "id").alias("name"), F.col("id").cast("string").alias("content")).coalesce(1)
    folder = f"file://{tmp_path}/many"
    files.write_files(rows, folder)
    for found in (files.whole_files(spark, folder), files.audio_files(spark, folder), files.corpus_files(spark, folder)):
        assert not [x for x in found.inputFiles() if x.endswith(".wav")] and len(found.inputFiles()) < 100 and found.count() == 600
