"""File sources and sinks: listings, JSON lines, CSV, WAV, token stores, reject logs."""

from __future__ import annotations

import errno
import io
import json
import os
import stat
import uuid
import wave
from collections import deque
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.hashing import fingerprint
from ..functions.paths import CATALOGUE_SUFFIXES, CORPUS_SUFFIXES, basename
from ..operators.catalogue import duplicates
from ..operators.quality import assert_empty, token_rules, violations

CATALOGUE = StructType([StructField("path", StringType()), StructField("track_id", StringType()), StructField("code", StringType()), StructField("duration", DoubleType())])
TOKENS = StructType([
    StructField("document_index", LongType()), StructField("track_id", StringType()), StructField("code", StringType()), StructField("source_path", StringType()), StructField("segment_start", DoubleType()), StructField("segment_duration", DoubleType()),
    StructField("status", StringType()), StructField("token_offset", LongType()), StructField("token_count", IntegerType()), StructField("frames", IntegerType()), StructField("error", StringType()), StructField("view_type", StringType()),
    StructField("corpus_role", StringType()), StructField("source_duration", DoubleType()), StructField("padded_samples", IntegerType()), StructField("tokens", ArrayType(IntegerType())),
])
RESULT = StructType([
    StructField("protocol_fingerprint", StringType()), StructField("status", StringType()), StructField("track_id", StringType()), StructField("suite_id", StringType()), StructField("query_seconds", DoubleType()), StructField("latency_seconds", DoubleType()),
    StructField("correct_rank", IntegerType()), StructField("top1_eos_valid", BooleanType()), StructField("error", StringType()), StructField("window_starts", ArrayType(LongType())),
    StructField("beam", ArrayType(StructType([StructField("code", StringType()), StructField("mean_log_probability", DoubleType()), StructField("ended_with_eos", BooleanType())]))),
])


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; set by tests where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        base = f"file://{os.path.abspath(os.environ.get('TMPDIR', '/tmp'))}/quaylark-files"
    return f"{base.rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


#: Entries that a task of a listing goes through before it leaves the folders that remain to others; rows of its batches.
ENTRIES = 10_000
#: Bytes of content in a batch; a larger file is a batch of its own.
CONTENT_BYTES = 8 << 20

_FOUND = "path string, folder boolean, modified long, length long"


def _passed_over(name: str, folder: bool) -> bool:
    """Whether Spark's readers pass over a name."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _entries(fs, folder: str) -> Iterator[tuple[str, bool, int | None, int | None]]:
    """(path, whether it is a folder, milliseconds, bytes) of what lies in a folder: a local one comes entry by entry, others as their store lists them."""
    from pyarrow import fs as pafs

    if not isinstance(fs, pafs.LocalFileSystem):
        for x in fs.get_file_info(pafs.FileSelector(folder)):
            yield x.path, x.type == pafs.FileType.Directory, None if x.mtime_ns is None else x.mtime_ns // 10**6, x.size
        return
    with os.scandir(folder) as entries:
        for x in entries:
            try:
                at = x.stat()
            except OSError as e:
                if e.errno not in (errno.ENOENT, errno.ELOOP):  # deleted since, or a link to nothing
                    raise
                continue
            yield x.path, stat.S_ISDIR(at.st_mode), at.st_mtime_ns // 10**6, at.st_size


def _walk(fs, top: str, most: int) -> Iterator[tuple]:
    """Rows of _FOUND: the files below a folder that are not empty, and those folders that are left to others once so many entries are seen."""
    queue, seen = deque([top]), 0
    while queue:
        here = queue.popleft()
        if seen >= most:
            yield here, True, None, None
            continue
        for path, folder, modified, length in _entries(fs, here):
            seen += 1
            if _passed_over(path.rsplit("/", 1)[-1], folder) or not (folder or length):
                continue
            if folder and seen < most:
                queue.append(path)
            else:
                yield path, folder, modified, length


def _place(spark: SparkSession, root: str) -> tuple[str, str, str] | None:
    """(URI, path in its store, what Spark writes before that path) of a folder in a store that Arrow opens; None for anything else."""
    from pyarrow import fs as pafs

    if set(root) & set("{}[]*?\\"):
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path)
    uri, name = path.toUri().toString(), path.toString()
    try:
        fs, top = pafs.FileSystem.from_uri(uri)
        fine = name.endswith(top) and fs.get_file_info(top).type == pafs.FileType.Directory
    except (OSError, pa.ArrowException):
        return None
    return (uri, top, name.removesuffix(top)) if fine else None


def _listing(spark: SparkSession, uri: str, top: str) -> DataFrame:
    """Rows of _FOUND of all files below a folder, walked by tasks and stored below the work folder: the driver holds none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, _ = pafs.FileSystem.from_uri(uri)
        kinds = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("modified", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            rows = chain.from_iterable(_walk(fs, folder, ENTRIES) for folder in batch.column(0).to_pylist())
            while part := list(islice(rows, ENTRIES)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], schema=kinds)

    store, levels = work_folder(spark, "_listing"), []  # a listing of the work folder itself passes over that name
    folders, left = spark.createDataFrame([(top,)], "path string"), 1
    while left:
        levels.append(f"{store}/level{len(levels)}")
        folders.repartition(min(left, _tasks(spark))).mapInArrow(run, _FOUND).write.parquet(levels[-1])
        folders = spark.read.schema(_FOUND).parquet(levels[-1]).where("folder").select("path")
        left = folders.count()
    return spark.read.schema(_FOUND).parquet(*levels).where("NOT folder")


def _with_content(found: DataFrame, uri: str) -> DataFrame:
    """Listed files with their content, read by a bounded number of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            first, size, held = 0, 0, []
            for k, path in enumerate(batch.column(0).to_pylist()):
                with fs.open_input_stream(path, compression=None) as f:
                    content = f.read()
                if held and size + len(content) > CONTENT_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns, pa.array(held, pa.binary())], [*batch.schema.names, "content"])
                    first, size, held = k, 0, []
                held.append(content)
                size += len(content)
            if held:
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns, pa.array(held, pa.binary())], [*batch.schema.names, "content"])

    dealt = found.select("path", "modified", "length").repartition(_tasks(found.sparkSession), "path")
    return dealt.mapInArrow(run, "path string, modified long, length long, content binary")


def whole_files(spark: SparkSession, root: str, suffixes=None, content: bool = True) -> DataFrame:
    """(path, modificationTime, length[, content]) of all files below root, or of those with one of the suffixes, any case.

    As Spark's binaryFile reader has them (without empty and hidden ones), but that reader lists all files in the driver's memory; here tasks list the
    folders, and as many tasks read as a session has use for.  The reader itself takes what is not a folder (a file, a
    glob, a root that is missing) and stores that Arrow doesn't open.
    """
    columns = ["path", "modificationTime", "length", *(["content"] if content else [])]
    suffix = F.lower(F.regexp_extract(basename(F.col("path")), r"\.([^.]+)$", 1))
    fine = suffix.isin(*suffixes) if suffixes else F.lit(True)
    place = _place(spark, root)
    if place is None:  # Spark counts 4 MB for opening a file and so gives a task some thirty small ones
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).coalesce(_tasks(spark)).where(fine).select(*columns)
    uri, top, before = place
    found = _listing(spark, uri, top).where(fine)
    if content:
        found = _with_content(found, uri)
    return found.withColumns({"path": F.concat(F.lit(before), "path"), "modificationTime": F.timestamp_millis("modified")}).select(*columns)


def audio_files(spark: SparkSession, root: str, suffixes=CATALOGUE_SUFFIXES, content: bool = False) -> DataFrame:
    """(path, length[, content]) of files below root with one of the suffixes, any case; a missing root is empty."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    try:
        files = whole_files(spark, root, suffixes, content)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], schema)
    return files.select("path", "length", *(["content"] if content else []))


def corpus_files(spark: SparkSession, root: str) -> DataFrame:
    return audio_files(spark, root, CORPUS_SUFFIXES)


def read_jsonl(spark: SparkSession, path: str, schema, required: list[str] = ()) -> DataFrame:
    """JSON lines with a fixed schema; malformed lines are an error, blank ones are skipped."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if required:
        assert_empty(df.where(" OR ".join(f"{c} IS NULL" for c in required)).select(*required), "missing fields")
    return df


def is_object(text: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT")), F.lit(False))


def malformed_lines(spark: SparkSession, path: str, fine: Callable[[Column], Column] = is_object) -> DataFrame:
    """(path, line, text) of the lines below path that are neither blank nor fine; lines are numbered from 1 in each file.

    Large files are read in splits.  A split knows the lines before it from the counts of the file's earlier splits, so
    one scan settles all, and only the wrong lines leave their task.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value", F.monotonically_increasing_id().alias("m"))
    wrong = F.when((F.trim("value") != "") & ~fine(F.col("value")), F.struct("m", "value"))
    splits = lines.groupBy("path", "at").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("first"), F.collect_list(wrong).alias("wrong"))
    earlier = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    told = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("path", "first", "before", F.explode("wrong").alias("w"))
    return told.select("path", (F.col("before") + F.col("w.m") - F.col("first") + 1).alias("line"), F.col("w.value").alias("text"))


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """A JSON lines log; malformed lines are an error that names the first five by path and line."""
    wrong = malformed_lines(spark, path).orderBy("path", "line").limit(5).collect()
    if wrong:
        raise ValueError("malformed: " + "; ".join(f"{r['path']}:{r['line']}" for r in wrong))
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines with sorted keys at every level and nulls written out; the job's commit makes the folder appear whole."""
    df.select(*(_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name))).write.mode(mode).option("ignoreNullFields", False).json(path)


def _sorted(col: Column, kind) -> Column:
    """A value with the fields of its structs in the order of their names."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(col.isNotNull(), F.struct(*(_sorted(col[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType | ArrayType):
        return F.transform(col, lambda x: _sorted(x, kind.elementType))
    return col


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    df = read_jsonl(spark, path, CATALOGUE, ["path", "track_id", "code"])
    assert_empty(duplicates(df, ["code"]), "repeated codes")
    return df


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns with a header; missing ones and nulls are empty."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.csv(path, header=True, emptyValue="", nullValue="")


def append_results(df: DataFrame, path: str) -> None:
    """Append rows of a resume log as JSON lines; read_results() reads them."""
    write_jsonl(df, path, "append")


def read_results(spark: SparkSession, path: str, fingerprint: str, keys=("track_id", "query_seconds", "suite_id")) -> DataFrame:
    """A resume log: one protocol, no repeated keys."""
    df = spark.read.schema(RESULT).json(path)
    assert_empty(df.where(~F.col("protocol_fingerprint").eqNullSafe(F.lit(fingerprint))).select(F.col("_metadata.file_name"), "protocol_fingerprint"), "other protocol")
    assert_empty(duplicates(df, list(keys)), "repeated results")
    return df


# -- token stores


def write_token_store(rows: DataFrame, path: str, vocabulary: int, role: str, fingerprint: str) -> None:
    """Parquet by shard, after the rows' checks, with the tokeniser's fingerprint in every row."""
    assert_empty(violations(rows, "document_index", token_rules(vocabulary, role)), "token store")
    rows.withColumn("tokenizer_fingerprint", F.lit(fingerprint)).write.partitionBy("shard_id").parquet(path)


def read_token_store(spark: SparkSession, path: str, vocabulary: int, role: str, fingerprint: str) -> DataFrame:
    """Usable rows of a store after its checks, in document order; an empty store, or one of several roles or of another
    tokeniser, is an error.
    """
    rows = spark.read.parquet(path)
    assert_empty(rows.where(~F.col("tokenizer_fingerprint").eqNullSafe(F.lit(fingerprint))).select("document_index", "tokenizer_fingerprint"), "other tokenizer")
    assert_empty(violations(rows, "document_index", token_rules(vocabulary, role)), "token store")
    usable = rows.where("status = 'ok'").drop("tokenizer_fingerprint")
    if usable.isEmpty():
        raise ValueError("no usable documents")
    return usable.orderBy("document_index")


def span(tokens: Column, offset: Column, count: Column) -> Column:
    return F.slice(tokens, (offset + 1).cast("int"), count.cast("int"))


# -- reject logs


def add_rejects(known: DataFrame, new: DataFrame) -> DataFrame:
    """Rejects by path, known ones first."""
    return known.unionByName(new.dropDuplicates(["path"]).join(known, "path", "left_anti"))


def without_rejects(files: DataFrame, rejects: DataFrame) -> DataFrame:
    return files.join(rejects.select("path").distinct(), "path", "left_anti")


# -- WAV


def wav_bytes(samples, rate: int) -> bytes:
    """PCM-16 of samples in -1..1, clipped."""
    pcm = np.clip(np.round(np.asarray(samples, dtype=float) * 32767), -32768, 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(pcm.tobytes())
    return out.getvalue()


def wav_samples(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples of PCM-16 content."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only PCM-16")
        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels()).mean(axis=1) / 32767
        return w.getframerate(), x


def decode_wavs(files: DataFrame) -> DataFrame:
    """(path, rate, duration, samples, error) of (path, content): a broken file is a row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content in zip(p["path"], p["content"], strict=True):
                try:
                    rate, x = wav_samples(bytes(content))
                    rows.append((path, rate, len(x) / rate, x, None if len(x) else "empty"))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "rate", "duration", "samples", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, rate int, duration double, samples array<double>, error string")


def convert_files(rows: DataFrame, folder: str, rate: int) -> DataFrame:
    """Write (name, samples) as WAV files below a folder that all executors share (a path or URI): (name, status, error).

    status is converted, existing or failed.  A file is written under another name and then moved, so a task that runs
    again finds it whole.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for p in parts:
            out = []
            for name, x in zip(p["name"], p["samples"], strict=True):
                target = f"{root}/{name}"
                try:
                    if fs.get_file_info(target).type != pafs.FileType.NotFound:
                        out.append((name, "existing", None))
                        continue
                    x = np.asarray(x, dtype=float)
                    if not len(x) or not np.isfinite(x).all():
                        raise ValueError("empty or non-finite")
                    tmp = f"{target}.{uuid.uuid4().hex}.tmp"
                    with fs.open_output_stream(tmp) as f:
                        f.write(wav_bytes(x, rate))
                    fs.move(tmp, target)
                    out.append((name, "converted", None))
                except Exception as e:  # noqa: BLE001
                    out.append((name, "failed", str(e)))
            yield pd.DataFrame(out, columns=["name", "status", "error"])

    return rows.select("name", "samples").mapInPandas(run, "name string, status string, error string")


def write_files(rows: DataFrame, folder: str) -> None:
    """Write (name, content binary) as files below a folder that all executors share; each appears whole, under its name, or not at all."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        made = set()  # folders, not files
        for p in parts:
            for name, content in zip(p["name"], p["content"], strict=True):
                target = f"{root}/{name}"
                if (above := target.rsplit("/", 1)[0]) not in made:
                    fs.create_dir(above, recursive=True)
                    if len(made) < 100_000:
                        made.add(above)
                tmp = f"{target}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(tmp) as f:
                    f.write(bytes(content))
                fs.move(tmp, target)
            yield pd.DataFrame({"n": [len(p)]})

    dealt = rows.select("name", F.col("content").cast("binary").alias("content")).repartition(_tasks(rows.sparkSession))  # a small table may be one split, but many files
    dealt.mapInPandas(run, "n long").write.format("noop").mode("overwrite").save()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


# -- driver-side documents


def write_json(path: str, value) -> None:
    """Indented JSON with sorted keys, written under another name and moved."""
    tmp = f"{path}.{os.getpid()}.tmp"
    with open(tmp, "w") as f:
        json.dump(value, f, indent=2, sort_keys=True)
        f.write("\n")
    os.replace(tmp, path)


def read_json(path: str):
    with open(path) as f:
        return json.load(f)


def output_paths(path: str) -> dict[str, str]:
    """Names beside a result file: summary table, query log, manifest."""
    base = path.removesuffix(".json")
    return {"csv": base + ".csv", "queries": base + ".queries.jsonl", "manifest": base + ".manifest.json"}


def sealed(content: dict) -> dict:
    """A document with its own fingerprint."""
    return {**content, "fingerprint": fingerprint(content)}


def unsealed(document: dict) -> dict:
    """The content of a sealed document, whose fingerprint must hold."""
    content = {k: v for k, v in document.items() if k != "fingerprint"}
    if document.get("fingerprint") != fingerprint(content):
        raise ValueError("the document's fingerprint does not hold")
    return content


def check_manifest(document: dict, configuration: dict, size: int) -> dict:
    """A query manifest: sealed, of this configuration, and with so many queries."""
    content = unsealed(document)
    if content.get("configuration") != configuration:
        raise ValueError("the manifest is of another configuration")
    if len(content.get("queries", [])) != size:
        raise ValueError(f"the manifest has {len(content.get('queries', []))} queries, not {size}")
    return content


def reusable_recipes(path: str, protocol: str) -> list[dict] | None:
    """Recipes of an earlier query corpus at this path, None if there is none; a broken or foreign one is an error."""
    if not os.path.exists(path):
        return None
    content = unsealed(read_json(path))
    if content.get("configuration", {}).get("protocol") != protocol:
        raise ValueError("the query corpus is of another protocol")
    if not isinstance(content.get("recipes"), list):
        raise ValueError("the query corpus has no recipes")
    return [dict(r) for r in content["recipes"]]


def track_ids(value, count: int) -> list[str]:
    """A cohort document: a list, or an object with track_ids; exact count, no repeats."""
    ids = value["track_ids"] if isinstance(value, dict) else value
    if len(ids) != count or len(set(ids)) != count:
        raise ValueError(f"expected {count} different tracks")
    return list(ids)
