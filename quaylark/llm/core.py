"""Helpers shared by the operators: shared work folders, materialising, text and Arrow plumbing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: Bytes of a batch that goes to Python and back, where the session does not say: long texts must not fill a worker by their number.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
#: Rows that the Parquet reader holds at once, where a job bounds them: whole texts, so the default 4,096 is many megabytes a task.
READ_KEY = "spark.sql.parquet.columnarReaderBatchSize"


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES, rows: int | None = None) -> None:
    """Smaller Arrow batches for this session, and reads of at most `rows` rows if stated, unless it was given sizes.

    A smaller size takes the place of BATCH_BYTES, which an operator may have set before.
    """
    given = spark.sparkContext.getConf()
    if given.get(BATCH_KEY) is None and spark.conf.get(BATCH_KEY, None) in (None, str(BATCH_BYTES)) and spark.conf.get(BATCH_KEY, None) != str(size):
        spark.conf.set(BATCH_KEY, str(size))
    if rows and given.get(READ_KEY) is None and spark.conf.get(READ_KEY) == "4096":
        spark.conf.set(READ_KEY, str(rows))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this application below spark.checkpoint.dir; where that is unset and Spark is local (tests), below a temporary folder."""
    bound_batches(spark)
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "quaylark-work")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quaylark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def remove_work(spark: SparkSession) -> None:
    """Delete this application's work folders.  Results of the operators read from them: write those first."""
    folder = shared_dir(spark, "any").rsplit("/", 1)[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, runs once."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(col):
    """Lower-case A-Z only.  An all-ASCII text takes the fast path, where lower() does the same."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [x or b"" for x in col.to_pylist()] if col.null_count else col.to_pylist()


def slices(batch: pa.RecordBatch, name: str, most_bytes: int = 8 << 20):
    """Row slices of a batch with about most_bytes of the text column each, one row at least: bounds memory on long texts."""
    col = batch.column(batch.schema.get_field_index(name))
    sizes = np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths (0 allowed) along the first axis."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    full = counts > 0
    if full.any():
        starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        out[full] = np.add.reduceat(values, starts, axis=0, dtype=out.dtype)
    return out


#: Bytes of words as [a-z0-9] and everything from 0x80; A-Z fold to a-z, the rest become spaces.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256)
)
