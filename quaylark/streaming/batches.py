"""Batch plans as a stream: each batch is delivered once, over stops and restarts.

A plan (batch_idx, ...) lies as Parquet by batch.  The source's offset is the
number of batches delivered; a micro-batch holds the next few, a partition each.
The stream's checkpoint knows the last committed offset, and the sink writes a
folder for each micro-batch, overwritten if that runs again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.recordings import _file_system


def write_plan(plan: DataFrame, path: str) -> int:
    """Write a plan by batch (batch_idx from 0 without gaps); the number of batches."""
    plan.repartition("batch_idx").write.partitionBy("batch_idx").parquet(path)
    told = plan.sparkSession.read.parquet(path).agg(F.count_distinct("batch_idx").alias("n"), F.max("batch_idx").alias("last")).first()
    if told["n"] and told["n"] != told["last"] + 1:
        raise ValueError(f"{told['n']} batches, numbered up to {told['last']}")
    return told["n"]


class _Batch(InputPartition):
    def __init__(self, batch: int):
        self.batch = batch


class PlanReader(DataSourceStreamReader):
    """Spark asks for the latest offset without telling where the stream stands, so what it commits is noted, a micro-batch late, beside its checkpoint."""

    def __init__(self, schema, options):
        self.columns = [f.name for f in schema.fields]
        self.path, self.total, self.each, self.notes = options["path"], int(options["batches"]), int(options.get("each", 1)), options["notes"]
        self.told, self.planned = None, 0

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def _noted(self) -> int:
        from pyarrow import fs

        system, root = _file_system(self.notes)
        return max((int(x.base_name) for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.isdigit()), default=0)

    def latestOffset(self) -> dict:
        """`each` batches beyond what has been planned.  After a restart that is where the stream stands, or one further: told again, Spark has seen no news in it."""
        base = max(self.planned, self._noted() if self.told is None else self.told)
        self.told = min(self.total, base + self.each)
        return {"batch": self.told}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.planned = max(self.planned, end["batch"])
        return [_Batch(k) for k in range(start["batch"], end["batch"])]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, root = _file_system(self.path)
        for file in system.get_file_info(fs.FileSelector(f"{root}/batch_idx={partition.batch}")):
            if file.is_file and file.base_name.endswith(".parquet"):
                names = [c for c in self.columns if c != "batch_idx"]
                rows = pq.read_table(file.path, columns=names, filesystem=system, partitioning=None).to_pylist()
                for r in rows:
                    yield tuple(partition.batch if c == "batch_idx" else r[c] for c in self.columns)

    def commit(self, end: dict) -> None:
        system, root = _file_system(self.notes)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{end['batch']}") as f:
            f.write(b"")


class PlanSource(DataSource):
    """Options: path, batches, each, notes."""

    @classmethod
    def name(cls) -> str:
        return "batchplan"

    def streamReader(self, schema) -> PlanReader:
        return PlanReader(schema, self.options)


def plan_stream(spark: SparkSession, path: str, schema, checkpoint: str, each: int = 1) -> DataFrame:
    """The plan at path as a stream for one checkpoint, `each` batches a micro-batch; schema is the plan's, batch_idx included."""
    spark.dataSource.register(PlanSource)
    batches = spark.read.schema(schema).parquet(path).agg(F.max("batch_idx")).first()[0]
    reader = spark.readStream.format("batchplan").schema(schema).option("path", path).option("batches", 0 if batches is None else batches + 1)
    return reader.option("each", each).option("notes", f"{checkpoint.rstrip('/')}/noted").load()


def deliver(stream: DataFrame, folder: str, checkpoint: str, until: int | None = None):
    """Write each micro-batch to a folder of its own below `folder`; the running query.  With `until`, it fails once so many are written: a stop that nothing cleans up after."""

    def write(df: DataFrame, number: int) -> None:
        if until is not None and number >= until:
            raise RuntimeError("stopped")
        df.write.mode("overwrite").parquet(f"{folder}/part={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def deliver_all(stream: DataFrame, folder: str, checkpoint: str, batches: int) -> None:
    """Deliver what is left, to the plan's last batch."""
    query = deliver(stream, folder, checkpoint)
    try:
        while batches:
            query.processAllAvailable()
            told = query.lastProgress
            at = re.search(r"\d+", str(told["sources"][0]["endOffset"])) if told else None  # the offset's one number
            if at and int(at[0]) == batches:
                break
    finally:
        query.stop()


def delivered(spark: SparkSession, folder: str, schema) -> DataFrame:
    """What has been delivered, in the plan's columns."""
    return spark.read.schema(schema).parquet(folder)
