"""Streaming forms of append-only logs: resume without repeats, last write wins, windows, reject filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that a table of last writes is cut into; a micro-batch rewrites only those that it touches.
BUCKETS = 64


def result_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def append_new(stream: DataFrame, keys: list[str], folder: str, checkpoint: str, watermark: tuple[str, str] | None = None):
    """Each key once: repeats are dropped by state, and a batch that runs again overwrites its own folder.

    Without a watermark the state keeps every key for ever, and grows with them: give one (event-time column, delay)
    wherever a key can't come back later than that.
    """
    if watermark:
        stream = stream.withWatermark(*watermark)
    fresh = stream.dropDuplicatesWithinWatermark(keys) if watermark else stream.dropDuplicates(keys)
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_latest(stream: DataFrame, keys: list[str], order: str, folder: str, checkpoint: str, buckets: int = BUCKETS):
    """Last write per key.  Each micro-batch merges the buckets that its keys fall into, as a version of its own.

    `current` names the version of each bucket after each batch (a row a bucket), so that a batch that runs again starts
    from the batch before it and readers see whole batches.  read_latest() reads the table.
    """

    def merge(df: DataFrame, batch: int):
        spark = df.sparkSession
        names = df.columns
        placed = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        placed.persist()
        touched = [r[0] for r in placed.select("_bucket").distinct().collect()]  # a row a bucket at most
        before = _versions(spark, folder, batch - 1) if batch else {}
        old = [f"{folder}/data/version={before[b]}/_bucket={b}" for b in touched if b in before]
        if old:
            kept = spark.read.schema(df.schema).parquet(*old).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            placed_all = placed.unionByName(kept)
        else:
            placed_all = placed
        values = [c for c in names if c not in keys]
        last = placed_all.groupBy("_bucket", *keys).agg(F.max_by(F.struct(*values), order).alias("_last")).select("_bucket", *keys, "_last.*")
        last.select(*names, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/data/version={batch}")
        now = before | dict.fromkeys(touched, batch)
        spark.createDataFrame(list(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/current/{batch}")
        placed.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, folder: str, batch: int) -> dict[int, int]:
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version long").parquet(f"{folder}/current/{batch}").collect()}


def read_latest(spark: SparkSession, folder: str, batch: int, schema) -> DataFrame:
    """The table of last writes after a batch."""
    paths = [f"{folder}/data/version={v}/_bucket={b}" for b, v in _versions(spark, folder, batch).items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and means by event-time window, with late rows up to the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def without_rejects(stream: DataFrame, rejects: DataFrame) -> DataFrame:
    return stream.join(rejects.select("path"), "path", "left_anti")
