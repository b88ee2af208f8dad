"""Jobs over shards that do only what is missing: a ledger of fingerprints, and dynamic overwrite of single shards.

Each shard's input has a fingerprint of its rows and of the job; each output has
a count and a sum of its rows' hashes.  A run compares both with the ledger and
with what lies on disk, and does those shards anew that are missing, come from
other input or another job, or are damaged.  Spark's dynamic partition overwrite
replaces them whole and leaves the others alone.  The ledger gets the run's
lines last: a run that dies is done again for the shards that it had not noted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "shard_id int, input string, n_rows long, content decimal(38,0), run long"


def _sums(rows: DataFrame) -> DataFrame:
    """(shard_id, n_rows, content) of rows; neither depends on their order."""
    columns = [c for c in rows.columns if c != "shard_id"]
    return rows.groupBy(F.col("shard_id").cast("int").alias("shard_id")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).cast("decimal(38,0)").alias("content"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each shard."""
    if not _exists(spark, f"{path}/ledger"):
        return spark.createDataFrame([], LINES)
    lines = spark.read.schema(LINES).parquet(f"{path}/ledger")
    return lines.groupBy("shard_id").agg(F.max_by(F.struct("input", "n_rows", "content"), "run").alias("l"), F.max("run").alias("run")).select("shard_id", "l.*", "run")


def read_output(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of all shards with shard_id; none yet is an empty table."""
    return spark.read.schema(schema).parquet(f"{path}/data") if _exists(spark, f"{path}/data") else spark.createDataFrame([], schema)


def run_shards(rows: DataFrame, job: Callable[[DataFrame], DataFrame], path: str, fingerprint: str) -> DataFrame:
    """Run job over the shards of rows (shard_id, ...) whose output at path is not whole and current: (shard_id, reason) of those done.

    job keeps shard_id and gives at least a row for each shard (a failure is a row).  reason: missing, input (other rows
    or another fingerprint) or damaged (the output is not what the ledger says).  A shard that rows no longer has is
    left alone.  Without anything to do nothing is written.
    """
    spark = rows.sparkSession
    now = _sums(rows).select("shard_id", F.sha2(F.concat_ws(":", F.lit(fingerprint), F.col("n_rows").cast("string"), F.col("content").cast("string")), 256).alias("now"))
    ledger = read_ledger(spark, path)
    done = job(rows.limit(0))  # its schema
    there = _sums(read_output(spark, path, done.schema)).toDF("shard_id", "there", "found")
    known = now.join(ledger, "shard_id", "left").join(there, "shard_id", "left")
    reason = F.when(F.col("input").isNull() | F.col("there").isNull(), "missing").when(F.col("input") != F.col("now"), "input").when((F.col("there") != F.col("n_rows")) | (F.col("found") != F.col("content")), "damaged")
    run = (ledger.agg(F.max("run")).first()[0] or 0) + 1
    todo = known.select("shard_id", reason.alias("reason"), F.col("now").alias("input")).where("reason is not null")
    plan = f"{path}/plans/{run}"
    todo.write.mode("overwrite").parquet(plan)
    todo = spark.read.parquet(plan)
    if todo.isEmpty():
        return todo.select("shard_id", "reason")
    some = rows.join(todo.select("shard_id"), "shard_id", "left_semi")
    job(some).repartition("shard_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_id").parquet(f"{path}/data")
    written = _sums(read_output(spark, path, done.schema).join(todo.select("shard_id"), "shard_id", "left_semi"))
    lines = todo.join(written, "shard_id", "left").select("shard_id", "input", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "content", F.lit(run).cast("long").alias("run"))
    lines.write.mode("append").parquet(f"{path}/ledger")
    return todo.select("shard_id", "reason")


def shard_report(spark: SparkSession, path: str, schema, expected: DataFrame) -> DataFrame:
    """One row about the output's documents (tokens, error): ok, failed, tokens, and whether every shard of expected (shard_id) is there."""
    rows = read_output(spark, path, schema)
    bad = F.col("error").isNotNull()
    absent = expected.select("shard_id").distinct().join(read_ledger(spark, path), "shard_id", "left_anti").agg((F.count(F.lit(1)) == 0).alias("complete"))
    told = rows.agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"), F.coalesce(F.sum(F.when(~bad, F.size("tokens"))), F.lit(0)).alias("tokens"))
    return told.crossJoin(F.broadcast(absent))  # a row each
