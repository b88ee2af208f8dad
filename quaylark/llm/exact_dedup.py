"""Exact deduplication as a stateful stream, in DataFrame operations only.

Each call writes its normalised texts as content, and the ledger of that content
(digest, identifier, locator) runs as a stream through an aggregation keyed by
digest.  Its state is kept without expiry by the RocksDB store on disk,
checkpointed in the shared folder, so later calls meet all earlier texts.  It
retains, for each digest, the identifier that stays, the locator of the content
that came first and how many rows had it, and each micro-batch writes what became
of the digests that it touched.  A digest with more than one row is a hit: its
rows' full texts are compared with each other and with the content at the
locator, so texts count as equal by their bytes, never by digest alone.

A call can die at any step and be made again.  Content and ledger are written
under the call's number, content first, and only a complete ledger is ever
streamed; the stream itself goes on from its checkpoint.  The call's number is
used up by a mark written last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import fresh, lower_ascii, materialise, shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Many small stores share one executor: little memory for each, and bounded for all.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Without this each store takes megabytes of preallocated log.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # A call ends after its batch: a store that is done with must not wait in memory for the next minute's maintenance.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.metricsEnabled": "false",
}
#: A locator names a row of the content of its call: rows are numbered by file, so that a look-up skips the others.
#: Marks are a second hash of the texts: where those of one digest differ, so do the texts, whichever call had them.
LEDGER = "digest binary, id long, locator long, mark long, call int"
HELD = "digest binary, keep_id long, at struct<call:int,locator:long>, group_size long, alike boolean"
CONTENT = "digest binary, id long, locator long, text string"
#: Tasks that the rows of one digest are dealt to, where a join can't be broadcast.
SALTS = 16
#: Keys that a join may broadcast (longs: some 40 MB); beyond it, it goes by a shuffle.
MOST_KEYS = 1_000_000


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    p, system = _path(spark, path)
    return system.exists(p)


def _mark(spark: SparkSession, folder: str, call: int) -> None:
    p, system = _path(spark, f"{folder}/calls/{call}")
    system.createNewFile(p)


def _next_call(spark: SparkSession, folder: str) -> int:
    """The first number that no finished call has."""
    p, system = _path(spark, f"{folder}/calls")
    return 1 + max((int(x.getPath().getName()) for x in system.listStatus(p)), default=-1) if system.exists(p) else 0


def run_ledger(spark: SparkSession, folder: str, call: int, max_bytes: str | None = None) -> DataFrame:
    """Run the files of the ledger that the state has not seen through it: what became of the digests of the call, as HELD.

    The figures are those of all calls.  A micro-batch that runs again overwrites what it wrote; those of an attempt
    that died count as this one's.
    """
    old = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/touched/call={call}/batch={number}")

    try:
        reader = spark.readStream.schema(LEDGER)
        if max_bytes:
            reader = reader.option("maxBytesPerTrigger", max_bytes)
        held = (
            reader.parquet(f"{folder}/ledger").groupBy("digest")
            .agg(F.max("id").alias("keep_id"), F.min(F.struct("call", "locator")).alias("at"), F.count(F.lit(1)).alias("group_size"), (F.min("mark") == F.max("mark")).alias("alike"))
        )
        stream = held.writeStream.foreachBatch(keep).outputMode("update").trigger(availableNow=True)
        stream.option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    touched = f"{folder}/touched/call={call}"
    if not _there(spark, touched):
        return spark.createDataFrame([], HELD)
    told = spark.read.schema(f"{HELD}, batch int").parquet(touched)
    p, system = _path(spark, touched)
    if len(system.listStatus(p)) == 1:
        return told.drop("batch")
    last = told.groupBy("digest").agg(F.max_by(F.struct("keep_id", "at", "group_size", "alike"), "batch").alias("v")).select("digest", "v.*")
    return materialise(last, "exact-touched")


def _sum_of(rows: DataFrame) -> tuple:
    """Of (digest, id): how many, and a sum of their hashes."""
    return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("digest", "id").cast("decimal(38,0)"))).first())


def _begin(spark: SparkSession, folder: str, rows: DataFrame, max_bytes: str | None) -> int:
    """Write content and ledger of the next call, unless an earlier attempt at it has.

    An attempt that died after its ledger was complete, but was made with other rows, is finished first: its rows may
    be in the state already.
    """
    call = _next_call(spark, folder)
    ledger = lambda n: f"{folder}/ledger/call={n}"
    if _there(spark, f"{ledger(call)}/_SUCCESS"):
        if _sum_of(spark.read.schema(LEDGER).parquet(ledger(call))) == _sum_of(rows):
            return call
        run_ledger(spark, folder, call, max_bytes)
        _mark(spark, folder, call)
        call += 1
    rows.select("digest", "id", F.monotonically_increasing_id().alias("locator"), "text").write.mode("overwrite").parquet(f"{folder}/content/call={call}")
    spark.read.schema(CONTENT).parquet(f"{folder}/content/call={call}").select("digest", "id", "locator", F.xxhash64("text").alias("mark")).write.mode("overwrite").parquet(ledger(call))
    return call


def _salt():
    return F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")


def _every_salt():
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def _of(rows: DataFrame, digests: DataFrame, few: bool) -> DataFrame:
    """The rows (digest, ...) with one of the digests; a broadcast of 64-bit hashes thins them out first where it may."""
    if few:
        hashes = F.broadcast(digests.select(F.xxhash64("digest").alias("_h")).distinct())
        return rows.join(hashes, F.xxhash64("digest") == F.col("_h"), "left_semi")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return dealt.join(digests.select("digest", _every_salt()), ["digest", "salt"], "left_semi").drop("salt")


def _contents(rows: DataFrame) -> DataFrame:
    """(digest, text, keep_id, n) of (id, text, digest): combined in each task, so a hot text moves once a task."""
    return rows.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def normal(text_col: str):
    return lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def digest_of(text):
    return F.unhex(F.sha2(text, 256))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None, max_bytes: str | None = None, most_keys: int = MOST_KEYS,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of docs.

    Texts are equal when identical after lower-casing A-Z; null is the empty text, and all empty texts are equal.
    Of equal texts the row with the largest id stays.  A null id ranks below all others: such a row stays only where
    its whole group has null ids.  Rows that repeat an id with equal text are one document: each counts in
    group_size, and all or none are kept.  An empty table gives an empty result.

    With a state_dir, calls go on from each other: keep_id and group_size are of the rows of this and all earlier
    calls, and each call keeps its texts below it, as the content that its locators name.  A call that died is made
    again with the same rows; what it had done is not done twice.
    """
    spark = docs.sparkSession
    folder = state_dir or shared_dir(spark, "exact")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normal(text_col).alias("text")).withColumn("digest", digest_of("text"))
    call = _begin(spark, folder, rows, max_bytes)
    seen = spark.read.schema("digest binary, id long").parquet(f"{folder}/ledger/call={call}")
    hits = materialise(run_ledger(spark, folder, call, max_bytes).where("group_size > 1"), "exact-hits")
    few = hits.count() <= most_keys
    groups = hits.select("digest", "keep_id", "group_size")
    if few:
        found = seen.join(F.broadcast(groups), "digest", "left")
    else:
        found = seen.withColumn("salt", _salt()).join(groups.select("digest", _every_salt(), "keep_id", "group_size"), ["digest", "salt"], "left")
    found = materialise(found.select("digest", "id", "keep_id", "group_size"), "exact-found")
    content = lambda n: spark.read.schema(CONTENT).parquet(f"{folder}/content/call={n}")
    texts = _contents(_of(content(call), hits, few))
    for r in hits.where(F.col("at.call") != call).select("at.call").distinct().collect():  # a row a call
        first = hits.where(F.col("at.call") == r["call"]).select(F.col("at.locator").alias("locator"))
        texts = texts.unionByName(_contents(content(r["call"]).join(F.broadcast(first) if few else first, "locator", "left_semi")))
    unlike = texts.groupBy("digest").agg(F.count_distinct("text").alias("n")).where("n > 1").select("digest")
    clash = materialise(unlike.unionByName(hits.where(~F.col("alike")).select("digest")).distinct(), "exact-clash")
    if not clash.isEmpty():  # several texts under one digest: only those need their text to tell them apart
        told = _contents(spark.read.schema(CONTENT).parquet(*(f"{folder}/content/call={n}" for n in range(call + 1))).join(clash, "digest", "left_semi"))
        told = content(call).join(clash, "digest", "left_semi").join(told.withColumnRenamed("n", "group_size"), ["digest", "text"]).select("digest", "id", "keep_id", "group_size")
        found = found.join(clash, "digest", "left_anti").unionByName(materialise(told, "exact-told-apart"))
    if state_dir:
        _mark(spark, folder, call)
    else:  # what is told is written elsewhere: nothing reads the call's own folder any more
        p, system = _path(spark, folder)
        system.delete(p, True)
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_keys: int = MOST_KEYS) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat an id with equal text, one.

    Where few rows go and none of their ids is null or names a row that stays, their ids are broadcast and no text is
    shuffled; else rows are joined by id and digest.
    """
    told = materialise(exact_groups(docs, id_col, text_col, most_keys=most_keys).select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), "kept", "group_size"), "exact-told")
    id_, sha_ = fresh(docs, "id", "sha")
    rename = [F.col("id").alias(id_), F.col("sha").alias(sha_)]
    gone = materialise(told.where(~F.col("kept")).select(*rename).distinct(), "exact-gone")
    own, sha = F.col(id_col).cast("long"), F.lower(F.hex(digest_of(normal(text_col))))
    same = own.eqNullSafe(F.col(id_)) & (sha == F.col(sha_))
    alone = gone.count() <= most_keys and gone.where(F.col(id_).isNull()).isEmpty() and told.where("kept").join(F.broadcast(gone.select(F.col(id_).alias("id"))), "id", "left_semi").isEmpty()
    if alone:
        kept = docs.join(F.broadcast(gone.select(id_).distinct()), own == F.col(id_), "left_anti")
    else:
        kept = docs.join(gone.hint("shuffle_hash"), same, "left_anti")
    repeats = materialise(told.where("kept and group_size > 1").groupBy("id", "sha").count().where("count > 1").select(*rename), "exact-repeats")
    if repeats.isEmpty():
        return kept
    named = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), own.alias("i"), sha.alias("s")]
    many = kept.join(repeats, same, "left_semi").select(*named).dropDuplicates(["i", "s"]).select("row.*")
    return kept.join(repeats, same, "left_anti").unionByName(many)
