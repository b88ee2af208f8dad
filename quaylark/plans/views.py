"""Stand-in tables over the driver's tables: the same definitions for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import sql_uint64, track_id
from ..functions.paths import source_id
from ..operators.catalogue import assign_codes

SEED = 1337


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def paths(spark, sf_dir) -> DataFrame:
    """doc_id, path, track_id, duration: columns of documents without their texts."""
    d = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", "source", path.alias("path"), track_id(path).alias("track_id"), (F.col("n_chars") / F.lit(100.0)).alias("duration"))


PATHS = """paths AS (SELECT doc_id, source, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
 left(sha256(source || '/' || CAST(doc_id AS VARCHAR) || '.txt'), 20) AS track_id, n_chars / CAST(100.0 AS DOUBLE) AS duration FROM documents)"""


def tracks(spark, sf_dir) -> DataFrame:
    """paths with five-digit codes in hash order."""
    return assign_codes(paths(spark, sf_dir), SEED)


def hash_order(*parts: str) -> str:
    return f"left(sha256(concat_ws(':', {', '.join(parts)})), 16)"


TRACKS = f"""{PATHS},
tracks AS (SELECT *, CASE WHEN r < 100000 THEN lpad(CAST(r AS VARCHAR), 5, '0') END AS code FROM
 (SELECT *, row_number() OVER (ORDER BY {hash_order(f"'{SEED}'", 'track_id', "'code'")}, track_id) - 1 AS r FROM paths))"""


def waves(spark, sf_dir) -> DataFrame:
    """Embeddings as waveforms: wave_id, samples ARRAY<DOUBLE>, room, split."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("wave_id"), F.col("embedding").cast("array<double>").alias("samples"), F.col("label").alias("room"), F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"))


WAVES = """waves AS (SELECT vec_id AS wave_id, CAST(embedding AS DOUBLE[]) AS samples, label AS room, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM embeddings)"""


def codes(spark, sf_dir) -> DataFrame:
    """Embeddings as raw codes of eight books by eight frames."""
    w = waves(spark, sf_dir)
    code = F.transform("samples", lambda v: F.greatest(F.lit(0), F.least(F.lit(1023), F.floor((v + 1) * 512).cast("int"))))
    return w.select("wave_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda q: F.slice(code, q * 8 + 1, 8)).alias("codes"))


CODES = f"""{WAVES},
codes AS (SELECT wave_id, list_transform(range(8), lambda q: list_transform(range(8), lambda t: greatest(0, least(1023, CAST(floor((samples[q * 8 + t + 1] + 1) * 512) AS INTEGER))))) AS codes FROM waves)"""


def ranks(spark, sf_dir) -> DataFrame:
    """Line items as result rows."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice", "l_discount", "l_partkey", "l_suppkey")
    return li.select(
        F.col("l_orderkey").alias("query_id"), F.when(F.col("l_quantity") <= 40, F.col("l_linenumber")).alias("rank"), (F.col("l_tax") == 0.08).alias("failed"),
        F.concat("l_returnflag", "l_linestatus").alias("suite_id"), (F.col("l_extendedprice") / 1e5).alias("latency"), F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("view_type"),
        (F.col("l_discount") * 100).cast("int").alias("snr"), F.col("l_linenumber").alias("line"),
        (F.col("l_linenumber") * F.lit(10**15) + F.col("l_partkey") * F.lit(10**6) + F.col("l_suppkey")).alias("written"),
    )


RANKS = """ranks AS (SELECT l_orderkey AS query_id, CASE WHEN l_quantity <= 40 THEN l_linenumber END AS rank, l_tax = 0.08 AS failed, l_returnflag || l_linestatus AS suite_id,
 l_extendedprice / 1e5 AS latency, l_returnflag AS condition, l_linestatus AS view_type, CAST(trunc(l_discount * 100) AS INTEGER) AS snr, l_linenumber AS line,
 l_linenumber * 1000000000000000 + l_partkey * 1000000 + l_suppkey AS written FROM lineitem)"""


def log(spark, sf_dir) -> DataFrame:
    """Events as a training log with repeated steps."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    return e.select((F.unix_timestamp("ts") / 60).cast("long").alias("step"), F.col("event_id").alias("line"), F.col("event_type").alias("metric"), "value")


LOG = "log AS (SELECT CAST(floor(epoch(ts) / 60) AS BIGINT) AS step, event_id AS line, event_type AS metric, value FROM events)"


def assets(spark, sf_dir) -> DataFrame:
    """Parts as corpus files."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_name", "p_size")
    clean = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")
    return p.select("p_partkey", F.concat_ws("/", clean("p_brand"), clean("p_type"), F.concat(clean("p_name"), F.lit("_deg"), ((F.col("p_size") % 12) * 30).cast("string"), F.lit(".wav"))).alias("path"), (F.col("p_size") / F.lit(10.0)).alias("duration"), F.col("p_size").alias("label"), F.col("p_brand").alias("brand"))


ASSETS = r"""assets AS (SELECT p_partkey, regexp_replace(lower(p_brand), '[^a-z0-9]+', '_', 'g') || '/' || regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g') || '/' || regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g')
 || '_deg' || CAST(p_size % 12 * 30 AS VARCHAR) || '.wav' AS path, p_size / CAST(10.0 AS DOUBLE) AS duration, p_size AS label, p_brand AS brand FROM part)"""


def copies(spark, sf_dir) -> DataFrame:
    """Documents as assets with content digests; a keyed split."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    h = F.substring(F.sha2(F.concat(F.lit("split:"), F.col("doc_id").cast("string")), 256), 1, 1)
    return d.select(F.sha2("text", 256).alias("digest"), F.col("source").alias("collection"), F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("relative"), F.when(h < "4", "test").otherwise("train").alias("split"))


COPIES = """copies AS (SELECT sha256(text) AS digest, source AS collection, 'f' || CAST(doc_id % 3 AS VARCHAR) AS relative,
 CASE WHEN left(sha256('split:' || CAST(doc_id AS VARCHAR)), 1) < '4' THEN 'test' ELSE 'train' END AS split FROM documents)"""


def external(spark, sf_dir) -> DataFrame:
    """Pages as an external corpus listing with normalised source ids."""
    p = table(spark, sf_dir, "pages", "page_id", "url")
    return p.select("page_id", source_id(F.regexp_replace("url", "[?#].*$", "")).alias("source_id"))


EXTERNAL = r"""stems AS (SELECT page_id, CASE WHEN length(regexp_replace(b, '(.)\.[^.]*$', '\1')) > 0 THEN regexp_replace(b, '(.)\.[^.]*$', '\1') ELSE b END AS s FROM
 (SELECT page_id, list_extract(string_split(regexp_replace(url, '[?#].*$', ''), '/'), -1) AS b FROM pages)),
external AS (SELECT page_id, CASE WHEN regexp_full_match(s, '[0-9]+') THEN CASE WHEN length(s) < 6 THEN lpad(s, 6, '0') ELSE s END END AS source_id FROM stems)"""


def u64(*parts: str) -> str:
    return sql_uint64(*parts)
