"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.llm.core import bound_batches, shared_dir
from quaylark.llm.exact_dedup import exact_dedup
from quaylark.llm.language_id import fit, identify
from quaylark.llm.mixing import mix_sample
from quaylark.llm.near_dedup import near_dedup
from quaylark.llm.queries import SENTENCEPIECE_MODEL, public_path
from quaylark.llm.sentencepiece_codec import sentencepiece_encode


#: Of the tokens that reach the mixing stage, how many stay.
MIX_SHARE = 0.5

#: Five stages in a row leave executors little memory: bytes of an Arrow batch (in the JVM and in Python, for each task), and rows that are read at once.
BATCH_BYTES, READ_ROWS = 4 << 20, 512
#: Bytes of a row group (what a task holds until it writes it, and what one of the next stage reads at once), and of one buffer of those reads.
GROUP = {"parquet.block.size": 4 << 20, "parquet.read.allocation.size": 256 << 10}


def bounded(stage):
    """The stage with small batches and row groups, unless the session says otherwise."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark, BATCH_BYTES, READ_ROWS)
        for key, size in GROUP.items():
            if spark.conf.get(key, None) is None:
                spark.conf.set(key, str(size))
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough."""
    return identify(docs, fit(docs), host=F.col("source"), carry=True)


@bounded
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup(docs)


@bounded
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (shingles of five words, similarity 0.8 or more), the document with the smallest id."""
    return near_dedup(docs)


@bounded
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens by the target weights of sources, languages and topics; small cells are kept whole."""
    return mix_sample(docs, share=MIX_SHARE)


@bounded
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document."""
    return sentencepiece_encode(docs, public_path(SENTENCEPIECE_MODEL))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: No SQL: language models and SimHash can't be expressed; tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    Null and empty texts fit no language and go in the first stage; null ids, sources and languages are values like any
    other (a null id takes no part in near dedup and stays); extra columns are carried to the last stage; an empty
    table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
