"""Queries of the operators with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import collocations, collocations_sql
from .embedding_dedup import embedding_components
from .exact_dedup import exact_groups
from .language_id import fit, identify
from .license_scan import license_scan
from .lm_scoring import lm_scores
from .mixing import SHARE, mix_sql, mix_weights
from .quality_ranker import quality
from .sentencepiece_codec import sentencepiece_encode
from .simhash import simhash_components
from .spelling_variants import spelling_variants, variants_sql
from .token_output import token_output
from .toxicity import toxicity

END_ID = 2
SENTENCEPIECE_MODEL = "piece_bpe_32k.model"
TOKENIZER = "byte_bpe_50k.json"
#: Character references of HTML that text has most; others become spaces.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß", "ntilde": "ñ", "aacute": "á",
    "iacute": "í", "oacute": "ó", "uacute": "ú", "ecirc": "ê", "acirc": "â", "ocirc": "ô", "amp": "&",
}


def public_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, table(spark, sf_dir, "labels"), train_rows=lambda i: remainder(i, 5) != 0)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_encode(table(spark, sf_dir, "documents"), public_path(SENTENCEPIECE_MODEL))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    declared = F.regexp_extract("text", r"<html[^>]{0,200}\blang=[\"']?([A-Za-z]{2,3})", 1)
    return identify(docs, fit(docs), host=F.col("source"), markup=declared)


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of web pages: text without tags, declared markup language, host and address suffix."""
    pages = table(spark, sf_dir, "pages")
    text = F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    for name, sign in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    text = F.regexp_replace(text, r"&#?[A-Za-z0-9]{1,32};", " ")
    rows = pages.select("page_id", text.alias("text"), F.lower(F.parse_url("url", F.lit("HOST"))).alias("host"), F.regexp_extract("html", r"<html[^>]{0,200}\blang=[\"']?([A-Za-z]{2,3})", 1).alias("declared"))
    model = fit(table(spark, sf_dir, "documents"))
    return identify(rows, model, id_col="page_id", host=F.col("host"), markup=F.col("declared"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), lambda i: remainder(i, 7) != 2)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_weights(table(spark, sf_dir, "documents"), share=SHARE)
    return rows.withColumns({"weight": F.round("weight", 9), "probability": F.round("probability", 9)})


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), public_path(TOKENIZER), END_ID)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality(docs, table(spark, sf_dir, "labels"), train_rows=lambda i: remainder(i, 3) != 1)
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_mixing": op9_mixing,
    "op10_token_output": op10_token_output,
    "op11_collocations": op11_collocations,
    "op12_quality": op12_quality,
    "op13_spelling_variants": op13_spelling_variants,
    "pages_language_id": pages_language_id,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op3_exact_dedup": f"""
WITH r AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM r""",
    "op9_mixing": f"SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(weight, 9) AS weight, round(probability, 9) AS probability, kept FROM ({mix_sql()})",
    "op11_collocations": collocations_sql(),
    "op13_spelling_variants": variants_sql(),
}
