"""Queries of ranked decoding, documents and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import Vocabulary
from ..operators import decode, losses, quality
from . import views as v
from .registry import Registry

query = Registry()
SCORER = decode.HashScorer(5)
VOCAB = Vocabulary(8)


def _beam_sql(windows: str, width: int, steps: int = 5) -> str:
    """Chained steps of the beam over a table `windows` (query_id, window_id)."""
    parts = [f"win AS ({windows})", "b0 AS (SELECT DISTINCT query_id, '' AS prefix, 0.0::DOUBLE AS score FROM win)"]
    for k in range(1, steps + 1):
        parts.append(
            f"""l{k} AS (SELECT query_id, window_id, prefix, score, d, {SCORER.sql('query_id', 'window_id', 'prefix', 'd')} AS x FROM win JOIN b{k - 1} USING (query_id), range(10) t(d)),
n{k} AS (SELECT *, x - (max(x) OVER w + ln(sum(exp(x)) OVER w) - max(x) OVER w) AS lp FROM l{k} WINDOW w AS (PARTITION BY query_id, window_id, prefix)),
c{k} AS (SELECT query_id, prefix || d AS prefix, round(any_value(score) + avg(lp), 12) AS score FROM n{k} GROUP BY query_id, prefix, d),
b{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prefix) AS rank FROM c{k}) WHERE rank <= {min(width, 10**k)})"""
        )
    return "WITH " + ",\n".join(parts)


_ONE = "SELECT vec_id AS query_id, 0 AS window_id FROM embeddings"
_THREE = "SELECT vec_id AS query_id, w AS window_id FROM embeddings, range(3) t(w)"


def _queries(spark, sf):
    return v.table(spark, sf, "embeddings", "vec_id").select(F.col("vec_id").alias("query_id"))


@query(_beam_sql(_ONE, 1) + " SELECT query_id, prefix AS code, round(score, 6) AS score FROM b5")
def greedy_decode(spark, sf):
    return decode.greedy(_queries(spark, sf), SCORER).select("query_id", "code", F.round("score", 6).alias("score"))


@query(_beam_sql(_ONE, 5) + " SELECT query_id, prefix AS code, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM b5")
def beam_decode(spark, sf):
    return decode.beam(_queries(spark, sf), SCORER, 5).withColumn("score", F.round("score", 6))


@query(_beam_sql(_THREE, 10) + " SELECT query_id, prefix AS code, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM b5")
def joint_beam_decode(spark, sf):
    windows = _queries(spark, sf).withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return decode.joint_beam(windows, SCORER, 10).withColumn("score", F.round("score", 6))


_END = f"""e AS (SELECT query_id, window_id, prefix, score, {SCORER.end_sql('query_id', 'window_id', 'prefix')} AS x, 10 AS d FROM win JOIN b5 USING (query_id) UNION ALL SELECT query_id, window_id, prefix, score, 0.5::DOUBLE, 11 FROM win JOIN b5 USING (query_id)
 UNION ALL SELECT query_id, window_id, prefix, score, {SCORER.sql('query_id', 'window_id', 'prefix', 'd')}, d FROM win JOIN b5 USING (query_id), range(10) t(d)),
 p AS (SELECT *, x - ln(sum(exp(x)) OVER (PARTITION BY query_id, window_id, prefix)) AS lp FROM e), m AS (SELECT query_id, prefix, d, any_value(score) AS score, avg(lp) AS lp FROM p GROUP BY query_id, prefix, d),
 z AS (SELECT query_id, prefix, any_value(score) AS score, max(lp) FILTER (d = 10) AS stop, max(lp) AS top FROM m GROUP BY query_id, prefix)"""


@query(_beam_sql(_THREE, 10) + f", {_END} SELECT query_id, prefix AS code, round(round(score + stop, 12), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score + stop, 12) DESC, prefix) AS INTEGER) AS rank, true AS ended FROM z")
def joint_beam_with_end(spark, sf):
    """The end is scored inside the search and decides the order."""
    windows = _queries(spark, sf).withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return decode.joint_beam(windows, SCORER, 10, ends="score").withColumn("score", F.round("score", 6))


@query(_beam_sql(_ONE, 5) + f", {_END} SELECT query_id, prefix AS code, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prefix) AS INTEGER) AS rank, stop >= top AS ended FROM z")
def beam_end_validity(spark, sf):
    """Whether each code of the beam would end next."""
    return decode.beam(_queries(spark, sf), SCORER, 5, ends="flag").withColumn("score", F.round("score", 6))


_FLAT = "flat AS (SELECT wave_id, flatten(list_transform(range(8), lambda t: list_transform(range(8), lambda q: CAST(codes[q + 1][t + 1] + q * 1024 AS INTEGER)))) AS tokens FROM codes)"
_JOIN = lambda x: f"array_to_string({x}, ' ')"


def _flat(spark, sf):
    return v.codes(spark, sf).select("wave_id", "codes", VOCAB.flatten(F.col("codes")).cast("array<int>").alias("tokens"))


@query(f"WITH {v.CODES}, {_FLAT} SELECT wave_id, {_JOIN('tokens')} AS tokens, true AS layout, true AS round_trip FROM flat")
def flatten_tokens(spark, sf):
    back = VOCAB.unflatten(F.col("tokens"))
    out = _flat(spark, sf).select("wave_id", F.array_join("tokens", " ").alias("text"), VOCAB.layout_ok(F.col("tokens")).alias("layout"), (F.to_json(back) == F.to_json("codes")).alias("round_trip"))
    return out.withColumnRenamed("text", "tokens")


_CODE = "lpad(CAST(wave_id % 100000 AS VARCHAR), 5, '0')"
_DIGITS = f"list_transform(range(5), lambda i: CAST(substr({_CODE}, i + 1, 1) AS INTEGER) + 8194)"


@query(f"""WITH {v.CODES}, {_FLAT} SELECT wave_id, {_JOIN(f"list_concat([8192], tokens, [8193], {_DIGITS}, [8204])")} AS ids, len(tokens) AS audio_labels, 5 AS digit_labels, 2 AS boundary_labels, len(tokens) + 1 AS first_digit FROM flat""")
def causal_documents(spark, sf):
    code = F.lpad((F.col("wave_id") % 100_000).cast("string"), 5, "0")
    masks = VOCAB.masks(F.size("tokens"))
    n = lambda m: F.size(F.filter(masks[m], lambda x: x))
    doc = _flat(spark, sf).select("wave_id", F.array_join(VOCAB.document(F.col("tokens"), code), " ").alias("ids"), n("audio").cast("long").alias("audio_labels"), n("digits").alias("digit_labels"), n("boundary").alias("boundary_labels"), F.array_position(masks["digits"], True).alias("p"))
    return doc.select("wave_id", "ids", "audio_labels", "digit_labels", "boundary_labels", (F.col("p") - 1).alias("first_digit"))


@query(f"WITH {v.CODES}, {_FLAT} SELECT wave_id, {_JOIN('list_concat([8192], tokens, [8193])')} AS prompt, {_CODE} AS code FROM flat")
def prompts(spark, sf):
    code = F.lpad((F.col("wave_id") % 100_000).cast("string"), 5, "0")
    return _flat(spark, sf).select("wave_id", F.array_join(VOCAB.prompt(F.col("tokens")), " ").alias("prompt"), VOCAB.decode_code(VOCAB.encode_code(code)).alias("code"))


@query(f"WITH {v.CODES}, {_FLAT} SELECT wave_id, wave_id // 64 AS shard, CAST((sum(len(tokens)) OVER (PARTITION BY wave_id // 64 ORDER BY wave_id)) - len(tokens) AS BIGINT) AS token_offset, len(tokens) AS token_count FROM flat")
def shard_offsets(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("shard").orderBy("wave_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = _flat(spark, sf).select("wave_id", F.floor(F.col("wave_id") / 64).alias("shard"), F.size("tokens").cast("long").alias("token_count"))
    return rows.select("wave_id", "shard", F.coalesce(F.sum("token_count").over(w), F.lit(0)).alias("token_offset"), "token_count")


@query(f"""WITH {v.CODES}, {_FLAT}, s AS (SELECT wave_id, CASE WHEN wave_id % 17 = 0 THEN list_concat(tokens, [9000]) ELSE tokens END AS tokens, len(tokens) AS n, wave_id % 13 - 1 AS off, CASE WHEN wave_id % 19 = 0 THEN 'other' ELSE 'train' END AS role FROM flat)
 SELECT wave_id, 'count' AS rule FROM s WHERE len(tokens) <> n UNION ALL SELECT wave_id, 'vocabulary' FROM s WHERE len(list_filter(tokens, lambda t: t < 0 OR t >= 8205)) > 0 UNION ALL SELECT wave_id, 'role' FROM s WHERE role <> 'train' UNION ALL SELECT wave_id, 'span' FROM s WHERE off < 0""")
def shard_violations(spark, sf):
    i = F.col("wave_id")
    rows = _flat(spark, sf).select("wave_id", F.when(i % 17 == 0, F.concat("tokens", F.array(F.lit(9000)))).otherwise(F.col("tokens")).alias("tokens"), F.size("tokens").alias("token_count"), (i % 13 - 1).alias("token_offset"),
                                   F.when(i % 19 == 0, "other").otherwise("train").alias("corpus_role"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    return quality.violations(rows, "wave_id", quality.token_rules(VOCAB.total, "train"))


_LOGITS = f"logits AS (SELECT wave_id, p, list_transform(range(10), lambda d: samples[(p * 5 + d) % 64 + 1] * 4) AS x, (wave_id + p) % 10 AS target FROM waves, range(8) t(p))"
_CE = "-(x[target + 1] - (list_max(x) + ln(list_sum(list_transform(x, lambda y: exp(y - list_max(x)))))))"
_FAMILY = "CASE WHEN p < 5 THEN 'digits' WHEN p < 7 THEN 'audio' ELSE 'boundary' END"


def _logits(spark, sf):
    rows = v.waves(spark, sf).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(7))))
    x = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.element_at("samples", ((F.col("p") * 5 + d) % 64 + 1).cast("int")) * 4)
    rows = rows.select("wave_id", "p", x.alias("x"), ((F.col("wave_id") + F.col("p")) % 10).cast("int").alias("target"), "split")
    fam = F.when(F.col("p") < 5, "digits").when(F.col("p") < 7, "audio").otherwise("boundary")
    return rows.withColumn("loss", losses.cross_entropy(F.col("x"), F.col("target"))).withColumn("family", fam).withColumn("correct", F.array_position("x", F.array_max("x")) - 1 == F.col("target"))


@query(f"WITH {v.WAVES}, {_LOGITS} SELECT wave_id, CAST(p AS INTEGER) AS p, round({_CE}, 9) AS loss FROM logits")
def token_losses(spark, sf):
    return _logits(spark, sf).select("wave_id", "p", F.round("loss", 9).alias("loss"))


_TOK = f"tok AS (SELECT wave_id, p, target, {_CE} AS loss, {_FAMILY} AS family, list_position(x, list_max(x)) - 1 = target AS correct FROM logits)"


@query(f"""WITH {v.WAVES}, {_LOGITS}, {_TOK} SELECT family_key, round(sum(loss * w) / sum(w), 9) AS loss, round(avg(loss) FILTER (family = 'audio'), 9) AS audio_loss, round(avg(loss) FILTER (family = 'digits'), 9) AS digit_loss, round(avg(loss) FILTER (family = 'boundary'), 9) AS boundary_loss,
 round(exp(least(avg(loss) FILTER (family = 'audio'), ln(1e6))), 6) AS audio_perplexity, round(avg(CASE WHEN correct THEN 1.0::DOUBLE ELSE 0 END) FILTER (family = 'digits'), 9) AS digit_accuracy
 FROM (SELECT *, wave_id % 4 AS family_key, CASE WHEN family = 'digits' THEN 32.0::DOUBLE ELSE 1 END AS w FROM tok) GROUP BY family_key""")
def family_loss(spark, sf):
    out = losses.family_losses(_logits(spark, sf).withColumn("family_key", F.col("wave_id") % 4), ["family_key"], 32.0)
    return out.withColumns({c: F.round(c, 6 if c == "audio_perplexity" else 9) for c in out.columns[1:]})


@query(f"WITH {v.WAVES}, {_LOGITS}, {_TOK}, e AS (SELECT wave_id, bool_and(correct) AS x FROM tok WHERE family = 'digits' AND p < 2 GROUP BY wave_id) SELECT wave_id % 4 AS k, avg(CASE WHEN x THEN 1.0::DOUBLE ELSE 0 END) AS exact_accuracy FROM e GROUP BY k")
def exact_accuracy(spark, sf):
    return losses.exact_accuracy(_logits(spark, sf).where("p < 2").withColumn("k", F.col("wave_id") % 4), "wave_id", ["k"])


@query(f"WITH {v.WAVES}, {_LOGITS}, {_TOK}, m AS (SELECT wave_id % 2 AS view, avg(loss) AS m FROM tok GROUP BY view) SELECT round(avg(m), 9) AS loss FROM m")
def loss_by_view(spark, sf):
    return losses.by_view(_logits(spark, sf).withColumn("view", F.col("wave_id") % 2), "view", "loss").withColumn("loss", F.round("loss", 9))


@query(f"""WITH {v.WAVES}, {_LOGITS}, {_TOK}, a AS (SELECT avg(loss) FILTER (family = 'audio' AND wave_id % 3 <> 0) AS audio, avg(loss) FILTER (family = 'digits') AS digits, avg(loss) FILTER (family = 'boundary') AS boundary, avg(loss) FILTER (family = 'digits' AND wave_id % 3 = 0) AS degraded_digits,
 count(*) FILTER (family = 'audio') AS na, count(*) FILTER (family = 'digits') AS nd, count(*) FILTER (family = 'boundary') AS nb FROM tok)
 SELECT round(audio, 9) AS audio, round(digits, 9) AS digits, round(boundary, 9) AS boundary, round(degraded_digits, 9) AS degraded_digits, round((na * audio + 32 * nd * digits + nb * boundary) / (na + 32 * nd + nb), 9) AS loss FROM a""")
def degraded_loss(spark, sf):
    out = losses.degraded_losses(_logits(spark, sf).withColumn("degraded", F.col("wave_id") % 3 == 0), 32.0)
    return out.withColumns({c: F.round(c, 9) for c in out.columns})


@query(f"""WITH {v.WAVES}, {_LOGITS}, x AS (SELECT wave_id, p, list_transform(x, lambda y: y / 2.0) AS t, list_transform(range(10), lambda d: x[(d + 1) % 10 + 1] / 2.0) AS s FROM logits WHERE p < 5),
 n AS (SELECT wave_id, list_transform(t, lambda y: y - (list_max(t) + ln(list_sum(list_transform(t, lambda z: exp(z - list_max(t))))))) AS t, list_transform(s, lambda y: y - (list_max(s) + ln(list_sum(list_transform(s, lambda z: exp(z - list_max(s))))))) AS s FROM x)
 SELECT wave_id % 4 AS k, round(avg(list_sum(list_transform(range(1, 11), lambda i: exp(t[i]) * (t[i] - s[i])))) * 4, 9) AS kd_loss FROM n GROUP BY k""")
def kd_loss(spark, sf):
    rows = _logits(spark, sf).where("p < 5").withColumn("k", F.col("wave_id") % 4)
    turned = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.element_at("x", (d + 1) % 10 + 1))
    rows = rows.select("k", F.col("x").alias("teacher"), turned.alias("student"))
    return losses.distillation(rows, ["k"], 2.0).withColumn("kd_loss", F.round("kd_loss", 9))


QUERIES, ORACLES = query.queries, query.oracles
