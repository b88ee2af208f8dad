"""Queries over result rows: retrieval metrics, manifests, resume, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import source_id
from ..operators import catalogue, evaluation, metrics, quality, ranking
from . import views as v
from .registry import Registry

query = Registry()

_METRICS = """count(*) AS selected, count(*) FILTER (NOT failed) AS evaluated, count(*) FILTER (failed) AS failed,
 count(*) FILTER (NOT failed AND rank <= 1) / count(*) AS top1, count(*) FILTER (NOT failed AND rank <= 5) / count(*) AS top5, count(*) FILTER (NOT failed AND rank <= 10) / count(*) AS top10,
 round(sum(CASE WHEN failed THEN 0 ELSE coalesce(1.0::DOUBLE / rank, 0) END) / count(*), 9) AS mrr, round(sum(latency), 6) AS elapsed, round(count(*) FILTER (NOT failed) / sum(latency), 6) AS qps"""


def _rounded(df):
    return df.withColumns({"mrr": F.round("mrr", 9), "elapsed": F.round("elapsed", 6), "qps": F.round("qps", 6)})


@query(f"WITH {v.RANKS} SELECT suite_id, {_METRICS} FROM ranks GROUP BY suite_id")
def retrieval_metrics_by_suite(spark, sf):
    return _rounded(metrics.joint_metrics(v.ranks(spark, sf), ["suite_id"]))


@query(f"WITH {v.RANKS} SELECT suite_id, snr, {_METRICS} FROM ranks GROUP BY suite_id, snr")
def retrieval_metrics_by_suite_length(spark, sf):
    return _rounded(metrics.joint_metrics(v.ranks(spark, sf), ["suite_id", "snr"]))


@query(f"""WITH {v.RANKS} SELECT condition, view_type, snr, CAST(grouping(condition, view_type, snr) AS BIGINT) AS level, count(*) AS queries,
 avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS top1, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 9) AS mrr
 FROM ranks WHERE NOT failed GROUP BY GROUPING SETS ((condition), (condition, view_type), (condition, snr), ())""")
def retrieval_metrics_grouping_sets(spark, sf):
    rows = v.ranks(spark, sf).where(~F.col("failed"))
    r = F.col("rank")
    aggs = [F.count(F.lit(1)).alias("queries"), F.avg(metrics.hit(r, 1)).alias("top1"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 9).alias("mrr")]
    return metrics.grouped_levels(rows, [["condition"], ["condition", "view_type"], ["condition", "snr"], []], aggs, ["condition", "view_type", "snr"])


@query(f"""WITH {v.RANKS}, b AS (SELECT suite_id, query_id, list(lpad(CAST(snr * 7919 + line AS VARCHAR), 5, '0') ORDER BY written) AS beam, lpad(CAST(max(snr) * 7919 + max(line) AS VARCHAR), 5, '0') AS code FROM ranks GROUP BY ALL),
 r AS (SELECT *, nullif(coalesce(list_position(beam, code), 0), 0) AS r FROM b)
 SELECT suite_id, count(*) AS queries, avg(CASE WHEN beam[1] = code THEN 1.0::DOUBLE ELSE 0 END) AS greedy_top1, avg(CASE WHEN query_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS invalid_code_rate,
 avg(CASE WHEN r <= 1 THEN 1.0::DOUBLE ELSE 0 END) AS top1, avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END) AS top5, avg(CASE WHEN r <= 10 THEN 1.0::DOUBLE ELSE 0 END) AS top10, round(avg(coalesce(1.0::DOUBLE / r, 0)), 9) AS mrr FROM r GROUP BY suite_id""")
def generation_metrics(spark, sf):
    code = lambda s, n: F.lpad((s * 7919 + n).cast("string"), 5, "0")
    rows = v.ranks(spark, sf).groupBy("suite_id", "query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("written", code(F.col("snr"), F.col("line")).alias("c")))), lambda x: x["c"]).alias("beam"), code(F.max("snr"), F.max("line")).alias("code"))
    rows = rows.withColumn("greedy", F.element_at("beam", 1)).withColumn("ended", F.col("query_id") % 3 != 0)
    return metrics.generation_metrics(rows, ["suite_id"]).withColumn("mrr", F.round("mrr", 9))


@query(f"WITH {v.RANKS} SELECT suite_id, round(sum(CASE WHEN rank <= 1 THEN 1 ELSE 0 END) / CAST(sum(line) AS DOUBLE), 9) AS exact FROM ranks GROUP BY suite_id")
def conditional_exact_accuracy(spark, sf):
    rows = v.ranks(spark, sf).withColumn("hits", F.when(F.col("rank") <= 1, 1).otherwise(0))
    return metrics.weighted_mean(rows, ["suite_id"], "hits", "line", "exact").withColumn("exact", F.round("exact", 9))


@query(f"WITH {v.RANKS} SELECT round(exp(least(20.0, avg(latency) * 10)), 6) AS perplexity, round(exp(least(ln(1e6), avg(latency) * 100)), 4) AS clamped FROM ranks")
def mean_perplexity(spark, sf):
    rows = v.ranks(spark, sf)
    m = F.avg("latency")
    return rows.agg(F.round(metrics.perplexity(m * 10), 6).alias("perplexity"), F.round(metrics.perplexity(m * 100, 13.815510557964274), 4).alias("clamped"))


@query(f"WITH {v.RANKS} SELECT count(*) AS documents, CAST(sum(line) AS BIGINT) AS tokens, round(sum(line) / sum(latency), 6) AS tokens_per_second FROM ranks")
def throughput(spark, sf):
    rows = v.ranks(spark, sf).select(F.col("line").cast("long").alias("line"), "latency")
    return metrics.throughput(rows, "line", "latency").withColumn("tokens_per_second", F.round("tokens_per_second", 6))


_G = lambda x: f"format('{{:g}}', {x})"
_SUITES = "suites AS (SELECT pos + 3 * r AS suite_pos, r = 1 AS rir, lo AS snr_low, hi AS snr_high, CASE WHEN r = 1 THEN 'noise_rir' ELSE 'noise' END || '_' || format('{:g}', lo) || '_' || format('{:g}', hi) || 'db' AS suite_id FROM (VALUES (0, 0::DOUBLE, 5::DOUBLE), (1, 5, 10), (2, 10, 20)) t(pos, lo, hi), (VALUES (0), (1)) s(r))"


@query(f"WITH {_SUITES} SELECT * FROM suites")
def degradation_suites(spark, sf):
    return evaluation.suites(spark)


_RECIPES = f"""{v.TRACKS},
{v.EXTERNAL},
cohort AS (SELECT track_id, code, path, duration, CASE WHEN doc_id < 1000000 THEN lpad(CAST(doc_id AS VARCHAR), 6, '0') ELSE CAST(doc_id AS VARCHAR) END AS source_id FROM tracks),
excluded AS (SELECT DISTINCT source_id FROM external WHERE source_id IS NOT NULL),
allowed AS (SELECT * FROM cohort WHERE source_id NOT IN (SELECT source_id FROM excluded) AND duration >= 2.0),
recipes AS (SELECT *, CASE WHEN CAST(floor((duration - 2.0) * 100) AS BIGINT) <= 0 THEN 0 ELSE CAST({v.u64(str(v.SEED), 'track_id', "'joint-query-start'", "'crop-start'")} % CAST(greatest(CAST(floor((duration - 2.0) * 100) AS BIGINT), 0) + 1 AS UBIGINT) AS BIGINT) END AS start_sample
 FROM (SELECT *, row_number() OVER (ORDER BY {v.hash_order(f"'{v.SEED}'", 'track_id', "'joint'")}, track_id) - 1 AS query_pos FROM allowed) WHERE query_pos < 100)"""


def _recipes(spark, sf):
    cohort = v.tracks(spark, sf).select("track_id", "code", "path", "duration", source_id(F.col("path")).alias("source_id"))
    ids, _ = evaluation.exclusion(v.external(spark, sf), "source_id")
    return evaluation.manifest(cohort, ids, 100, v.SEED, 2.0, 100)


@query(f"WITH {_RECIPES} SELECT track_id, code, query_pos, start_sample FROM recipes")
def joint_manifest(spark, sf):
    """The paper protocol's query count is a stated limit of the manifest."""
    return _recipes(spark, sf)[0].select("track_id", "code", "query_pos", "start_sample")


@query(f"WITH {_RECIPES} SELECT track_id, source_id FROM cohort WHERE source_id IN (SELECT source_id FROM excluded)")
def manifest_exclusions(spark, sf):
    return _recipes(spark, sf)[1]


@query(f"WITH {v.EXTERNAL} SELECT count(DISTINCT source_id) AS ids, count(*) FILTER (source_id IS NULL) AS ignored FROM external")
def external_exclusion(spark, sf):
    ids, ignored = evaluation.exclusion(v.external(spark, sf), "source_id")
    return ids.agg(F.count(F.lit(1)).alias("ids")).crossJoin(ignored)


@query(f"""WITH {_RECIPES}, {_SUITES} SELECT track_id || '__' || suite_id || '__' || format('{{:g}}', s) || 's' AS id, track_id, suite_id, s AS query_seconds,
 round(snr_low + CAST({v.u64(str(v.SEED), 'track_id', "'paper-snr-range'", _G('snr_low'), _G('snr_high'))} AS DOUBLE) / pow(2.0, 64) * (snr_high - snr_low), 9) AS snr_db FROM recipes, suites, (VALUES (2::DOUBLE), (5), (10)) l(s)""")
def corpus_cross_product(spark, sf):
    out = evaluation.query_corpus(_recipes(spark, sf)[0], evaluation.suites(spark), v.SEED)
    return out.select("id", "track_id", "suite_id", "query_seconds", F.round("snr_db", 9).alias("snr_db"))


@query(f"""WITH {v.RANKS}, done AS (SELECT DISTINCT query_id, snr, suite_id FROM ranks WHERE line <= 2 AND NOT failed)
 SELECT suite_id, count(*) AS pending FROM ranks r WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.query_id = r.query_id AND d.snr = r.snr AND d.suite_id = r.suite_id) GROUP BY suite_id""")
def resume_pending(spark, sf):
    rows = v.ranks(spark, sf)
    left = evaluation.pending(rows, rows.where("line <= 2 and not failed"), ("query_id", "snr", "suite_id"))
    return left.groupBy("suite_id").agg(F.count(F.lit(1)).alias("pending"))


@query(f"WITH {v.RANKS} SELECT query_id, snr, suite_id, count(*) AS n FROM ranks GROUP BY ALL HAVING count(*) > 1")
def duplicate_result_keys(spark, sf):
    return catalogue.duplicates(v.ranks(spark, sf), ["query_id", "snr", "suite_id"])


@query(f"WITH {v.RANKS} SELECT query_id, line, suite_id FROM ranks WHERE suite_id IS DISTINCT FROM 'NO'")
def foreign_protocol_rows(spark, sf):
    rows = v.ranks(spark, sf).withColumn("at", F.struct("query_id", "line"))
    return quality.foreign(rows, "suite_id", "NO", "at").select("at.query_id", "at.line", "suite_id")


@query(f"""WITH {v.RANKS}, l AS (SELECT suite_id, query_id, arg_max_null(rank, written) AS rank, arg_max_null(failed, written) AS failed FROM ranks GROUP BY ALL)
 SELECT suite_id, count(*) AS queries, count(*) FILTER (failed) AS failures, count(*) FILTER (rank = 1) AS hits FROM l GROUP BY suite_id""")
def latest_results(spark, sf):
    last = ranking.latest(v.ranks(spark, sf), ["suite_id", "query_id"], "written")
    return last.groupBy("suite_id").agg(F.count(F.lit(1)).alias("queries"), F.count_if("failed").alias("failures"), F.count_if(F.col("rank") == 1).alias("hits"))


@query("""WITH q AS (SELECT n_nationkey AS k, n_name AS a FROM nation), m AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 7 = 0 THEN upper(n_name) || '*' ELSE n_name END AS b FROM nation WHERE n_nationkey % 11 <> 5)
 SELECT CAST(coalesce(q.k, m.k) AS VARCHAR) AS key, a AS "left", b AS "right" FROM q FULL JOIN m USING (k) WHERE a IS DISTINCT FROM b""")
def metadata_differences(spark, sf):
    n = v.table(spark, sf, "nation")
    a = n.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))
    other = F.when(F.col("n_nationkey") % 7 == 0, F.concat(F.upper("n_name"), F.lit("*"))).otherwise(F.col("n_name"))
    return quality.metadata_differences(a, n.where("n_nationkey % 11 <> 5").select(F.col("n_nationkey").cast("string").alias("key"), other.alias("value")))


QUERIES, ORACLES = query.queries, query.oracles
