"""Queries of corpus preparation and of training curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import corpus, curves, metrics, sampling
from . import views as v
from .registry import Registry

query = Registry()
S = 27


@query(f"WITH {v.COPIES} SELECT digest, arg_min(collection, k) AS collection, arg_min(relative, k) AS relative, arg_min(split, k) AS split, count(*) AS copies FROM (SELECT *, (CASE WHEN split <> 'test' THEN '1' ELSE '0' END) || '|' || rpad(collection, 20, ' ') || '|' || relative AS k FROM copies) GROUP BY digest")
def exact_dedupe_keeper(spark, sf):
    return corpus.dedupe_keepers(v.copies(spark, sf))


_KEEP = "keep AS (SELECT digest, arg_min(split || '/' || collection || '/' || relative, k) AS kept, arg_min(split, k) AS kept_split FROM (SELECT *, (CASE WHEN split <> 'test' THEN '1' ELSE '0' END) || '|' || rpad(collection, 20, ' ') || '|' || relative AS k FROM copies) GROUP BY digest)"


@query(f"WITH {v.COPIES}, {_KEEP} SELECT digest, kept, split || '/' || collection || '/' || relative AS removed, split <> kept_split AS cross_split FROM copies JOIN keep USING (digest) WHERE split || '/' || collection || '/' || relative <> kept")
def dedupe_audit(spark, sf):
    return corpus.dedupe_audit(v.copies(spark, sf))


@query(f"WITH {v.COPIES} SELECT digest FROM copies WHERE split = 'test' INTERSECT SELECT digest FROM copies WHERE split = 'train'")
def split_leakage(spark, sf):
    c = v.copies(spark, sf).select("digest", "split")
    return corpus.leakage(c.where("split = 'test'").select("digest"), c.where("split = 'train'").select("digest"))


@query(f"""WITH {v.ASSETS}, a AS (SELECT path FROM assets WHERE p_partkey % 5 <> 0), b AS (SELECT path FROM assets WHERE p_partkey % 7 <> 0)
 SELECT path, 'ONLY OLD' AS side FROM (SELECT path FROM a EXCEPT ALL SELECT path FROM b) UNION ALL SELECT path, 'ONLY NEW' FROM (SELECT path FROM b EXCEPT ALL SELECT path FROM a)""")
def set_diff_report(spark, sf):
    a = v.assets(spark, sf)
    return corpus.difference_report(a.where("p_partkey % 5 <> 0").select("path"), a.where("p_partkey % 7 <> 0").select("path"))


_SPLIT_H = v.hash_order(f"'{S}'", "CAST(p_partkey AS VARCHAR)", "'split'")


@query(f"WITH {v.ASSETS} SELECT p_partkey, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_SPLIT_H}, p_partkey) <= ceil(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM assets")
def stratified_split(spark, sf):
    return sampling.stratified_split(v.assets(spark, sf), "label", "p_partkey", 0.2, S).select("p_partkey", "label", "split")


@query(f"""WITH {v.ASSETS}, g AS (SELECT brand, row_number() OVER (ORDER BY {v.hash_order(f"'{S}'", 'brand', "'group'")}, brand) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT brand FROM assets))
 SELECT p_partkey, brand, CASE WHEN r < ceil(n * 0.25::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM assets JOIN g USING (brand)""")
def group_split(spark, sf):
    return sampling.group_split(v.assets(spark, sf), "brand", 0.25, S).select("p_partkey", "brand", "split")


_MICS = ("brand", "brand_1", "brand_12", "brand_2", "standard")


@query(r"""WITH """ + v.ASSETS + r""", x AS (SELECT *, list_extract(string_split(path, '/'), -1) AS file, string_split(path, '/') AS parts FROM assets)
 SELECT path, regexp_replace(file, '(.)\.[^.]*$', '\1') AS stem, parts[1] || '/' || parts[2] AS room, parts[-2] AS open_room,
 (SELECT m FROM (VALUES ('brand', 5), ('brand_1', 7), ('brand_12', 8), ('brand_2', 7), ('standard', 8)) t(m, n) WHERE contains(path, m) ORDER BY n DESC, m LIMIT 1) AS mic,
 CAST(regexp_extract(file, 'deg([0-9]+)', 1) AS INTEGER) AS angle,
 CAST((duration >= 0.5)::INT + (duration >= 1)::INT + (duration >= 2)::INT + (duration >= 4)::INT AS INTEGER) AS label, regexp_replace(path, '[^A-Za-z0-9_.-]+', '_', 'g') AS safe FROM x""")
def asset_classify(spark, sf):
    a = v.assets(spark, sf)
    p = F.col("path")
    return a.select("path", P.stem(p).alias("stem"), P.room_identity(p).alias("room"), P.openair_room(p).alias("open_room"), P.microphone(p, _MICS).alias("mic"), P.incident_angle(P.basename(p)).alias("angle"), P.duration_label(F.col("duration"), (0.5, 1, 2, 4)).alias("label"), P.safe_name(p).alias("safe"))


@query(f"WITH {v.ASSETS} SELECT path FROM assets WHERE duration >= 2 AND NOT contains(path, '_deg0.') AND label % 2 = 0")
def asset_filter(spark, sf):
    return v.assets(spark, sf).where((F.col("duration") >= 2) & ~F.contains("path", F.lit("_deg0.")) & (F.col("label") % 2 == 0)).select("path")


@query(f"""WITH {v.ASSETS}, f AS (SELECT brand, count(*) AS found FROM assets WHERE label > 10 GROUP BY brand), e AS (SELECT brand, count(*) AS expected FROM assets WHERE label > 10 AND p_partkey % 50 <> 1 OR brand = 'Brand#11' GROUP BY brand)
 SELECT brand, coalesce(found, 0) AS found, coalesce(expected, 0) AS expected FROM f FULL JOIN e USING (brand) WHERE coalesce(found, 0) <> coalesce(expected, 0)""")
def count_reconcile(spark, sf):
    a = v.assets(spark, sf)
    expected = a.where("(label > 10 AND p_partkey % 50 <> 1) OR brand = 'Brand#11'").groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    return metrics.reconcile(a.where("label > 10"), expected, ["brand"])


@query(f"""WITH {v.ASSETS}, r AS (SELECT brand AS dataset, CASE WHEN p_partkey % 4 = 0 THEN 'test' ELSE 'train' END AS split, 'c' || CAST(label % 3 AS VARCHAR) AS collection, CASE WHEN p_partkey % 3 = 0 THEN 'existing' ELSE 'converted' END AS status, p_partkey FROM assets),
 n AS (SELECT dataset, split, collection, count(*) AS n, count(*) FILTER (status = 'converted') AS c, count(*) FILTER (status = 'existing') AS e FROM r WHERE p_partkey % 10 <> 0 GROUP BY ALL),
 s AS (SELECT dataset, split, CAST(sum(n) AS BIGINT) AS files, CAST(sum(c) AS BIGINT) AS converted, CAST(sum(e) AS BIGINT) AS existing, string_agg(collection || '=' || n, ',' ORDER BY collection) AS collections FROM n GROUP BY ALL),
 b AS (SELECT dataset, split, count(*) AS failed FROM r WHERE p_partkey % 10 = 0 GROUP BY ALL)
 SELECT dataset, split, coalesce(files, 0) AS files, coalesce(converted, 0) AS converted, coalesce(existing, 0) AS existing, coalesce(failed, 0) AS failed, coalesce(collections, '') AS collections FROM s FULL JOIN b USING (dataset, split)""")
def corpus_summary(spark, sf):
    k = F.col("p_partkey")
    r = v.assets(spark, sf).select(F.col("brand").alias("dataset"), F.when(k % 4 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("collection"), F.when(k % 3 == 0, "existing").otherwise("converted").alias("status"), k)
    return corpus.corpus_summary(r.where(k % 10 != 0), r.where(k % 10 == 0))


@query(f"WITH {v.ASSETS} SELECT DISTINCT path FROM assets WHERE label = 7 ORDER BY path LIMIT 5")
def first_five_missing(spark, sf):
    """An error report of five names, sorted."""
    return corpus.first_five(v.assets(spark, sf).where("label = 7"), "path")


_CURVE = f"{v.LOG}, curve AS (SELECT metric, step, max_by(value, line) AS value FROM log WHERE step > 0 AND isfinite(value) GROUP BY metric, step)"


@query(f"WITH {_CURVE} SELECT metric, step, value FROM curve")
def curve_latest(spark, sf):
    return curves.curve(v.log(spark, sf), ["metric"])


@query(f"""WITH {_CURVE}, w AS (SELECT metric, step, count(*) FILTER (value < 200) OVER (PARTITION BY metric ORDER BY step ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM curve)
 SELECT metric, min(step) AS onset FROM w WHERE n = 4 GROUP BY metric""")
def curve_onset(spark, sf):
    return curves.onset(curves.curve(v.log(spark, sf), ["metric"]), ["metric"], 200.0, 3)


@query(f"WITH {_CURVE} SELECT metric, step, round(step * 80.0::DOUBLE / 25000, 6) AS exposures, value < 0.9::DOUBLE * ln(10.0::DOUBLE) AS below FROM curve")
def curve_exposure(spark, sf):
    c = curves.curve(v.log(spark, sf), ["metric"])
    return c.select("metric", "step", F.round(curves.exposures(F.col("step"), F.lit(25_000)), 6).alias("exposures"), (F.col("value") < curves.ONSET_SHARE * curves.CHANCE).alias("below"))


@query("""SELECT name, regexp_replace(regexp_replace(name, '^train/', ''), '(_step|_epoch)$', '') AS key FROM (SELECT CASE WHEN event_id % 2 = 0 THEN 'train/' ELSE '' END || event_type || CASE event_id % 3 WHEN 0 THEN '_step' WHEN 1 THEN '_epoch' ELSE '' END AS name FROM events)""")
def metric_keys(spark, sf):
    i = F.col("event_id")
    name = F.concat(F.when(i % 2 == 0, "train/").otherwise(""), "event_type", F.when(i % 3 == 0, "_step").when(i % 3 == 1, "_epoch").otherwise(""))
    return v.table(spark, sf, "events", "event_id", "event_type").select(name.alias("name")).select("name", P.metric_key(F.col("name")).alias("key"))


@query("SELECT k || 'k-small' AS run, CAST(k AS BIGINT) * 1000 AS tracks FROM (SELECT CAST(p_size AS VARCHAR) AS k FROM part)")
def database_sizes(spark, sf):
    run = F.concat(F.col("p_size").cast("string"), F.lit("k-small"))
    return v.table(spark, sf, "part", "p_size").select(run.alias("run"), P.database_size(run).alias("tracks"))


@query(f"""WITH {v.LOG} SELECT step, count(*) AS rows, count(*) FILTER (metric = 'click') AS clicks, round(avg(value), 6) AS mean_value, min(line) AS first_line, max(line) AS last_line, count(*) - count(DISTINCT metric) AS collisions FROM log GROUP BY step""")
def batch_stats(spark, sf):
    return v.log(spark, sf).groupBy("step").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("metric") == "click").alias("clicks"), F.round(F.avg("value"), 6).alias("mean_value"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), (F.count(F.lit(1)) - F.count_distinct("metric")).alias("collisions"))


@query(f"WITH {v.LOG} SELECT step, line, metric, value FROM log WHERE step % 10 = 0")
def log_every_ten(spark, sf):
    return v.log(spark, sf).where("step % 10 = 0").select("step", "line", "metric", "value")



QUERIES, ORACLES = query.queries, query.oracles
