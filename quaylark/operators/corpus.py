"""Corpus preparation: exact dedupe with a preferred keeper, audits, set differences, label merging, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_keepers(assets: DataFrame, digest: str = "digest") -> DataFrame:
    """The row of each digest that stays: test before train, then collection, then relative path.

    A minimum over a struct, so each task sends one row a digest.
    """
    order = F.struct((F.col("split") != "test").alias("late"), F.col("collection"), F.col("relative"), F.col("split").alias("split"))
    return assets.groupBy(digest).agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("copies")).select(digest, F.col("k.collection").alias("collection"), F.col("k.relative").alias("relative"), F.col("k.split").alias("split"), "copies")


def dedupe_audit(assets: DataFrame, digest: str = "digest") -> DataFrame:
    """Every removed row with its keeper, by split, collection and relative path, and whether they are of different splits."""
    named = lambda c: F.concat_ws("/", "split", "collection", "relative").alias(c)
    keep = dedupe_keepers(assets, digest).where("copies > 1").select(digest, named("kept"), F.col("split").alias("kept_split"))
    return assets.select(digest, "split", named("removed")).join(keep, digest).where(F.col("removed") != F.col("kept")).select(digest, "kept", "removed", (F.col("split") != F.col("kept_split")).alias("cross_split"))


SOURCE = ["dataset", "split", "collection", "relative", "path"]


def collect_sources(parts: list[DataFrame], passthrough: str = "bg_noise") -> DataFrame:
    """One listing of several collectors' rows, whose other columns may differ: what a part lacks is NULL.

    Every part must have the columns of SOURCE.  `name` is the place in the prepared corpus; two rows with one name and
    of one data set, which would overwrite each other, are an error, as is a row without any of SOURCE.
    """
    for k, part in enumerate(parts):
        if lacking := [c for c in SOURCE if c not in part.columns]:
            raise ValueError(f"part {k} has no {', '.join(lacking)}")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows = rows.withColumn("name", F.when(F.col("dataset") == passthrough, F.concat_ws("/", "split", "relative")).otherwise(F.concat_ws("/", "split", "collection", "relative")))
    holes = rows.where(" OR ".join(f"{c} IS NULL" for c in SOURCE)).select("dataset", "path").limit(5).collect()
    if holes:
        raise ValueError(f"incomplete sources: {[tuple(r) for r in holes]}")
    clash = rows.groupBy("dataset", "name").count().where("count > 1").orderBy("dataset", "name").limit(5).collect()
    if clash:
        raise ValueError(f"sources of one name: {[r['name'] for r in clash]}")
    return rows


def leakage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values on both sides: must be empty."""
    return a.intersect(b)


def difference_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """Values of one side only, labelled."""
    return old.exceptAll(new).withColumn("side", F.lit("ONLY OLD")).unionByName(new.exceptAll(old).withColumn("side", F.lit("ONLY NEW")))


def first_five(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column).limit(5)


_MERGES = """
WITH RECURSIVE merging(groups, goes, step) MAX RECURSION LEVEL {most} AS (
  SELECT array_sort(collect_list(struct(label, n))), transform(array_sort(collect_list(label)), x -> struct(x AS old, x AS new)), 0 FROM {histogram} WHERE label IS NOT NULL
  UNION ALL
  SELECT filter(transform(groups, (g, j) -> if(j = near, struct(g.label AS label, g.n + groups[at].n AS n), g)), (g, j) -> j <> at),
    transform(goes, m -> if(m.new = groups[at].label, struct(m.old AS old, groups[near].label AS new), m)), step + 1
  FROM (
    SELECT groups, goes, step, at,
      CASE WHEN at = 0 THEN 1 WHEN at = size(groups) - 1 OR groups[at].label - groups[at - 1].label <= groups[at + 1].label - groups[at].label THEN at - 1 ELSE at + 1 END AS near
    FROM (SELECT groups, goes, step, CAST(array_position(transform(groups, g -> g.n < {least}), true) AS INT) - 1 AS at FROM merging WHERE size(groups) > 1)
    WHERE at >= 0
  )
)
SELECT inline(max_by(goes, step)) FROM merging"""


def merge_rare_labels(histogram: DataFrame, least: int, most: int = 100_000) -> DataFrame:
    """(old, new) of the labels of a histogram (label, n): the smallest rare label joins the nearest other (the smaller of equally near), until all have `least`.

    A recursive table over the histogram, which has a row a label.
    """
    return histogram.sparkSession.sql(_MERGES, histogram=histogram.select("label", "n"), least=int(least), most=int(most))


def apply_merge(rows: DataFrame, label: str, least: int) -> DataFrame:
    """rows with rare labels merged; a null label stays."""
    goes = merge_rare_labels(rows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")), least)
    told = rows.join(goes, rows[label] == goes["old"], "left")
    return told.select(*(F.col("new").alias(c) if c == label else rows[c] for c in rows.columns))


def corpus_summary(rows: DataFrame, failures: DataFrame) -> DataFrame:
    """Per dataset and split: files, converted, existing, failed, and files by collection as sorted text."""
    keys = ["dataset", "split"]
    n = rows.groupBy(*keys, "collection").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "converted").alias("c"), F.count_if(F.col("status") == "existing").alias("e"))
    n = n.groupBy(*keys).agg(
        F.sum("n").alias("files"), F.sum("c").alias("converted"), F.sum("e").alias("existing"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("collection", "n"))), lambda x: F.concat_ws("=", x["collection"], x["n"].cast("string"))), ",").alias("collections"),
    )
    bad = failures.groupBy(*keys).agg(F.count(F.lit(1)).alias("failed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return n.join(bad, keys, "full_outer").select(*keys, zero("files"), zero("converted"), zero("existing"), zero("failed"), F.coalesce("collections", F.lit("")).alias("collections"))
