"""Constraint checks: each gives its violations as rows; none means valid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every row and broken rule, in one pass."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return df.select(key, F.explode(broken).alias("rule"))


def token_rules(vocabulary: int, role: str) -> dict[str, Column]:
    """Rules of a token store's rows (tokens, token_count, status, corpus_role)."""
    return {
        "count": (F.col("status") != "ok") | (F.col("token_count") == F.size("tokens")),
        "vocabulary": F.forall("tokens", lambda t: t.between(0, vocabulary - 1)),
        "role": F.col("corpus_role") == role,
        "span": (F.col("token_offset") >= 0) & (F.col("token_count") >= 0),
        "error": (F.col("status") == "ok") | F.col("error").isNotNull(),
    }


def one_value(df: DataFrame, column: str) -> DataFrame:
    """Values of a column that must have one value: rows only if there are several."""
    values = df.select(column).distinct()
    return values if values.count() > 1 else values.limit(0)


def foreign(df: DataFrame, column: str, expected: str, line: str) -> DataFrame:
    """Lines whose value is another one."""
    return df.where(~F.col(column).eqNullSafe(F.lit(expected))).select(line, column)


def metadata_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, left, right) of two key-value tables wherever they differ."""
    both = a.select("key", F.col("value").alias("left")).join(b.select("key", F.col("value").alias("right")), "key", "full_outer")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def missing_keys(required: list[str], present: Column) -> Column:
    return F.array_except(F.array(*map(F.lit, required)), present)


def on_grid(start: Column, width: Column) -> Column:
    """Whether a position is a multiple of the width, within rounding."""
    q = start / width
    return F.abs(q - F.bround(q)) <= 1e-9 * F.greatest(F.abs(q), F.abs(F.bround(q)))


def assert_empty(df: DataFrame, message: str) -> None:
    bad = df.limit(5).collect()
    if bad:
        raise ValueError(f"{message}: {[tuple(r) for r in bad]}")


def union_rules(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def prescribed_violations(queries: DataFrame, cohort: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rules of a prescribed query list: no repeats, all in the cohort with the same code, none excluded."""
    tag = lambda df, rule: df.select("track_id", F.lit(rule).alias("rule"))
    known = cohort.select("track_id", F.col("code").alias("true_code"))
    return union_rules([
        tag(queries.groupBy("track_id").count().where("count > 1"), "repeated"),
        tag(queries.join(known, "track_id", "left_anti"), "unknown"),
        tag(queries.join(known, "track_id").where(~F.col("code").eqNullSafe(F.col("true_code"))), "code"),
        tag(queries.join(excluded, "track_id", "left_semi"), "excluded"),
    ])
