"""Ranked decoding of five digits over a pluggable scorer: greedy, beam and joint beam.

A scorer maps (query_id, window_id, prefix) to ten digit logits.  Queries are
dealt once, to a stated number of tasks, and stay there: a few bytes of ids
become hundreds of rows a query, which Spark's own sizing of tasks can't know.
Their number grows with the queries, so that a task's memory doesn't.
Only width rows a query go on from step to step.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import _text
from ..functions.signals import let

DIGITS = 5
#: Tasks among which queries are dealt at least, where the session has fewer shuffle partitions, and windows a task has on average at most.
LEAST_TASKS, MOST_WINDOWS = 64, 4096


class Scorer(Protocol):
    def logits(self, rows: DataFrame) -> DataFrame:
        """rows (query_id, window_id, prefix, ...) with a column logits ARRAY<DOUBLE> of ten; a search that looks at ends needs `others`, too.

        others: ARRAY<DOUBLE>, the logits of what is no digit at this place, the end first.
        """


class HashScorer:
    """Logits from the bytes of a keyed SHA-256: one digest gives all ten."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def logits(self, rows: DataFrame) -> DataFrame:
        digest = F.sha2(_text(self.seed, F.col("query_id"), F.col("window_id"), F.col("prefix")), 256)
        values = [F.conv(F.substring(digest, 6 * d + 1, 6), 16, 10).cast("long") / F.lit(float(1 << 22)) for d in range(10)]
        end = F.conv(F.substring(digest, 61, 4), 16, 10).cast("long") / F.lit(float(1 << 14))
        return rows.withColumns({"logits": F.array(*values), "others": F.array(end, F.lit(0.5))})

    def sql(self, query: str, window: str, prefix: str, digit: str) -> str:
        h = f"sha256(concat_ws(':', '{self.seed}', CAST({query} AS VARCHAR), CAST({window} AS VARCHAR), {prefix}))"
        return f"(('0x' || substr({h}, 6 * {digit} + 1, 6))::BIGINT / 4194304.0)"

    def end_sql(self, query: str, window: str, prefix: str) -> str:
        return f"(('0x' || substr(sha256(concat_ws(':', '{self.seed}', CAST({query} AS VARCHAR), CAST({window} AS VARCHAR), {prefix})), 61, 4))::BIGINT / 16384.0)"


class TableScorer:
    """Logits looked up in a table (query_id, window_id, prefix, logits[, others])."""

    def __init__(self, table: DataFrame):
        self.table = table

    def logits(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.table, ["query_id", "window_id", "prefix"])


def log_softmax(logits: Column) -> Column:
    def less_norm(x: Column, top: Column) -> Column:
        norm = top + F.log(F.aggregate(x, F.lit(0.0), lambda a, y: a + F.exp(y - top)))
        return let(norm, lambda n: F.transform(x, lambda y: y - n))

    return let(logits, lambda x: let(F.array_max(x), lambda top: less_norm(x, top)))


def _log_probabilities(scored: DataFrame, keep: list[str], ends: bool = False) -> DataFrame:
    """The columns to keep, with log-probabilities l0..l9 of the ten digits from `logits`, in plain columns.

    With ends they are of all tokens, and there are `end` and `rest`, those of the end and of the best of the `others` after it.
    """
    digits = [f"l{d}" for d in range(10)]
    rows = scored.select(*keep, *(["others"] if ends else []), *(F.get("logits", F.lit(d)).alias(x) for d, x in enumerate(digits)))
    rows = rows.withColumn("_top", F.greatest(*digits, *([F.array_max("others")] if ends else [])))
    total = sum((F.exp(F.col(x) - F.col("_top")) for x in digits), F.lit(0.0))
    if ends:
        total = total + F.aggregate("others", F.lit(0.0), lambda a, y: a + F.exp(y - F.col("_top")))
    rows = rows.withColumn("_norm", F.col("_top") + F.log(total))
    out = [(F.col(x) - F.col("_norm")).alias(x) for x in digits]
    if ends:
        rest = F.coalesce(F.array_max(F.slice("others", F.lit(2), F.size("others") - 1)), F.lit(float("-inf")))
        out += [(F.get("others", F.lit(0)) - F.col("_norm")).alias("end"), (rest - F.col("_norm")).alias("rest")]
    return rows.select(*keep, *out)


def end_log_probability(logits: Column, others: Column) -> Column:
    """Log-probability of the end among all tokens: the digits and the others, of which it is the first."""
    return F.get(log_softmax(F.concat(others, logits)), F.lit(0))


def end_is_best(logits: Column, others: Column) -> Column:
    """Whether the end is the most likely token; of equals the digits come first, then the end."""
    return (F.get(others, F.lit(0)) > F.array_max(logits)) & (F.get(others, F.lit(0)) >= F.array_max(others))


def dealt(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """rows by key, in tasks of a bounded number on average.  They are counted first, and a search reads them at each step: where they are costly, store them."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_TASKS, -(-rows.count() // MOST_WINDOWS))
    return rows.repartition(tasks, key)


def _search(windows: DataFrame, scorer: Scorer, width: int, steps: int, ends: str | None, one: bool = False) -> DataFrame:
    """joint_beam() over dealt windows.  With one, every query has one window, number 0: nothing is to be joined or averaged."""
    if ends not in (None, "score", "flag"):
        raise ValueError(f"ends: {ends}")
    beam = windows.select("query_id").distinct().withColumn("prefix", F.lit("")).withColumn("score", F.lit(0.0))
    keys, digits = ["query_id", "prefix", "score"], [f"l{d}" for d in range(10)]
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("prefix"))

    def means(beam: DataFrame, names: list[str], ends: bool = False) -> DataFrame:
        asked = beam.withColumn("window_id", F.lit(0)) if one else windows.join(beam.hint("merge"), "query_id")
        told = _log_probabilities(scorer.logits(asked), keys, ends)
        return told if one else told.groupBy(*keys).agg(*(F.avg(x).alias(x) for x in names))

    for step in range(steps):
        grown = means(beam, digits)
        cand = grown.select("query_id", F.inline(F.array(*(F.struct(F.concat("prefix", F.lit(str(d))).alias("prefix"), F.round(F.col("score") + F.col(x), 12).alias("score")) for d, x in enumerate(digits)))))
        beam = cand.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= min(width, 10 ** (step + 1)))
        if step < steps - 1 or ends:
            beam = beam.drop("rank")
    if ends is None:
        return beam.select("query_id", F.col("prefix").alias("code"), "score", "rank")
    told = means(beam, [*digits, "end", "rest"], True)
    if ends == "score":
        told = told.withColumn("score", F.round(F.col("score") + F.col("end"), 12)).withColumn("ended", F.lit(True))
    else:
        told = told.withColumn("ended", (F.col("end") > F.greatest(*digits)) & (F.col("end") >= F.col("rest")))
    return told.select("query_id", F.col("prefix").alias("code"), "score", F.row_number().over(order).alias("rank"), "ended")


def joint_beam(windows: DataFrame, scorer: Scorer, width: int, steps: int = DIGITS, ends: str | None = None) -> DataFrame:
    """(query_id, code, score, rank): digit log-probabilities are averaged over a query's windows before pruning.

    windows: (query_id, window_id).  Ties are broken by the smaller prefix.  With ends, the search goes one step beyond
    the digits and tells `ended`.  'score': each code goes on with its end, the end's mean log-probability counts and
    decides the order, and every code has ended.  'flag': score and order are those of the digits, and ended says
    whether the end is the most likely next token by the mean of the windows' probabilities' logarithms.
    """
    windows = windows.select("query_id", "window_id")
    return _search(dealt(windows), scorer, width, steps, ends)


def beam(queries: DataFrame, scorer: Scorer, width: int, steps: int = DIGITS, ends: str | None = None) -> DataFrame:
    """One window a query."""
    return _search(dealt(queries.select("query_id")), scorer, width, steps, ends, one=True)


def greedy(queries: DataFrame, scorer: Scorer, steps: int = DIGITS, eos: Column | None = None) -> DataFrame:
    """(query_id, code, score): the best digit at each step (the smallest of equals), plus an end log-probability if given."""
    now = queries.select("query_id", F.lit(0).alias("window_id"), F.lit("").alias("prefix"), F.lit(0.0).alias("score"), *(["eos"] if eos is not None else []))
    digits = [f"l{d}" for d in range(10)]
    for _ in range(steps):
        scored = _log_probabilities(scorer.logits(now), now.columns).withColumn("best", F.greatest(*digits))
        digit = F.coalesce(*(F.when(F.col(x) == F.col("best"), str(d)) for d, x in enumerate(digits)))
        now = scored.withColumn("prefix", F.concat("prefix", digit)).withColumn("score", F.col("score") + F.col("best")).drop("best", *digits)
    score = F.col("score") + eos if eos is not None else F.col("score")
    return now.select("query_id", F.col("prefix").alias("code"), score.alias("score"), F.lit(True).alias("ended"))


def beams_as_arrays(beam: DataFrame) -> DataFrame:
    """One row a query with its codes in rank order."""
    codes = F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", "score"))), lambda x: x["code"])
    return beam.groupBy("query_id").agg(codes.alias("beam"))
