"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token weights are added up to cells of source, language and topic.  Raking
multiplies the cells' weights so that one margin after the other meets its
target, again and again.  A document is then kept with a probability in
proportion to its cell's raked weight per token, by a hash of its id.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import materialise

SWEEPS = 6
#: Targets flatten the observed margins: shares to this power, then normalised.
TEMPERATURE = 0.5
SEED = "mix"
NONE = "(none)"
MARGINS = ["source", "lang", "topic"]
#: Of all tokens, how many the query keeps in expectation.
SHARE = 0.5
#: Cells whose weights may be broadcast.
MOST_CELLS = 100_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null is empty."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def form_topic(text: Column) -> Column:
    """A text's form as its topic: table, licence, shouting, list of short lines, long or short prose."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return (
        F.when(F.contains(t, F.lit(" | ")), "table")
        .when(F.contains(t, F.lit("icense")), "licence")
        .when(F.contains(t, F.lit("!!")), "shouting")
        .when(F.char_length(t) >= 2000, "long")
        .otherwise("short")
    )


def uniform(id_col: Column, seed: str) -> Column:
    """A number in [0, 1) from the MD5 of seed and id: the same on every run and in any SQL engine."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(16**13))


def rake(cells: DataFrame, margins: list[str], weight: str, targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS, temperature: float = TEMPERATURE) -> DataFrame:
    """cells with a column `raked`: weights whose margins meet the targets after the given sweeps, with the same total.

    A margin without stated targets gets its observed shares to the power `temperature`, normalised.  Stated targets
    are weights by value, normalised over the values present; values without one get weight 0.  Cells of weight 0
    stay 0.  Sums of a margin are windows over the cells, without joins.  If a margin is still off its target by more than a hundredth
    after the last one (margins that contradict each other, or slow convergence), a warning says by how much.
    """
    cells = cells.withColumn("raked", F.col(weight).cast("double"))
    total = cells.agg(F.sum("raked")).first()[0] or 0.0
    sums = lambda m: F.sum("raked").over(Window.partitionBy(m))
    for m in margins:
        if targets and m in targets:
            pairs = F.create_map(*(F.lit(x) for kv in targets[m].items() for x in kv))
            wish = lambda w, m=m, pairs=pairs: F.coalesce(F.try_element_at(pairs, F.col(m)), F.lit(0.0)).cast("double")
        else:
            wish = lambda w: F.pow(w, F.lit(temperature))
        norm = cells.groupBy(m).agg(F.sum("raked").alias("w")).where("w > 0").agg(F.sum(wish(F.col("w")))).first()[0] or 1.0
        cells = cells.withColumn(f"want_{m}", F.when(sums(m) > 0, wish(sums(m)) / F.lit(float(norm)) * F.lit(float(total))))
    cells = materialise(cells, "cells")
    for k in range(sweeps):
        for m in margins:
            have = sums(m)
            cells = cells.withColumn("raked", F.col("raked") * F.coalesce(F.when(have > 0, F.col(f"want_{m}") / have).otherwise(0.0), F.lit(0.0)))
        if k % 3 == 2 or k == sweeps - 1:
            cells = materialise(cells, "raked")
    off = F.greatest(*(F.abs(sums(m) / F.nullif(F.col(f"want_{m}"), F.lit(0.0)) - 1) for m in margins), F.lit(0.0))
    off = cells.select(off.alias("off")).agg(F.max("off")).first()[0] or 0.0
    if off > 0.01:
        warnings.warn(f"after {sweeps} sweeps a margin is {off:.3f} of its target off", stacklevel=2)
    return cells.drop(*(f"want_{m}" for m in margins))


def inclusion_scale(raked: DataFrame, weight: str, share: float) -> float:
    """The factor of raked weights at which cells, none kept more than whole, keep a share of the total weight."""
    n, r = F.col(weight), F.col("raked")
    want = share * (raked.agg(F.sum(n)).first()[0] or 0)
    scale = 0.0
    while True:  # it only rises, and with it the cells kept whole
        whole = r * scale >= n
        got = raked.where("raked > 0").agg(F.sum(F.when(whole, n)).alias("sure"), F.sum(F.when(~whole, r)).alias("rest"), F.max(n / r).alias("most")).first()
        if not got["rest"]:
            return scale
        new = min((want - (got["sure"] or 0)) / got["rest"], got["most"])
        if new <= scale * (1 + 1e-12):
            return scale
        scale = new


def _cell_columns(text_col: str, source_col: str, lang_col: str, topic: Column | None) -> list[Column]:
    """The cell of a row; nulls are a value of their own."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    return [named(F.col(source_col)).alias("source"), named(F.col(lang_col)).alias("lang"), named(form_topic(F.col(text_col)) if topic is None else topic).alias("topic")]


def _cell_weights(rows: DataFrame, targets, sweeps: int, temperature: float, share: float | None) -> DataFrame:
    """(source, lang, topic, weight, probability) of the cells of rows (source, lang, topic, n_tokens)."""
    raked = rake(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n")), MARGINS, "n", targets, sweeps, temperature)
    weights = raked.select(*MARGINS, F.when(F.col("n") > 0, F.col("raked") / F.col("n")).alias("weight"))
    if share is None:
        top = weights.agg(F.max("weight")).first()[0]
        chance = F.col("weight") / F.lit(top).cast("double")
    else:
        chance = F.least(F.col("weight") * F.lit(inclusion_scale(raked, "n", share)), F.lit(1.0))
    weights = materialise(weights.select(*MARGINS, "weight", F.coalesce(chance, F.lit(1.0)).alias("probability")), "mix-cells")
    return F.broadcast(weights) if weights.count() <= MOST_CELLS else weights


def mix_weights(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS, temperature: float = TEMPERATURE, seed: str = SEED, share: float | None = None,
) -> DataFrame:
    """(id, source, lang, topic, n_tokens, weight, probability, kept) per row.

    weight is the cell's raked weight a token.  With a share, that share of all tokens is kept in expectation (all, if
    fewer have a weight): cells too small for their target are kept whole, the rest in proportion to their weights, so a
    rare cell changes next to nothing for the others.  Without one, probability is weight over the largest weight of
    any cell: the kept tokens meet all three targets in expectation, but one rare cell decides how many are kept.  Null sources, languages and
    topics are a value of their own, "(none)".  Texts without words weigh nothing: in a cell without tokens probability
    is 1.  Rows that repeat an id have one draw, and fall alike within a cell.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *_cell_columns(text_col, source_col, lang_col, topic), word_count(F.col(text_col)).alias("n_tokens"))
    rows = materialise(rows, "mix-rows")  # without the texts
    weights = _cell_weights(rows, targets, sweeps, temperature, share)
    return rows.join(weights, MARGINS).select(
        F.col("id").alias(id_col), *MARGINS, "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), "probability",
        (uniform(F.col("id"), seed) < F.col("probability")).alias("kept"),
    )


def mix_sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None,
    targets: dict[str, dict[str, float]] | None = None, sweeps: int = SWEEPS, temperature: float = TEMPERATURE, seed: str = SEED, share: float | None = None,
) -> DataFrame:
    """The rows of docs that the mix keeps, with all their columns, as mix_weights() decides: row by row, so no text moves."""
    cell = _cell_columns(text_col, source_col, lang_col, topic)
    counted = materialise(docs.select(*cell, word_count(F.col(text_col)).alias("n_tokens")).groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n_tokens")), "mix-counts")
    weights = _cell_weights(counted, targets, sweeps, temperature, share)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    drawn = docs.select(row, *cell, uniform(F.col(id_col).cast("long"), seed).alias("draw")).join(weights, MARGINS)
    return drawn.where("draw < probability").select("row.*")


def mix_sql(sweeps: int = SWEEPS, temperature: float = TEMPERATURE, seed: str = SEED, share: float = SHARE) -> str:
    """DuckDB SQL of the rows of mix_weights over documents: where the kept tokens reach the share is read off cells sorted by tokens a weight."""
    margins = ["source", "lang", "topic"]
    steps = []
    names = ["c0"]
    for s in range(sweeps):
        for m in margins:
            new = f"c{len(names)}"
            steps.append(
                f"{new} AS (SELECT source, lang, topic, n, raked * CASE WHEN sum(raked) OVER (PARTITION BY {m}) > 0 THEN "
                f"(SELECT any_value(want) FROM want_{m} w WHERE w.{m} = {names[-1]}.{m}) / sum(raked) OVER (PARTITION BY {m}) ELSE 0 END AS raked FROM {names[-1]})"
            )
            names.append(new)
    wants = [
        f"want_{m} AS (SELECT {m}, pow(w, {temperature}) / sum(pow(w, {temperature})) OVER () * (SELECT sum(raked) FROM c0) AS want "
        f"FROM (SELECT {m}, sum(raked) AS w FROM c0 GROUP BY {m}) WHERE w > 0)"
        for m in margins
    ]
    return reduce(
        lambda sql, part: sql + ",\n" + part, [*wants, *steps],
        "WITH r AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, "
        "CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, 'icense') THEN 'licence' WHEN contains(t, '!!') THEN 'shouting' WHEN length(t) >= 2000 THEN 'long' ELSE 'short' END AS topic, "
        r"len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents)),"
        "\nc0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS n, CAST(sum(n_tokens) AS DOUBLE) AS raked FROM r GROUP BY ALL)",
    ) + (
        f",\nf AS (SELECT source, lang, topic, n, raked, CASE WHEN n > 0 THEN raked / n END AS weight FROM {names[-1]}),"
        "\nq AS (SELECT n, raked, n / raked AS q FROM f WHERE raked > 0),"
        "\no AS (SELECT q, sum(n) OVER w + q * ((SELECT sum(raked) FROM q) - sum(raked) OVER w) AS kept FROM q WINDOW w AS (ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),"
        f"\nt AS (SELECT {share} * sum(n) AS want FROM f), b AS (SELECT min(q) AS q FROM o, t WHERE kept >= want),"
        "\nz AS (SELECT coalesce((any_value(t.want) - coalesce(sum(q.n) FILTER (q.q < b.q), 0)) / sum(q.raked) FILTER (q.q >= b.q), max(q.q)) AS scale FROM q, b, t),"
        "\ng AS (SELECT *, coalesce(least(1.0, weight * (SELECT scale FROM z)), 1.0) AS probability FROM f)"
        f"\nSELECT doc_id, source, lang, topic, n_tokens, coalesce(weight, 0.0) AS weight, probability, "
        f"CAST('0x' || left(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 13) AS BIGINT) / pow(16.0, 13) < probability AS kept FROM r JOIN g USING (source, lang, topic)"
    )
