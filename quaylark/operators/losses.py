"""Losses over exploded logits or per-token losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decode import log_softmax


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax at the 0-based target."""
    return -F.element_at(log_softmax(logits), target.cast("int") + 1)


def masked_mean(loss: str, mask: str) -> Column:
    return F.avg(F.when(F.col(mask), F.col(loss)))


def family_losses(tokens: DataFrame, keys: list[str], weight: float, loss: str = "loss", family: str = "family", correct: str = "correct") -> DataFrame:
    """Weighted total, mean loss of each family, perplexity and digit accuracy, per key."""
    of = lambda f: F.avg(F.when(F.col(family) == f, F.col(loss)))
    w = F.when(F.col(family) == "digits", F.lit(float(weight))).otherwise(1.0)
    return tokens.groupBy(*keys).agg(
        (F.sum(F.col(loss) * w) / F.sum(w)).alias("loss"), of("audio").alias("audio_loss"), of("digits").alias("digit_loss"), of("boundary").alias("boundary_loss"),
        F.exp(F.least(of("audio"), F.log(F.lit(1e6)))).alias("audio_perplexity"), F.avg(F.when(F.col(family) == "digits", F.col(correct).cast("double"))).alias("digit_accuracy"),
    )


def exact_accuracy(tokens: DataFrame, doc: str, keys: list[str]) -> DataFrame:
    """Share of documents all of whose digits are correct."""
    per = tokens.where("family = 'digits'").groupBy(*keys, doc).agg(F.bool_and("correct").alias("exact"))
    return per.groupBy(*keys).agg(F.avg(F.col("exact").cast("double")).alias("exact_accuracy"))


def by_view(losses: DataFrame, view: str, value: str) -> DataFrame:
    """Mean of the views' means."""
    return losses.groupBy(view).agg(F.avg(value).alias("m")).agg(F.avg("m").alias(value))


def degraded_losses(tokens: DataFrame, weight: float, loss: str = "loss") -> DataFrame:
    """Audio loss from clean rows only, the other families from all, recombined by the families' target counts; degraded rows' digit loss."""
    clean = ~F.col("degraded")
    fam = lambda f, m=F.lit(True): F.avg(F.when((F.col("family") == f) & m, F.col(loss)))
    n = lambda f: F.sum(F.when(F.col("family") == f, 1).otherwise(0))
    out = tokens.agg(fam("audio", clean).alias("audio"), fam("digits").alias("digits"), fam("boundary").alias("boundary"), fam("digits", F.col("degraded")).alias("degraded_digits"), n("audio").alias("na"), n("digits").alias("nd"), n("boundary").alias("nb"))
    total = F.col("na") + weight * F.col("nd") + F.col("nb")
    return out.select("audio", "digits", "boundary", "degraded_digits", ((F.col("na") * F.col("audio") + weight * F.col("nd") * F.col("digits") + F.col("nb") * F.col("boundary")) / total).alias("loss"))


def distillation(pairs: DataFrame, keys: list[str], temperature: float = 1.0) -> DataFrame:
    """T^2 times the mean KL(teacher || student) over rows with ten-digit logits `teacher` and `student`; 0 without rows."""
    t, s = (log_softmax(F.transform(F.col(c), lambda x: x / temperature)) for c in ("teacher", "student"))
    kl = F.aggregate(F.zip_with(t, s, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return pairs.groupBy(*keys).agg((F.coalesce(F.avg(kl), F.lit(0.0)) * temperature**2).alias("kd_loss"))


def pair_rows(rows: DataFrame, pair: str = "pair_id", track: str = "track_id") -> DataFrame:
    """Anchor and secondary rows of each pair side by side; a pair of two tracks is an error."""
    a, b = rows.where("role = 'anchor'").alias("a"), rows.where("role = 'secondary'").alias("b")
    both = a.join(b, F.col(f"a.{pair}") == F.col(f"b.{pair}"))
    same = F.when(F.col(f"a.{track}") == F.col(f"b.{track}"), F.col(f"a.{track}")).otherwise(F.raise_error(F.lit("pair of two tracks")).cast("string"))
    return both.select(F.col(f"a.{pair}").alias(pair), same.alias(track), F.struct("a.*").alias("anchor"), F.struct("b.*").alias("secondary"))
