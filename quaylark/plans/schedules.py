"""Queries of schedules over a grid of steps taken from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import schedules as sc
from . import views as v
from .registry import Registry

query = Registry()

_STEPS = "steps AS (SELECT DISTINCT event_id * 37 % 240000 AS step FROM events)"


def _steps(spark, sf):
    return v.table(spark, sf, "events", "event_id").select((F.col("event_id") * 37 % 240_000).alias("step")).distinct()


def _schedule(name, phases, fields):
    sql = ", ".join(f"round({sc.sql_piecewise('step', phases, k)}, 9) AS {f}" for f, k in fields.items())
    names = "CASE " + " ".join(f"WHEN step < {phases[i + 1].start} THEN '{p.name}'" for i, p in enumerate(phases[:-1])) + f" ELSE '{phases[-1].name}' END"

    @query(f"WITH {_STEPS} SELECT step, {sql}, {names} AS phase FROM steps", name=name)
    def run(spark, sf):
        s = F.col("step")
        return _steps(spark, sf).select("step", *(F.round(sc.piecewise(s, phases, k), 9).alias(f) for f, k in fields.items()), sc.phase_name(s, phases).alias("phase"))


_ALL = {f: k for k, f in enumerate(sc.FIELDS)}
_schedule("schedule_background", sc.BACKGROUND, {"probability": 0})
_schedule("schedule_consistency", sc.consistency_phases(), {"share": 0, "weight": 1})
_schedule("schedule_consistency_scaled", sc.consistency_phases(123_457), {"share": 0, "weight": 1})
_schedule("schedule_short_ramp", sc.SHORT_RAMP, {"share": 0, "weight": 1})
_schedule("schedule_fixed_run", sc.FIXED_RUN, {f: k for f, k in _ALL.items() if f != "severity"})
_schedule("schedule_curriculum", sc.CURRICULUM, _ALL)
_schedule("schedule_noise", sc.noise_phases("noise", {"clean": 20_000, "noise_ramp": 40_000}, 0.1), {f: k for f, k in _ALL.items() if f != "severity"})
_schedule("schedule_noise_rir", sc.noise_phases("noise-rir", {"clean": 20_000, "noise_ramp": 40_000, "noise_steady": 80_000, "rir_ramp": 100_000, "combined_ramp": 150_000}, 0.1), {f: k for f, k in _ALL.items() if f != "severity"})


@query(f"""WITH {_STEPS} SELECT step, round(CASE WHEN step < 500 THEN step / 500.0::DOUBLE WHEN step < 60000 THEN 1 WHEN step < 140000 THEN 1 - (step - 60000) / 80000.0::DOUBLE * 0.5 ELSE 0.05 + 0.45 * 0.5 * (1 + cos(pi() * least(1.0, (step - 140000) / 85000.0::DOUBLE))) END, 9) AS rate,
 round(CASE WHEN step < 2000 THEN (step + 1) / 2000.0::DOUBLE ELSE 0.5 * (1 + cos(pi() * least(1.0, (step - 2000) / 68000.0::DOUBLE))) END, 9) AS legacy,
 round(CASE WHEN step <= 15000 THEN 0 WHEN step >= 30000 THEN 0.1 ELSE (step - 15000) / 15000.0::DOUBLE * 0.1 END, 9) AS distillation FROM steps""")
def schedule_rates(spark, sf):
    s = F.col("step")
    return _steps(spark, sf).select("step", F.round(sc.learning_rate_multiplier(s), 9).alias("rate"), F.round(sc.warmup_cosine(s, 2000, 70_000), 9).alias("legacy"), F.round(sc.distillation_weight(s), 9).alias("distillation"))


@query("SELECT p_size AS codebooks, round(50.0::DOUBLE * p_size / (50 * p_size + 4 * p_size * 5 + 2), 9) AS audio, round(20.0::DOUBLE * p_size / (50 * p_size + 4 * p_size * 5 + 2), 9) AS digits, round(2.0::DOUBLE / (50 * p_size + 4 * p_size * 5 + 2), 9) AS boundary FROM (SELECT DISTINCT p_size FROM part)")
def family_coefficients(spark, sf):
    q = F.col("codebooks").cast("double")
    parts = sc.family_coefficients(q * 50, F.lit(5.0), F.lit(2.0), q * 4)
    return v.table(spark, sf, "part", "p_size").distinct().withColumnRenamed("p_size", "codebooks").select("codebooks", *(F.round(c, 9).alias(n) for n, c in parts.items()))


QUERIES, ORACLES = query.queries, query.oracles
