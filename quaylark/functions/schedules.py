"""Schedules as CASE expressions of the step.

Each schedule is a list of phases (from step, name, values at the phase's start
and end); ``piecewise`` turns the list into one expression, linear inside a
phase.  The same list gives the Python value and the SQL text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Phase:
    """From `start` (inclusive) to the next phase, fields go linearly from `a` to `b`; the last phase keeps `a`."""

    start: int
    name: str
    a: tuple
    b: tuple | None = None


FIELDS = ("clean", "noise", "rir", "noise_rir", "consistency", "severity")

#: Background-noise probability by step.
BACKGROUND = [
    Phase(0, "clean", (0.0,)), Phase(20_000, "easy", (0.0,), (0.25,)), Phase(25_000, "medium", (0.25,), (0.5,)), Phase(35_000, "hard", (0.5,), (0.75,)), Phase(45_000, "steady", (0.75,)),
]
#: Degraded share and consistency weight with the SNR-bin weights of each phase, for a run of 70,000 steps.
CONSISTENCY = [
    Phase(0, "clean", (0.0, 0.0)), Phase(20_000, "easy", (0.0, 0.0), (0.25, 0.05)), Phase(30_000, "mixed", (0.25, 0.05), (0.5, 0.1)),
    Phase(40_000, "hardening", (0.5, 0.1), (0.75, 0.1)), Phase(55_000, "consolidation", (0.75, 0.1)),
]
CONSISTENCY_BINS = {"easy": (0.0, 0.05, 0.25, 0.70), "mixed": (0.05, 0.15, 0.35, 0.45), "hardening": (0.20, 0.30, 0.30, 0.20), "consolidation": (0.40, 0.30, 0.20, 0.10)}
CONSISTENCY_RUN = 70_000
#: The short ramp to a steady degraded share.
SHORT_RAMP = [Phase(0, "clean", (0.0, 0.0)), Phase(20_000, "ramp", (0.0, 0.0), (0.75, 0.1)), Phase(25_000, "steady", (0.75, 0.1))]
#: Clean, noise, room, noise-with-room shares, consistency weight and severity quantile of the fixed run of 175,000 steps.
FIXED_RUN = [
    Phase(0, "clean", (1.0, 0.0, 0.0, 0.0, 0.0, None)),
    Phase(50_000, "noise_ramp", (1.0, 0.0, 0.0, 0.0, 0.0, None), (0.25, 0.75, 0.0, 0.0, 0.1, None)),
    Phase(62_500, "noise_steady", (0.25, 0.75, 0.0, 0.0, 0.1, None)),
    Phase(87_500, "rir_ramp", (0.25, 0.75, 0.0, 0.0, 0.1, None), (0.25, 0.55, 0.2, 0.0, 0.1, None)),
    Phase(100_000, "combined_ramp", (0.25, 0.55, 0.2, 0.0, 0.1, None), (0.25, 0.35, 0.2, 0.2, 0.1, None)),
    Phase(112_500, "consolidation", (0.25, 0.35, 0.2, 0.2, 0.1, None)),
]
#: The same fields of the active curriculum, for 25,000 tracks.
CURRICULUM = [
    Phase(0, "clean", (1.0, 0.0, 0.0, 0.0, 0.0, None)),
    Phase(10_000, "noise_rir_ramp", (1.0, 0.0, 0.0, 0.0, 0.0, 1 / 3), (0.4, 0.3, 0.3, 0.0, 0.0, 2 / 3)),
    Phase(30_000, "combined_ramp", (0.4, 0.3, 0.3, 0.0, 0.0, 2 / 3), (0.1, 0.35, 0.3, 0.25, 0.0, 1.0)),
    Phase(60_000, "full_distribution", (0.1, 0.35, 0.3, 0.25, 0.0, 1.0)),
]
#: SNR bins (name, low, high) in dB, hardest first, and their usual weights.
SNR_BINS = (("very_hard", 0.0, 5.0), ("hard", 5.0, 10.0), ("medium", 10.0, 20.0), ("easy", 20.0, 30.0))
SNR_WEIGHTS = (0.40, 0.30, 0.20, 0.10)


def scaled(boundary: int, tracks: int, base: int = 25_000) -> int:
    """A boundary for another number of tracks: integer division."""
    return boundary * tracks // base


def rescale(phases: list[Phase], tracks: int, base: int = 25_000) -> list[Phase]:
    return [Phase(scaled(p.start, tracks, base), p.name, p.a, p.b) for p in phases]


def consistency_phases(steps: int = CONSISTENCY_RUN) -> list[Phase]:
    """The consistency schedule for a run of so many steps; boundaries round half to even."""
    if steps < 7:
        raise ValueError("too few steps for the schedule")
    return [Phase(round_even(steps * p.start / CONSISTENCY_RUN), p.name, p.a, p.b) for p in CONSISTENCY]


def noise_phases(kind: str, ends: dict[str, int], consistency: float) -> list[Phase]:
    """The older configurable schedules: 'noise', and 'noise-rir' with rooms after a steady spell."""
    clean = (1.0, 0.0, 0.0, 0.0, 0.0, None)
    noisy = (0.25, 0.75, 0.0, 0.0, consistency, None)
    out = [Phase(0, "clean", clean), Phase(ends["clean"], "noise_ramp", clean, noisy), Phase(ends["noise_ramp"], "noise_steady", noisy)]
    if kind == "noise":
        return out
    if kind != "noise-rir":
        raise ValueError(f"unknown schedule {kind!r}")
    rooms, both = (0.25, 0.55, 0.2, 0.0, consistency, None), (0.25, 0.35, 0.2, 0.2, consistency, None)
    return [*out, Phase(ends["noise_steady"], "rir_ramp", noisy, rooms), Phase(ends["rir_ramp"], "combined_ramp", rooms, both), Phase(ends["combined_ramp"], "consolidation", both)]


def round_even(value: float) -> int:
    """Python's rounding, half to even: boundaries given as shares of a run."""
    return round(value)


def _progress(step: Column, p: Phase, stop: int) -> Column:
    return (step - p.start) / F.lit(float(stop - p.start))


def piecewise(step: Column, phases: list[Phase], field: int) -> Column:
    out = None
    for i, p in reversed(list(enumerate(phases))):
        a = p.a[field]
        if a is None:
            value = F.lit(None).cast("double")
        elif p.b is None:
            value = F.lit(float(a))
        else:
            value = F.lit(float(a)) + _progress(step, p, phases[i + 1].start) * F.lit(float(p.b[field] - a))
        out = value if out is None else F.when(step < phases[i + 1].start, value).otherwise(out)
    return out


def phase_name(step: Column, phases: list[Phase]) -> Column:
    out = F.lit(phases[-1].name)
    for i in range(len(phases) - 2, -1, -1):
        out = F.when(step < phases[i + 1].start, phases[i].name).otherwise(out)
    return out


def py_piecewise(step: float, phases: list[Phase], field: int) -> float | None:
    i = max(k for k, p in enumerate(phases) if step >= p.start)
    p = phases[i]
    if p.b is None or p.a[field] is None:
        return p.a[field]
    return p.a[field] + (step - p.start) / (phases[i + 1].start - p.start) * (p.b[field] - p.a[field])


def sql_piecewise(step: str, phases: list[Phase], field: int) -> str:
    parts = []
    for i, p in enumerate(phases):
        a = p.a[field]
        value = "CAST(NULL AS DOUBLE)" if a is None else f"CAST({a!r} AS DOUBLE)"
        if p.b is not None and a is not None:
            value = f"({value} + ({step} - {p.start}) / CAST({phases[i + 1].start - p.start} AS DOUBLE) * CAST({float(p.b[field] - a)!r} AS DOUBLE))"
        parts.append(f"WHEN {step} < {phases[i + 1].start} THEN {value}" if i + 1 < len(phases) else f"ELSE {value}")
    return "CASE " + " ".join(parts) + " END" if len(parts) > 1 else parts[0].removeprefix("ELSE ")


def learning_rate_multiplier(step: Column, warmup=500, hold=60_000, linear=140_000, middle=0.5, total=225_000, final=0.05) -> Column:
    """Warm-up from 0, hold at 1, linear to `middle`, then half a cosine to `final`."""
    x = step.cast("double")
    tail = F.least(F.lit(1.0), (x - linear) / float(total - linear))
    return (
        F.when(x < warmup, x / float(warmup)).when(x < hold, F.lit(1.0))
        .when(x < linear, 1 - (x - hold) / float(linear - hold) * (1 - middle))
        .otherwise(F.lit(final) + (middle - final) * 0.5 * (1 + F.cos(F.pi() * tail)))
    )


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    """Warm-up counted from step one, then half a cosine to 0; also of effective steps."""
    if not 0 < warmup < total:
        raise ValueError("warm-up must end inside the run")
    x = step.cast("double")
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - warmup) / float(max(1, total - warmup))))
    return F.when(x < warmup, (x + 1) / float(warmup)).otherwise(0.5 * (1 + F.cos(F.pi() * p)))


def distillation_weight(step: Column, start: int = 15_000, stop: int = 30_000, most: float = 0.1) -> Column:
    """0, a linear ramp, then `most`."""
    return F.when(step <= start, F.lit(0.0)).when(step >= stop, F.lit(float(most))).otherwise((step - start) / float(stop - start) * most)


def family_coefficients(audio: Column, digits: Column, boundary: Column, weight: Column) -> dict[str, Column]:
    """Shares of the three loss families when digits weigh `weight` each."""
    total = audio + weight * digits + boundary
    return {"audio": audio / total, "digits": weight * digits / total, "boundary": boundary / total}


def batch_exposure(codebooks: int, tracks: int, updates: int = 225_000, documents: int = 160, seconds: float = 2.0, rate: int = 25) -> dict[str, int]:
    """Sizes that follow from a number of codebooks: loss weight, targets, document length, totals of a run."""
    frames = int(seconds * rate)
    targets = frames * codebooks
    return dict(weight=4 * codebooks, targets=targets, length=targets + 8, batch_targets=documents * targets, exposures=updates * documents, per_track=updates * documents // tracks)


def background_probability(noise: Column, noise_rir: Column) -> Column:
    """How often any noise is applied: alone or with a room."""
    return noise + noise_rir


def room_probability(rir: Column, noise_rir: Column) -> Column:
    """How often a room is applied: alone or with noise."""
    return rir + noise_rir
