"""The adaptive curriculum: a table of transitions over what a run's probes show.

A run is in one of three phases.  While `gated` its clock stands at the end of
the clean phase; in `open` the clock runs behind the global step by a lag; while
`recovering` it stands again.  A probe is first read (what does it show, in this
phase?), and the table says where a reading leads.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Limits(NamedTuple):
    nominal: int = 70_000
    threshold: float = 0.5
    extra: int = 30_000
    drop: float = 0.05
    good_needed: int = 2
    timeout: int = 20_000

    @property
    def clean(self) -> int:
        """The end of the clean phase, in proportion to the nominal length."""
        return round(self.nominal * 20_000 / 70_000)

    @property
    def hard_limit(self) -> int:
        return self.nominal + self.extra + self.timeout


class State(NamedTuple):
    phase: str = "gated"
    lag: int = 0  # of the running clock
    stopped: int = 0  # where the clock stands while recovering
    since: int = 0  # the step at which recovery began
    streak: int = 0  # good probes in a row while recovering
    baseline: float = 0.0
    recovered: bool = False  # a recovery was begun: the weight is halved, and there is no other


class Probe(NamedTuple):
    step: int
    exact: float
    top1: float
    active: bool


#: (phase, reading) to (phase after, event, failure).
TRANSITIONS = {
    ("gated", "early"): ("gated", None, None),
    ("gated", "reached"): ("open", "gate_opened", None),
    ("gated", "missed"): ("gated", "gate_waiting", None),
    ("gated", "overdue"): ("gated", None, "exact accuracy stayed low beyond the gate allowance"),
    ("open", "fine"): ("open", None, None),
    ("open", "dropped"): ("recovering", "recovery_started", None),
    ("open", "dropped again"): ("open", None, "top-1 dropped a second time"),
    ("recovering", "healed"): ("open", "recovery_completed", None),
    ("recovering", "not yet"): ("recovering", "recovery_waiting", None),
    ("recovering", "overdue"): ("recovering", None, "did not recover within the time allowed"),
}


def effective_step(state: State, step: int, limits: Limits) -> int:
    """The schedule's step at a global step."""
    if state.phase == "recovering":
        return state.stopped
    start = min(step, limits.clean)
    return start if state.phase == "gated" else min(limits.nominal, max(start, step - state.lag))


def multiplier(state: State) -> float:
    """Of the consistency weight."""
    return 0.5 if state.recovered else 1.0


def advance(state: State, probe: Probe, limits: Limits) -> tuple[State, str | None, str | None]:
    """The state after a probe, its event and its failure."""
    good = probe.top1 >= state.baseline - limits.drop
    streak = state.streak + 1 if good else 0
    waited = probe.step - (limits.clean if state.phase == "gated" else state.since)
    reading = {
        "gated": lambda: "early" if waited < 0 else "reached" if probe.exact >= limits.threshold else "overdue" if waited >= limits.extra else "missed",
        "open": lambda: "fine" if good or not probe.active else "dropped again" if state.recovered else "dropped",
        "recovering": lambda: "healed" if streak >= limits.good_needed else "overdue" if waited >= limits.timeout else "not yet",
    }[state.phase]()
    phase, event, failure = TRANSITIONS[state.phase, reading]
    changes = {
        "reached": lambda: dict(lag=probe.step - limits.clean, baseline=probe.top1),
        "dropped": lambda: dict(stopped=effective_step(state, probe.step, limits), since=probe.step, streak=0, recovered=True),
        "healed": lambda: dict(lag=probe.step - state.stopped, streak=0),
        "not yet": lambda: dict(streak=streak),
        "overdue": lambda: dict(streak=streak),
    }.get(reading, dict)()
    return state._replace(phase=phase, **changes), event, failure


EVENTS = "run_id string, global_step long, event string, failure string, effective_step long, multiplier double"
STATE = "phase string, lag long, stopped long, since long, streak long, baseline double, recovered boolean"


def _trace(run_id, state: State, rows: pd.DataFrame, limits: Limits) -> tuple[State, pd.DataFrame]:
    out = []
    for r in rows.sort_values("global_step").itertuples():
        step = int(r.global_step)
        state, event, failure = advance(state, Probe(step, float(r.exact), float(r.top1), bool(r.active)), limits)
        out.append((run_id, step, event, failure, effective_step(state, step, limits), multiplier(state)))
    return state, pd.DataFrame(out, columns=[x.split()[0] for x in EVENTS.split(", ")])


def curriculum_events(probes: DataFrame, **limits) -> DataFrame:
    """Events of each run's probes (run_id, global_step, exact, top1, active): one run's probes are a few hundred rows."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return _trace(key[0], State(), pdf, Limits(**limits))[1]

    return probes.groupBy("run_id").applyInPandas(run, EVENTS)


def curriculum_stream(probes: DataFrame, **limits) -> DataFrame:
    """The same over a stream: a run's state goes on from batch to batch."""

    def run(key, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = State(*held.get) if held.exists else State()
        for p in parts:
            state, rows = _trace(key[0], state, p, Limits(**limits))
            yield rows
        held.update(tuple(state))

    return probes.groupBy("run_id").applyInPandasWithState(run, EVENTS, STATE, "append", GroupStateTimeout.NoTimeout)
