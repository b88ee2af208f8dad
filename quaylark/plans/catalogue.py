"""Registered queries and their SQL."""

from __future__ import annotations

from . import decoding, evaluation, identity, jobs, listings, preparation, schedules, signals, sources

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (evaluation, identity, preparation, decoding, signals, schedules, jobs, sources, listings):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
