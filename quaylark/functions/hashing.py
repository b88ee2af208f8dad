"""Keyed draws: every random choice is a hash of its key, so it repeats on any run, engine and partitioning."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(*parts) -> Column:
    return F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))


def stable_uint64(*parts) -> Column:
    """First 8 bytes, big-endian, of the SHA-256 of the parts joined by ':', as DECIMAL(20,0)."""
    return F.conv(F.substring(F.sha2(_text(*parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def stable_uniform(*parts) -> Column:
    """The same draw in [0, 1)."""
    return stable_uint64(*parts).cast("double") / F.pow(F.lit(2.0), F.lit(64.0))


def stable_mod(n: Column, *parts) -> Column:
    """The draw modulo n, as a long."""
    return (stable_uint64(*parts) % n.cast("decimal(20,0)")).cast("long")


def py_uint64(*parts) -> int:
    return int.from_bytes(hashlib.sha256(":".join(map(str, parts)).encode()).digest()[:8], "big")


def py_uniform(*parts) -> float:
    return py_uint64(*parts) / 2**64


def sql_uint64(*parts: str) -> str:
    """DuckDB text of the draw; parts are SQL expressions."""
    return "('0x' || left(sha256(concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")), 16))::UBIGINT"


def sql_uniform(*parts: str) -> str:
    return f"(CAST({sql_uint64(*parts)} AS DOUBLE) / pow(2.0, 64))"


def track_id(path: Column) -> Column:
    """First 20 hex digits of the path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 20)


def canonical_json(value) -> str:
    """Sorted keys, no white space: the text that fingerprints are made of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def fingerprint(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def waveform_digest(samples, rate: int) -> str:
    """SHA-256 over rate, shape and little-endian float32 samples."""
    import numpy as np

    x = np.asarray(samples, dtype="<f4")
    return hashlib.sha256(f"{rate}:{x.shape}:".encode() + x.tobytes()).hexdigest()
