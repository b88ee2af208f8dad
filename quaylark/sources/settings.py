"""Configuration documents and their checks, on the driver."""

from __future__ import annotations

import copy

from ..functions.hashing import fingerprint
from ..functions.schedules import batch_exposure, scaled

REQUIRED = ("architecture", "vocabulary", "tokenizer", "config", "catalogue_fingerprint", "code_mapping_fingerprint", "profile")
CODEBOOKS = (2, 4, 6, 8)


def load(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


def save(path: str, config: dict) -> None:
    import yaml

    with open(path, "w") as f:
        yaml.safe_dump(config, f, sort_keys=False)


def with_overrides(config: dict, **values) -> dict:
    """A deep copy with dotted keys set (train__max_steps sets train.max_steps) where a value is given."""
    out = copy.deepcopy(config)
    for key, value in values.items():
        if value is None:
            continue
        *path, last = key.split("__")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def check_metadata(meta: dict, architecture: str) -> dict:
    missing = [k for k in REQUIRED if k not in meta]
    if missing:
        raise ValueError(f"missing metadata: {', '.join(missing)}")
    if meta["architecture"] != architecture:
        raise ValueError(f"architecture {meta['architecture']!r}, not {architecture!r}")
    return meta


def check_profile(profile: dict) -> dict:
    """Codebooks, loss weight and cohort of a run belong together."""
    q = profile["codebooks"]
    if q not in CODEBOOKS:
        raise ValueError(f"codebooks must be one of {CODEBOOKS}")
    want = batch_exposure(q, profile["tracks"])
    if profile.get("digit_weight", want["weight"]) != want["weight"]:
        raise ValueError(f"digit weight must be {want['weight']}")
    return {**profile, **want, "fingerprint": fingerprint(profile)}


def scaled_steps(boundaries: list[int], tracks: int, base: int = 25_000) -> list[int]:
    return [scaled(b, tracks, base) for b in boundaries]


def unexpected_keys(metrics: dict, allowed: set[str]) -> list[str]:
    return sorted(set(metrics) - allowed)
