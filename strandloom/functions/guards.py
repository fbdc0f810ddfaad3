"""Checks on parameters, made before a plan is built."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
TIERS = ("t0_private", "t1_shared", "t2_public")


def duration_seconds(text: str) -> int:
    """``24h``, ``1w``, ``90s`` to seconds; anything else is refused."""
    m = re.fullmatch(r"\s*(\d+)\s*([smhdw])\s*", text)
    if not m:
        raise ValueError(f"no duration: {text!r}")
    return int(m[1]) * _UNITS[m[2]]


def privacy_gate(asked: str, most: str) -> str:
    """The asked tier, refused above the most that is allowed."""
    if asked not in TIERS or most not in TIERS:
        raise ValueError("unknown tier")
    if TIERS.index(asked) > TIERS.index(most):
        raise ValueError(f"{asked} is above {most}")
    return asked


def clamped(values: Mapping[str, float], defaults: Mapping[str, tuple[float, float, float]]) -> dict[str, float]:
    """Settings within (default, low, high); NaN and missing ones take the default."""
    out = {}
    for key, (default, low, high) in defaults.items():
        v = values.get(key, default)
        out[key] = default if v is None or math.isnan(v) else min(high, max(low, v))
    return out


def unique_configs(ids: list[str]) -> list[str]:
    """Configuration ids, refused where empty or doubled."""
    if any(not i.strip() for i in ids) or len(set(ids)) != len(ids):
        raise ValueError("configuration ids must be given once each")
    return ids
