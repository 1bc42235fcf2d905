"""Settings that a call may leave out, and names."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from survista.functions.clicks import CLICKS, Span, span

STEPS = (CLICKS, CLICKS // 4, CLICKS // 12, CLICKS // 60)
STEP = CLICKS // 4


def valid_name(name: str) -> str:
    if not isinstance(name, str) or not name or re.search(r"^ | $|  |[\x00-\x1f\x7f]", name):
        raise ValueError(f"{name!r} is no name: it is empty, has outer or double spaces, or control characters")
    return name


def time_step(scale) -> int:
    """Clicks of a time scale: a year, a quarter, a month, or a sixtieth of a year."""
    if scale is None:
        return STEP
    clicks = scale.clicks if isinstance(scale, Span) else span(scale).clicks
    if clicks not in STEPS:
        raise ValueError("the time scale must be 1, 1/4, 1/12 or 1/60 of a year")
    return clicks


@dataclass(frozen=True)
class Settings:
    overdispersion: float | None = None
    time_scale: object = None

    def __post_init__(self):
        if self.overdispersion is not None:
            valid_overdispersion(self.overdispersion)
        time_step(self.time_scale)


def settings(overdispersion: float | None = None, time_scale=None) -> Settings:
    return Settings(overdispersion, time_scale)


def is_settings(x) -> bool:
    return isinstance(x, Settings)


def valid_overdispersion(v) -> float:
    if isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v) or v <= 0:
        raise ValueError("overdispersion must be a finite number above 0")
    return float(v)


def resolve(given: Settings | None, overdispersion, time_scale) -> tuple[float, int]:
    """What a call says goes before its settings; overdispersion has no default."""
    given = given or Settings()
    omega = overdispersion if overdispersion is not None else given.overdispersion
    if omega is None:
        raise ValueError("overdispersion must be given, in the call or in its settings")
    return valid_overdispersion(omega), time_step(time_scale if time_scale is not None else given.time_scale)
