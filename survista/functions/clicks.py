"""Time in clicks: 534360 to a year, 1464 or 1460 to a day, so that days, months and quarters are whole.

Instants count clicks from year 0, spans are differences. All arithmetic is exact on whole numbers;
years are clicks times the reciprocal, taken last.
"""

from __future__ import annotations

import calendar
import datetime as dt
import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CLICKS = 534360
PER_CLICK = 1.0 / CLICKS
FIRST, LAST = 1000 * CLICKS, 3000 * CLICKS
LONGEST = 2000 * CLICKS


@dataclass(frozen=True, order=True)
class Instant:
    """A point in time, in clicks."""

    clicks: int

    @property
    def years(self) -> float:
        return self.clicks * PER_CLICK

    def __sub__(self, other):
        if isinstance(other, Instant):
            return Span(self.clicks - other.clicks)
        return Instant(self.clicks - other.clicks)

    def __add__(self, other: Span) -> Instant:
        return Instant(self.clicks + other.clicks)


@dataclass(frozen=True, order=True)
class Span:
    """A length of time, in clicks."""

    clicks: int

    @property
    def years(self) -> float:
        return self.clicks * PER_CLICK


def half_even(x: float) -> int:
    return int(round(x))


def instant(when: float | int | dt.date | Instant) -> Instant:
    """From years (2015.5), a date (its start) or an instant."""
    if isinstance(when, Instant):
        out = when
    elif isinstance(when, dt.date):
        day = 1460 if calendar.isleap(when.year) else 1464
        out = Instant(when.year * CLICKS + (when.timetuple().tm_yday - 1) * day)
    else:
        if isinstance(when, bool) or not math.isfinite(when):
            raise ValueError(f"{when!r} is not a point in time")
        out = Instant(half_even(when * CLICKS))
    if not FIRST <= out.clicks <= LAST:
        raise ValueError(f"{when!r} is outside the years 1000 to 3000")
    return out


def span(years: float | int | Span) -> Span:
    out = years if isinstance(years, Span) else Span(half_even(years * CLICKS))
    if abs(out.clicks) > LONGEST:
        raise ValueError(f"{years!r} is longer than 2000 years")
    return out


def date_of(when: Instant) -> dt.date:
    year, rest = divmod(when.clicks, CLICKS)
    return dt.date(year, 1, 1) + dt.timedelta(days=rest // (1460 if calendar.isleap(year) else 1464))


def mid_day(clicks: int) -> int:
    """Midday of the day that an instant lies in."""
    year, rest = divmod(clicks, CLICKS)
    day = 1460 if calendar.isleap(year) else 1464
    return year * CLICKS + rest // day * day + day // 2


def leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def day_length(year: Column) -> Column:
    return F.when(leap(year), F.lit(1460)).otherwise(F.lit(1464)).cast("long")


def clicks_of_date(date: Column) -> Column:
    """Clicks at the start of a date."""
    year = F.year(date).cast("long")
    return year * CLICKS + (F.dayofyear(date) - 1) * day_length(year)


def mid_day_column(clicks: Column) -> Column:
    year = F.floor(clicks / F.lit(CLICKS)).cast("long")
    rest = F.pmod(clicks, F.lit(CLICKS))
    day = day_length(year)
    return year * CLICKS + (rest - rest % day) + (day / 2).cast("long")


def years(clicks: Column) -> Column:
    return clicks.cast("double") * F.lit(PER_CLICK)


def halve(v: Column) -> Column:
    """Half of a whole number of clicks, an odd one to the nearer even half."""
    return F.shiftright(v + F.shiftright(v, 1).bitwiseAND(F.lit(1).cast("long")), 1)


def halve_int(v: int) -> int:
    return (v + ((v >> 1) & 1)) >> 1
