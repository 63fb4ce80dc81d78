from __future__ import annotations

from pyspark.sql import Column, functions as F


def quantize(x: Column, digits: int = 6) -> Column:
    """Round by floor, which every engine computes alike (``round`` breaks ties differently)."""
    scale = float(10 ** digits)
    return F.floor(x * scale + F.lit(0.5)) / F.lit(scale)


def holds(condition: Column) -> Column:
    """A condition as a total boolean: NULL counts as not satisfied."""
    return F.coalesce(condition, F.lit(False))


def epoch_s(ts: Column) -> Column:
    return F.unix_seconds(ts)


def lag_minutes(sent_at: Column, event_time: Column) -> Column:
    """Exact delay in minutes, to the microsecond."""
    return (F.unix_micros(sent_at) - F.unix_micros(event_time)) / F.lit(60e6)


def decay_factor(seconds: Column, half_life_s: Column | float) -> Column:
    half_life = half_life_s if isinstance(half_life_s, Column) else F.lit(float(half_life_s))
    return F.exp(-F.lit(0.6931471805599453) * seconds / half_life)
