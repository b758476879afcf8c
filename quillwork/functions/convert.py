"""Safe casts, bounds, times, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(x: Column) -> Column:
    """M1: null for what is no number."""
    return x.try_cast("double")


def bounded_int(x: Column, low: int, high: int, default: int) -> Column:
    """an integer within bounds, the default for what is none."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x.try_cast("int"), F.lit(default))))


def bounded(x: Column, low: float, high: float, default: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x.try_cast("double"), F.lit(default))))


def truthy(x: Column) -> Column:
    """is the text one of 1, true, yes, on?"""
    return F.coalesce(F.lower(F.trim(x)).isin("1", "true", "yes", "on"), F.lit(False))


def signed_clamp(v: Column) -> Column:
    """Negative v as (v + 1) / 2, then into [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v < 0, (v + 1) / 2).otherwise(v)))


def extension(x: Column) -> Column:
    """S3: lowered, with a leading dot; null for an empty one."""
    low = F.lower(F.trim(x))
    return F.when(low == "", None).when(low.startswith("."), low).otherwise(F.concat(F.lit("."), low))


def fraction(text: Column) -> Column:
    """`num/den` or a number; null if it isn't positive."""
    parts = F.split(text, "/")
    value = F.when(F.size(parts) == 2, F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double"))).otherwise(text.try_cast("double"))
    return F.when(value > 0, value)


def cache_key(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 16)


def source_time(t: Column, offset: float, back: bool = False) -> Column:
    """Between source and analysis time, never below 0, to six digits."""
    return F.round(F.greatest(F.lit(0.0), t + offset if back else t - offset), 6)


def clamped_time(t: Column, duration: Column) -> Column:
    """D3: a time beyond the end is the end if it is within a tolerance of 2 %, 0.05 to 0.25 s; else null."""
    slack = F.greatest(F.lit(0.05), F.least(F.lit(0.25), duration * 0.02))
    return F.when(t < 0, None).when(t <= duration, t).when(t <= duration + slack, duration)


def frame_time(index: Column, fps: Column, times: Column | None = None) -> Column:
    """The listed time of a frame, else index over fps."""
    own = F.try_divide(index.cast("double"), fps)
    return own if times is None else F.coalesce(F.try_element_at(times, index + 1), own)


def iso_second(t: Column) -> Column:
    """UTC to the second with a Z."""
    return F.date_format(F.date_trunc("second", t), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def has_all(actual: Column, expected: Column) -> Column:
    """does the list hold all that is expected?"""
    return F.size(F.array_except(expected, actual)) == 0


def has_any(actual: Column, expected: Column) -> Column:
    """does the list hold any of what is expected?"""
    return F.arrays_overlap(actual, expected)


def hit_marker_score(marked: Column, total: Column) -> Column:
    """M3: 0 below the gates of 120 and 500 pixels, else 0.45 + marked / 900 + total / 50000, at most 0.99."""
    return F.when((marked < 120) | (total < 500), F.lit(0.0)).otherwise(F.least(F.lit(0.99), F.lit(0.45) + marked / 900 + total / 50000))


def budget_profile(stage: Column, index: Column, measured: Column, cap: float) -> Column:
    """M7: the ladder index to use: one further down if the measured use is above the cap."""
    return F.when(measured > cap, index + 1).otherwise(index)
