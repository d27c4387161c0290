"""Numeric expressions: decay, saturation, levels and vector measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level names by least score, in falling order.
LEVELS = ((0.8, "Expert"), (0.4, "Competent"), (0.1, "Novice"))


def age_days(ts: Column, reference: Column) -> Column:
    """Fractional days from `ts` to `reference`, both of one timestamp type."""
    return F.timestamp_diff("MICROSECOND", ts, reference) / F.lit(86_400_000_000)


def half_life(days: Column, half: Column | float) -> Column:
    return F.pow(F.lit(0.5), days / half)


def decayed_weight(base: Column, days: Column, reinforcements: Column, half: float = 90.0, factor: float = 0.3, exponent: float = 0.5) -> Column:
    """An edge's weight after `days`; reinforcements lengthen the half-life, negative ages count as none."""
    longer = F.lit(half) * F.pow(1 + factor * reinforcements, F.lit(exponent))
    return base * half_life(F.greatest(days, F.lit(0.0)), longer)


def age_factor(days: Column, half: float = 90.0, floor: float = 0.3) -> Column:
    """What retrieval scores are multiplied by; 1 for unknown and future times."""
    return F.when(days.isNull() | (days < 0), F.lit(1.0)).otherwise(F.greatest(half_life(days, half), F.lit(floor)))


def stepped_decay(confidence: Column, idle_days: Column, step: float = 0.05, every: int = 30, floor: float = 0.2) -> Column:
    steps = F.floor(idle_days / every)
    return F.when(idle_days >= every, F.greatest(F.lit(floor), confidence - step * steps)).otherwise(confidence)


def log_saturation(n: Column, full: int = 100) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.least(F.ln(n + 1.0) / F.ln(F.lit(full + 1.0)), F.lit(1.0)))


def linear_saturation(n: Column, full: int = 100) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.least(n / full, F.lit(1.0)))


def level(score: Column) -> Column:
    out = F.lit("Unknown")
    for least, name in reversed(LEVELS):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths and for zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot(a, b) / norms)


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))
