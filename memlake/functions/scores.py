"""Scores as columns: decay, half-lives, fusion, boosts, damping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of ranking.
K, ALPHA, KG_BOOST, NOISE = 60, 0.25, 1.3, 0.05


def decay(days: Column, half_life: Column, retrievals: Column, pinned: Column) -> Column:
    """From 1 down to 0.05, slower for what is often retrieved; pinned stays at 1."""
    faded = 1 / (1 + days / (9 * half_life * (1 + 0.3 * F.log(1 + retrievals))))
    return F.when(pinned, 1.0).otherwise(F.greatest(F.lit(0.05), faded))


def half_life(importance: Column) -> Column:
    """Days from importance (1 to 10), linear from 7 at 1 over 30 at 5 to 90 at 10; 30 where it is unknown."""
    c = F.least(F.greatest(importance, F.lit(1.0)), F.lit(10.0))
    days = F.round(F.when(c <= 5, 7 + (c - 1) * (23 / 4)).otherwise(30 + (c - 5) * 12), 2)
    return F.when(importance.isNull(), 30.0).otherwise(days)


def fused(first: Column, second: Column, alpha: float = ALPHA, k: int = K) -> Column:
    """Weighted reciprocal ranks (from 0); a leg without the row adds nothing."""
    return F.coalesce(alpha / (k + first), F.lit(0.0)) + F.coalesce((1 - alpha) / (k + second), F.lit(0.0))


def importance_boost(importance: Column) -> Column:
    return 1 + F.least(F.greatest(F.coalesce(importance, F.lit(0.0)), F.lit(0.0)), F.lit(10.0)) / 20


def recency_boost(days: Column) -> Column:
    return 0.7 + 0.3 * F.exp(-0.023 * days)


def damped(multiplier: Column, weight: float) -> Column:
    """A multiplier as much as a profile weighs it, from 0.01 to 100."""
    return F.least(F.greatest(1 + (multiplier - 1) * weight, F.lit(0.01)), F.lit(100.0))


#: How fast kinds of facts fade a day; others like preferences.
FADING = {"constraint": 0.0019, "preference": 0.0077, "life_event": 0.0, "casual": 0.0231, "meeting": 0.0046}


def faded_fact(confidence: Column, importance: Column, days: Column, rate: Column) -> Column:
    return confidence * importance * F.exp(-rate * days)


def rounded(x: Column, digits: int) -> Column:
    """As `F.round` of doubles, for very many rows: by whole numbers, and by decimals only where half a unit is near or the number is large."""
    scaled = x * 10.0**digits
    whole = F.floor(scaled + 0.5)
    sure = (F.abs(scaled) < 2.0**30) & (F.abs(scaled - whole) < 0.499999)
    return F.when(sure, whole / F.lit(10.0**digits)).otherwise(F.round(x, digits))
