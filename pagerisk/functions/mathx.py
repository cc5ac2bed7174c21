"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def logit(p: Column, eps: float = EPS) -> Column:
    safe = clamp(p, eps, 1.0 - eps)
    return F.log(safe / (F.lit(1.0) - safe))


def sigmoid(z: Column) -> Column:
    """Stable for any z: half of 1 + tanh(z / 2)."""
    return (F.tanh(z / F.lit(2.0)) + F.lit(1.0)) / F.lit(2.0)


def temper(p: Column, temperature: Column | float) -> Column:
    """Apply a temperature to a probability."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return sigmoid(logit(p) / t)


def softmax_positive(z0: Column, z1: Column, eps: float = 1e-6) -> Column:
    """P(1) of a two-class softmax, clipped away from 0 and 1."""
    return clamp(sigmoid(z1 - z0), eps, 1.0 - eps)


def finite_or_half(p: Column) -> Column:
    """NaN and infinities become 0.5."""
    return F.when(F.isnan(p) | (F.abs(p) == float("inf")), F.lit(0.5)).otherwise(p)


def unit(p: Column) -> Column:
    """Clamp to [0, 1], NaN first turned into 0.5."""
    return clamp(finite_or_half(p), 0.0, 1.0)


def mean_of(*columns: Column) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total / F.lit(float(len(columns)))
