"""Scores, labels and progress from distances and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Knots of the calibrated curve (distance, score), and label floors with their colours.
CURVE = ((0.5, 1.0), (0.7, 0.9), (0.9, 0.6), (1.1, 0.2), (1.2, 0.0))
LABELS = ((0.85, "Excellent Match", "green"), (0.65, "Strong Match", "teal"), (0.45, "Good Match", "yellow"))
LAST_LABEL = ("Potential Lead", "gray")
LINEAR = (0.5, 1.15)


def calibrated(d: Column) -> Column:
    """Score in [0, 1], piecewise linear between the knots of CURVE."""
    out = F.when(d <= CURVE[0][0], F.lit(1.0))
    for (d0, s0), (d1, s1) in zip(CURVE, CURVE[1:], strict=False):
        out = out.when(d <= d1, F.lit(s0) - (d - F.lit(d0)) / F.lit(d1 - d0) * F.lit(s0 - s1))
    return out.otherwise(F.lit(0.0))


def percent(score: Column) -> Column:
    return F.round(score * 100, 1)


def linear(d: Column) -> Column:
    """0 to 100, linear between the two distances of LINEAR."""
    lo, hi = LINEAR
    return F.when(d <= lo, F.lit(100.0)).when(d >= hi, F.lit(0.0)).otherwise((F.lit(hi) - d) / F.lit(hi - lo) * 100)


def label(score: Column) -> Column:
    out = F
    for floor, name, _ in LABELS:
        out = out.when(score >= floor, F.lit(name))
    return out.otherwise(F.lit(LAST_LABEL[0]))


def colour(score: Column) -> Column:
    out = F
    for floor, _, name in LABELS:
        out = out.when(score >= floor, F.lit(name))
    return out.otherwise(F.lit(LAST_LABEL[1]))


def progress(current: Column, total: Column) -> Column:
    """Percent done, 100 at most; 0 for an unknown total."""
    return F.when(total > 0, F.least(F.round(current / total * 100, 1), F.lit(100.0))).otherwise(F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


METRICS = {"squared_l2": squared_l2, "l2": lambda a, b: F.sqrt(squared_l2(a, b)), "cosine": cosine_distance}
