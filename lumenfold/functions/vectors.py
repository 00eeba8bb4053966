"""Vectors as columns, and thresholds of coverage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, other dimensions or a zero norm."""
    real = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.coalesce(F.when(real & (norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))), F.lit(0.0))


def sane_thresholds(high: float | None, low: float | None) -> tuple[float, float]:
    """(low, high); unset or 0 takes the default, and so do both if they are crossed."""
    high, low = high or rules.COVERED_SIMILARITY, low or rules.NEW_SIMILARITY
    return (rules.NEW_SIMILARITY, rules.COVERED_SIMILARITY) if low > high else (low, high)


def sane_threshold_columns(high: Column, low: Column) -> Column:
    """The same of columns: struct(low, high)."""
    unset = lambda c, default: F.coalesce(F.nullif(c.cast("double"), F.lit(0.0)), F.lit(default))
    high, low = unset(high, rules.COVERED_SIMILARITY), unset(low, rules.NEW_SIMILARITY)
    crossed = low > high
    return F.struct(F.when(crossed, rules.NEW_SIMILARITY).otherwise(low).alias("low"), F.when(crossed, rules.COVERED_SIMILARITY).otherwise(high).alias("high"))


def coverage(similarity: Column, low: float, high: float) -> Column:
    """covered, judge (a second opinion decides) or new."""
    return F.when(similarity >= high, "covered").when(similarity >= low, "judge").otherwise("new")
