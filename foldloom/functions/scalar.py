"""Small expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Significance levels and their marks.
STARS = ((0.001, "***"), (0.01, "**"), (0.05, "*"))


def stars(p: Column) -> Column:
    out = F.when(F.lit(False), "")
    for level, mark in STARS:
        out = out.when(p < level, mark)
    return out.otherwise("ns")


def mean_and_spread(value: str) -> Column:
    """An aggregate: ``0.123±0.045`` with the population's standard deviation; null, not text, for no rows."""
    return F.when(F.count(value) > 0, F.format_string("%.3f±%.3f", F.avg(value), F.stddev_pop(value)))


def above(x: Column, threshold: float) -> Column:
    """Strictly greater; NaN is not."""
    return (x > threshold) & ~F.isnan(x)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))
