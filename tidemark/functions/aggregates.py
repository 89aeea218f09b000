"""Aggregates over series at a point, with the number semantics of the query language: comparisons with NaN are false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def least(value: Column) -> Column:
    """The minimum without NaN; +Inf if every value is NaN."""
    return F.coalesce(F.min(F.when(~F.isnan(value), value)), F.lit(INF))


def greatest(value: Column) -> Column:
    """The maximum without NaN; -Inf if every value is NaN."""
    return F.coalesce(F.max(F.when(~F.isnan(value), value)), F.lit(-INF))


AGGREGATES = {
    "sum": F.sum,
    "count": lambda v: F.count("*").cast("double"),
    "avg": F.avg,
    "min": least,
    "max": greatest,
}
