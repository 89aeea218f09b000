"""Functions over the window of a series that ends at a grid point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.aggregates import greatest, least
from tidemark.operators import sliding
from tidemark.operators.grid import Grid, each_point, neighbours
from tidemark.sources.model import Labelled

#: From how many grid points a sample reaches on windows are made of running aggregates (see operators.sliding). Sums run
#: in another order there, so they may differ in their last digits.
MANY_POINTS = 64

SIMPLE: dict[str, Callable[[Column], Column]] = {
    "avg_over_time": F.avg,
    "sum_over_time": F.sum,
    "count_over_time": lambda v: F.count("*").cast("double"),
    "min_over_time": least,
    "max_over_time": greatest,
    "stddev_over_time": F.stddev_pop,
}
V = "value"
#: The functions by what parts of a window are made of.
PARTS: dict[str, Callable[[], sliding.Parts]] = {
    "avg_over_time": lambda: sliding.sums({"s": F.sum(V), "c": F.count("*")}, lambda x: x("s") / x("c")),
    "sum_over_time": lambda: sliding.sums({"s": F.sum(V)}, lambda x: x("s")),
    "count_over_time": lambda: sliding.sums({"c": F.count("*").cast("double")}, lambda x: x("c")),
    "min_over_time": lambda: sliding.commutative({"s": least(F.col(V))}, {"s": F.min}, F.least, lambda x: x("s")),
    "max_over_time": lambda: sliding.commutative({"s": greatest(F.col(V))}, {"s": F.max}, F.greatest, lambda x: x("s")),
    "stddev_over_time": lambda: sliding.spread(F.col(V)),
}
#: Functions of neighbouring samples, for which each series is sorted: whether they look back and ahead.
NEIGHBOURLY = {"rate": (True, False), "increase": (True, False), "irate": (True, True)}
LAST = (False, True)
NAMES = (*SIMPLE, *NEIGHBOURLY)


def many(grid: Grid, width: int) -> bool:
    return width // grid.step + 1 > MANY_POINTS and grid.points > 1


def _over_time(name: str, samples: Labelled, grid: Grid, width: int) -> DataFrame:
    keys = ["metric", *samples.keys]
    if many(grid, width):
        return sliding.over_blocks(samples.frame, keys, grid, width, PARTS[name]())
    rows = each_point(samples.frame, grid, F.col("ts"), F.col("ts") + width)
    return rows.groupBy(*keys, "n").agg(SIMPLE[name](F.col("value")).alias("value"))


def _increase(samples: Labelled, grid: Grid, width: int, bucket: int | None) -> DataFrame:
    """The sum of the steps up, a step down counting as a reset to zero; absent for fewer than two samples."""
    keys = ["metric", *samples.keys]
    v, p = F.col("value"), F.col("prev_value")
    up = F.when(~F.isnan(v) & ~F.isnan(p) & (v >= p), v - p).otherwise(v)
    rows = neighbours(samples, bucket).withColumn("up", F.when(F.col("prev_ts").isNotNull(), up))
    if many(grid, width):
        own, before = sliding.cell_of(F.col("ts"), grid, width), sliding.cell_of(F.col("prev_ts"), grid, width)
        first = F.col("prev_ts").isNull() | (own[0] != before[0]) | (own[1] != before[1])
        return sliding.over_blocks(rows, keys, grid, width, sliding.climbs(F.coalesce("up", F.lit(0.0)), first))
    rows = each_point(rows.drop("value", "prev_value", "next_ts"), grid, F.col("ts"), F.col("ts") + width)
    within = F.when(F.col("prev_ts") >= F.col("t") - width, F.col("up"))
    return rows.groupBy(*keys, "n").agg(F.sum(within).alias("value"), F.count("*").alias("_c")).where("_c >= 2").drop("_c")


def _irate(samples: Labelled, grid: Grid, width: int, bucket: int | None) -> DataFrame:
    """The step between the last two samples over their distance.

    A pair is the last one until the next sample comes and as long as its first is in the window, so each pair gives its
    own points and nothing is grouped.
    """
    rows = neighbours(samples, bucket).where("prev_ts < ts")
    rows = each_point(rows, grid, F.col("ts"), F.least(F.col("next_ts") - 1, F.col("prev_ts") + width))
    up = F.col("value") - F.col("prev_value")
    up = F.when(~F.isnan(up) & (up < 0), F.col("value")).otherwise(up)
    return rows.withColumn("value", up / ((F.col("ts") - F.col("prev_ts")) / F.lit(1000.0))).select("metric", *samples.keys, "n", "value")


def over_range(name: str, samples: Labelled, grid: Grid, width: int, bucket: int | None = None) -> DataFrame:
    """(metric, keys, n, value): the function of each series' window [t - width, t] at each grid point.

    samples must hold those from grid.start - width on and none before, and none after grid.last. A series is absent at
    a point whose window is empty.
    """
    if name == "irate":
        return _irate(samples, grid, width, bucket)
    if name in ("rate", "increase"):
        found = _increase(samples, grid, width, bucket)
        return found.withColumn("value", F.col("value") / F.lit(width / 1000.0)) if name == "rate" else found
    return _over_time(name, samples, grid, width)


def last_sample(samples: Labelled, grid: Grid, lookback: int, bucket: int | None = None) -> DataFrame:
    """(metric, keys, n, value): each series' last sample in [t - lookback, t].

    A sample is the last one until the next comes, so each gives its own points: an as-of join without a join.
    """
    rows = neighbours(samples, bucket)
    until = F.least(F.col("next_ts") - 1, F.col("ts") + lookback)
    return each_point(rows, grid, F.col("ts"), until).select("metric", *samples.keys, "n", "value")
