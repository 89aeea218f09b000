"""The step grid, and the two ways from samples to grid points.

Windows are closed on both ends: the window of a grid point t holds the samples in [t - range, t].
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.model import Labelled


@dataclass(frozen=True)
class Grid:
    """start, start + step, ... up to end."""

    start: int
    end: int
    step: int

    def __post_init__(self) -> None:
        if self.step <= 0:
            raise ValueError("step must be greater than zero")
        if self.end < self.start:
            raise ValueError("end is before start")

    @property
    def points(self) -> int:
        return (self.end - self.start) // self.step + 1

    @property
    def last(self) -> int:
        return self.start + (self.points - 1) * self.step

    def time(self, n: Column) -> Column:
        return F.lit(self.start) + n * F.lit(self.step)

    def first_at(self, ts: Column) -> Column:
        """The number of the first point at or after ts, 0 at least."""
        return F.greatest(F.lit(0).cast("long"), F.ceil((ts - self.start) / F.lit(self.step)).cast("long")) if self.points > 1 else F.lit(0).cast("long")

    def last_at(self, ts: Column) -> Column:
        """The number of the last point at or before ts; negative if there is none."""
        return F.least(F.lit(self.points - 1).cast("long"), F.floor((ts - self.start) / F.lit(self.step)).cast("long"))


def instant(t: int) -> Grid:
    return Grid(t, t, 1)


def each_point(rows: DataFrame, grid: Grid, since: Column, until: Column) -> DataFrame:
    """rows, once for each grid point t with since <= t <= until, as n (its number) and t."""
    low, high = grid.first_at(since), grid.last_at(until)
    if grid.points == 1:
        out = rows.where((since <= grid.start) & (until >= grid.start)).withColumn("n", F.lit(0).cast("long"))
    else:
        out = rows.withColumns({"_low": low, "_high": high}).where("_low <= _high")
        out = out.withColumn("n", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")
    return out.withColumn("t", grid.time(F.col("n")))


#: A bucket of time is so many widths long at least, and a query is cut into so many buckets at most.
WIDTHS, BUCKETS = 8, 1024


def bucket_of(grid: Grid, width: int) -> int:
    """The length of the buckets of time that the series of a query are sorted in, in milliseconds."""
    return max(1, WIDTHS * width, -(-(grid.last - grid.start + width) // BUCKETS))


def in_buckets(samples: Labelled, bucket: int, before: int, after: int) -> DataFrame:
    """samples dealt by series and bucket of time, _b, with the neighbours that a bucket needs of the ones next to it.

    A sample also goes to the next bucket if it is at most ``before`` earlier than that, and to the one before if it is
    at most ``after`` later. So a series is many tasks' work, however hot it is, and each bucket can be sorted alone.
    """
    home = F.floor(F.col("ts") / F.lit(bucket)).cast("long")
    ahead = F.when(F.col("ts") + before >= (home + 1) * F.lit(bucket), home + 1) if before else F.lit(None).cast("long")
    back = F.when(F.col("ts") - after < home * F.lit(bucket), home - 1) if after else F.lit(None).cast("long")
    rows = samples.frame.withColumn("_b", F.explode(F.array_compact(F.array(home, ahead, back))))
    return rows.repartition("metric", *samples.keys, "_b")


def neighbours(samples: Labelled, bucket: int | None = None) -> DataFrame:
    """The samples with prev_ts, prev_value and next_ts of their series, null at the ends.

    Samples dealt by ``in_buckets`` (with _b) are sorted bucket by bucket, and only those at home in one are given; their
    neighbours farther than what the buckets were dealt for are null. Otherwise, with ``bucket`` (milliseconds), of any
    length, the sort runs within buckets and is stitched over their edges by one row a bucket.
    """
    keys = ["metric", *samples.keys]
    if bucket is None or "_b" in samples.frame.columns:
        dealt = "_b" in samples.frame.columns
        order = Window.partitionBy(*keys, *(["_b"] if dealt else [])).orderBy("ts")
        rows = samples.frame.withColumns({"_p": F.lag(F.struct("ts", "value")).over(order), "next_ts": F.lead("ts").over(order)})
        if dealt:
            rows = rows.where(F.col("_b") == F.floor(F.col("ts") / F.lit(bucket)))
        return rows.selectExpr(*[c for c in samples.frame.columns if c != "_b"], "_p.ts AS prev_ts", "_p.value AS prev_value", "next_ts")
    rows = samples.frame.withColumn("_b", F.floor(F.col("ts") / F.lit(bucket)))
    order = Window.partitionBy(*keys, "_b").orderBy("ts")
    rows = rows.withColumns({"_p": F.lag(F.struct("ts", "value")).over(order), "_n": F.lead("ts").over(order)})
    edges = samples.frame.withColumn("_b", F.floor(F.col("ts") / F.lit(bucket))).groupBy(*keys, "_b").agg(F.max(F.struct("ts", "value")).alias("_last"), F.min("ts").alias("_first"))
    over = Window.partitionBy(*keys).orderBy("_b")
    edges = edges.select(*[F.col(k).alias(f"_e_{k}") for k in [*keys, "_b"]], F.lag("_last").over(over).alias("_before"), F.lead("_first").over(over).alias("_after"))
    same = None
    for k in [*keys, "_b"]:
        one = F.col(k).eqNullSafe(F.col(f"_e_{k}"))
        same = one if same is None else same & one
    rows = rows.join(edges, same)
    previous = F.coalesce("_p", "_before")
    return rows.select(*samples.frame.columns, previous["ts"].alias("prev_ts"), previous["value"].alias("prev_value"), F.coalesce("_n", "_after").alias("next_ts"))
