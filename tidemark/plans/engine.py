"""Queries of the language, compiled to one lazy DataFrame, and the plain reads of samples and labels."""

from __future__ import annotations


from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.aggregates import AGGREGATES
from tidemark.functions.matchers import Matcher, Plan, label_filter, query_plan, remote_plan
from tidemark.functions.ranges import LAST, NEIGHBOURLY, last_sample, over_range
from tidemark.operators.dedup import Deal
from tidemark.operators.grid import Grid, bucket_of, in_buckets, instant
from tidemark.plans.promql import Aggregate, Call, Expr, Number, Selector, parse
from tidemark.sources.model import NAME, Labelled, prom_labels

DAY = 24 * 3600 * 1000


class WindowTooLong(ValueError):
    """A query over more time than the configuration allows."""


@dataclass(frozen=True)
class Config:
    """lookback and max_window in milliseconds; 0 lifts the cap.

    Series are sorted in buckets of time, of a length that follows from the query; bucket (milliseconds) sets another,
    shorter than a window if need be, for single points over hot series (see neighbours).
    """

    lookback: int = 300_000
    max_window: int = 90 * DAY
    bucket: int | None = None

    def __post_init__(self) -> None:
        if self.lookback < 0 or self.max_window < 0 or self.bucket is not None and self.bucket <= 0:
            raise ValueError("lookback and max_window can't be negative, and a bucket must be positive")


class Engine:
    """Answers queries over a source. Every method returns a lazy DataFrame."""

    def __init__(self, spark: SparkSession, source, config: Config | None = None) -> None:
        self.spark, self.source, self.config = spark, source, config or Config()

    def check_window(self, start: int, end: int) -> None:
        if self.config.max_window and end - start > self.config.max_window:
            raise WindowTooLong(f"{end - start} ms is over the limit of {self.config.max_window} ms")

    # The query language

    def query(self, text: str, time: int) -> DataFrame:
        """(metric, labels, ts, value) of the instant query at ``time`` in milliseconds. The result type is vector."""
        return self._result(self.vector(parse(text), instant(time)), instant(time))

    def query_range(self, text: str, start: int, end: int, step: int) -> DataFrame:
        """(metric, labels, ts, value) at each point of the grid. The result type is matrix."""
        grid = Grid(start, end, step)
        self.check_window(start, end)
        return self._result(self.vector(parse(text), grid), grid)

    def _result(self, vector: Labelled, grid: Grid) -> DataFrame:
        return vector.frame.select("metric", vector.labels().alias("labels"), grid.time(F.col("n")).alias("ts"), "value")

    def vector(self, expr: Expr, grid: Grid) -> Labelled:
        """(metric, keys, n, value) at the grid's points; metric is null where the language has dropped it."""
        if isinstance(expr, Number):
            points = self.spark.range(grid.points).select(F.lit(None).cast("string").alias("metric"), F.col("id").alias("n"), F.lit(expr.value).alias("value"))
            return Labelled(points, ())
        if isinstance(expr, Selector):
            width = expr.width or self.config.lookback
            samples, bucket = self._sorted(expr, grid, width, LAST)
            return samples.with_frame(last_sample(samples, grid, width, bucket))
        if isinstance(expr, Call):
            width = expr.argument.width
            if expr.name in NEIGHBOURLY:
                samples, bucket = self._sorted(expr.argument, grid, width, NEIGHBOURLY[expr.name])
            else:
                samples, bucket = self._window(expr.argument, grid, width), None
            return samples.with_frame(over_range(expr.name, samples, grid, width, bucket))
        return self._aggregate(expr, grid)

    def _sorted(self, selector: Selector, grid: Grid, width: int, looks: tuple[bool, bool]) -> tuple[Labelled, int]:
        """The samples of windows for a function of neighbours, and the length of the buckets that they are sorted in."""
        if self.config.bucket is not None:
            return self._window(selector, grid, width), self.config.bucket
        bucket = bucket_of(grid, width)
        before, after = (width if x else 0 for x in looks)
        return self._window(selector, grid, width, lambda s: in_buckets(s, bucket, before, after)), bucket

    def _window(self, selector: Selector, grid: Grid, width: int, deal: Deal | None = None) -> Labelled:
        """The samples that windows of the grid may hold."""
        self.check_window(grid.start - width, grid.start)
        return self.scan(query_plan(selector.metric, selector.matchers), grid.start - width, grid.last, deal)

    def scan(self, plan: Plan, lo: int, hi: int, deal: Deal | None = None) -> Labelled:
        where = (lambda _: F.lit(False)) if plan.impossible else plan.where
        return self.source.scan(plan.metric, lo, hi, where, deal)

    def _aggregate(self, expr: Aggregate, grid: Grid) -> Labelled:
        inner = self.vector(expr.inner, grid)
        by = tuple(dict.fromkeys(expr.by))
        keyed = inner.frame.select("n", "value", *[inner.label(name).alias(f"l_{name}") for name in by])
        found = keyed.groupBy("n", *[f"l_{name}" for name in by]).agg(AGGREGATES[expr.op](F.col("value")).alias("value"))
        return Labelled(found.withColumn("metric", F.lit(None).cast("string")), by)

    # Plain reads

    def at(self, metric: str, labels: dict[str, str], time: int, partial: bool = False) -> DataFrame:
        """(metric, labels, ts, value) of the samples at exactly that time."""
        return self.between(metric, labels, time, time, partial)

    def between(self, metric: str, labels: dict[str, str], start: int, end: int, partial: bool = False) -> DataFrame:
        """(metric, labels, ts, value) of the samples in [start, end]; none if start is after end or metric is empty."""
        self.check_window(start, end)
        where = label_filter(labels, partial) if metric else lambda _: F.lit(False)
        found = self.source.scan(metric, start, end, where)
        return found.frame.select("metric", found.labels().alias("labels"), "ts", "value")

    def by_series(self, rows: DataFrame) -> DataFrame:
        """One row a series, with its samples in order: the shape of the range and remote-read answers."""
        entries = F.sort_array(F.map_entries("labels"))
        points = F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("points")
        return rows.groupBy("metric", entries.alias("entries")).agg(points).select("metric", F.map_from_entries("entries").alias("labels"), "points")

    def remote_read(self, queries: list[tuple[int, int, list[Matcher]]]) -> DataFrame:
        """(query, metric, labels, ts, value) for each (start, end, matchers)."""
        found = []
        for k, (start, end, matchers) in enumerate(queries):
            if start > end:
                raise ValueError("start is after end")
            self.check_window(start, end)
            rows = self.scan(remote_plan(matchers), start, end)
            found.append(rows.frame.select(F.lit(k).alias("query"), "metric", rows.labels().alias("labels"), "ts", "value"))
        if not found:
            raise ValueError("no query")
        return reduce(DataFrame.unionByName, found)

    # Labels and series

    def label_names(self) -> DataFrame:
        """(name) of every label and ``__name__``, in order, over all time; of a store by its catalog alone."""
        known = self.source.labelled_series()
        pairs = F.map_keys(known.labels())
        names = known.frame.select(F.explode(pairs).alias("name")) if known.names != () else known.frame.select(F.lit(NAME).alias("name")).limit(0)
        name = known.frame.select(F.lit(NAME).alias("name")).limit(1)
        return names.union(name).distinct().orderBy("name")

    def label_values(self, name: str) -> DataFrame:
        """(value) of a label, in order and without the empty one; the metrics for ``__name__``."""
        known = self.source.labelled_series()
        value = F.col("metric") if name == NAME else known.label(name)
        return known.frame.select(value.alias("value")).where("value <> ''").distinct().orderBy("value")

    def series(self, selectors: list[tuple[str, dict[str, str]]], start: int, end: int, partial: bool = True) -> DataFrame:
        """(metric, labels) of the series that any selector matches and that have a sample in [start, end]."""
        if not selectors:
            raise ValueError("no selector")

        def where(samples: Labelled) -> Column:
            held = F.lit(False)
            for metric, labels in selectors:
                own = label_filter(labels, partial)
                one = F.col("metric") == metric
                held = held | (one & own(samples) if own else one)
            return held

        metrics = {m for m, _ in selectors}
        # whether a sample is there doesn't depend on which write of it holds: no upsert, and the labels are enough
        found = self.source.scan(metrics.pop() if len(metrics) == 1 else None, start, end, where, upsert=False)
        rows = found.frame.select("metric", *found.keys).distinct()
        return rows.select("metric", found.with_frame(rows).labels().alias("labels"))

    def metrics_series(self, names: list[str], start: int, end: int) -> DataFrame:
        """The series of several metrics, whose names are trimmed and taken once."""
        return self.series([(m, {}) for m in dict.fromkeys(n.strip() for n in names) if m], start, end)

    def prom_series(self, rows: DataFrame) -> DataFrame:
        """rows with the label object of the wire format, which names the metric."""
        return rows.withColumn("labels", prom_labels(F.col("metric"), F.col("labels")))


