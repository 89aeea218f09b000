"""Anomalies of a series against two exponentially weighted means.

A fold over a series in order: it can't be split or combined before a shuffle. The batch form sorts each partition and
folds the stream of its rows with the state of one series at a time, so a series of any length takes constant memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.regex import glob_to_java
from tidemark.sources.model import Labelled

# Fixed values of the detector: the slow mean's weight, what counts as no spread, the score of a change without spread.
SLOW, STILL, STILL_SCORE = 0.05, 1e-10, 100.0
KINDS = ("spike", "drop", "drift")
EVENT = T.StructType([
    T.StructField("ts", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("expected", T.DoubleType()),
    T.StructField("z_score", T.DoubleType()),
    T.StructField("type", T.StringType()),
])


@dataclass(frozen=True)
class Settings:
    """alpha weighs the fast mean; no event is told before warmup samples."""

    alpha: float = 0.3
    threshold: float = 3.0
    warmup: int = 10

    def __post_init__(self) -> None:
        if not 0 < self.alpha <= 1 or self.threshold <= 0 or self.warmup < 0:
            raise ValueError("alpha is in (0, 1], threshold positive and warmup not negative")


#: (samples, fast mean, slow mean, variance)
State = tuple[int, float, float, float]
START: State = (0, 0.0, 0.0, 0.0)


def step(state: State, value: float, how: Settings) -> tuple[State, tuple[float, float, str] | None]:
    """The next state, and (expected, z score, type) if the value is an anomaly. Values that aren't finite are skipped."""
    if not math.isfinite(value):
        return state, None
    n, fast, slow, variance = state
    if n == 0:
        return (1, value, value, 0.0), None
    off, spread, event = value - fast, math.sqrt(variance), None
    if n + 1 > how.warmup:
        score = abs(off) / spread if spread >= STILL else STILL_SCORE
        if score > how.threshold if spread >= STILL else abs(off) >= STILL:
            drifted = spread > STILL and abs(fast - slow) / spread > how.threshold / 2
            event = (fast, score, "drift" if drifted else "spike" if off > 0 else "drop")
    a = how.alpha
    return (n + 1, a * value + (1 - a) * fast, SLOW * value + (1 - SLOW) * slow, a * (off * off) + (1 - a) * variance), event


def detect(samples: Labelled, how: Settings | None = None) -> DataFrame:
    """(metric, keys, ts, value, expected, z_score, type) of each anomaly, each series in the order of (ts, ingest_seq)."""
    how = how or Settings()
    keys = ["metric", *samples.keys]
    order = ["ts", "ingest_seq"] if "ingest_seq" in samples.frame.columns else ["ts"]
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in keys), *EVENT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, state = None, START
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(len(keys) + 2)]
            found = []
            for *own, ts, value in zip(*columns, strict=True):
                if own != series:
                    series, state = own, START
                if value is not None:
                    state, event = step(state, value, how)
                    if event:
                        found.append((*own, ts, value, *event))
            if found:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in found], schema=arrow)

    arrow = pa.schema([(f.name, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.dataType.typeName()]) for f in schema])
    rows = samples.frame.repartition(*keys).sortWithinPartitions(*keys, *order)
    return rows.select(*keys, "ts", F.col("value").cast("double").alias("value")).mapInArrow(run, schema)


def filtered(events: DataFrame, metric: str | None = None, min_z: float = 0.0, types: str | None = None) -> DataFrame:
    """Events whose metric fits a glob (* and ? don't match a slash), of that score at least, of the listed types.

    A malformed glob matches nothing; an unknown type is an error.
    """
    if metric:
        pattern = glob_to_java(metric)
        events = events.where(F.col("metric").rlike(pattern) if pattern else F.lit(False))
    wanted = [t for t in (x.strip() for x in (types or "").split(",")) if t]
    for t in wanted:
        if t not in KINDS:
            raise ValueError(f"{t!r} is not one of {', '.join(KINDS)}")
    events = events.where(F.col("z_score") >= min_z)
    return events.where(F.col("type").isin(wanted)) if wanted else events
