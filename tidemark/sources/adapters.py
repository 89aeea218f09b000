"""Where samples come from. A source scans one metric over a closed interval of milliseconds.

Predicates are given on the columns of the files, so that they reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedup import Deal, last_write_wins
from tidemark.sources.model import Labelled, MapLabelled, series_of

EPOCH = datetime(1970, 1, 1, tzinfo=UTC).replace(tzinfo=None)
#: Milliseconds that a TIMESTAMP_NTZ literal can hold here: years 1 to 9998.
REACH = (-62_135_596_800_000, 253_370_764_800_000)
Where = Callable[[Labelled], Column]


def ntz(ms: int) -> datetime:
    return EPOCH + timedelta(milliseconds=min(max(ms, REACH[0]), REACH[1]))


class FrameSource:
    """Samples in a frame: metric, labels (map or null), ts, value and, unless rows are unique, ingest_seq."""

    def __init__(self, frame: DataFrame, unique: bool = False) -> None:
        self.frame, self.unique = frame, unique or "ingest_seq" not in frame.columns

    def all(self) -> Labelled:
        """Every sample, as stored (no upsert applied)."""
        return Labelled(self.frame.withColumn("series", series_of(F.col("labels"))).drop("labels"), None)

    def labelled_series(self) -> Labelled:
        """The label sets of each metric, for listings."""
        found = self.all()
        return found.with_frame(found.frame.select("metric", "series").distinct())

    def scan(self, metric: str | None = None, lo: int | None = None, hi: int | None = None, where: Where | None = None, deal: Deal | None = None, upsert: bool = True) -> Labelled:
        """Samples of a metric in [lo, hi] whose labels fit, one row a point unless upsert is off.

        deal is how a reader that sorts each series next wants the rows dealt (see last_write_wins).
        """
        rows = self.frame
        if metric is not None:
            rows = rows.where(F.col("metric") == metric)
        if lo is not None:
            rows = rows.where(F.col("ts") >= lo)
        if hi is not None:
            rows = rows.where(F.col("ts") <= hi)
        if where is not None:
            rows = rows.where(where(MapLabelled(rows, None)))
        found = Labelled(rows.withColumn("series", series_of(F.col("labels"))).drop("labels"), None)
        if self.unique or not upsert:
            return found.with_frame(deal(found)) if deal else found
        return last_write_wins(found, deal)


class TableSource:
    """A table with fixed label columns and a TIMESTAMP_NTZ time column, mapped to samples."""

    def __init__(self, table: DataFrame, metric: Column, labels: dict[str, Column], time: str, value: str, seq: list[str]) -> None:
        self.table, self.metric, self.labels_, self.time, self.value, self.seq = table, metric, labels, time, value, seq

    def _mapped(self, rows: DataFrame) -> Labelled:
        columns = {f"l_{n}": c.cast("string") for n, c in self.labels_.items()}
        seq = F.struct(*self.seq) if len(self.seq) > 1 else F.col(self.seq[0])
        out = rows.select(
            self.metric.alias("metric"),
            *[c.alias(n) for n, c in columns.items()],
            F.unix_millis(F.col(self.time).cast("timestamp")).alias("ts"),
            F.col(self.value).cast("double").alias("value"),
            seq.alias("ingest_seq"),
        )
        return Labelled(out, tuple(self.labels_))

    def all(self) -> Labelled:
        return self._mapped(self.table)

    def labelled_series(self) -> Labelled:
        """The label sets of each metric, for listings: a combined aggregation over the label columns alone."""
        found = self.all()
        return found.with_frame(found.frame.select("metric", *found.keys).distinct())

    def scan(self, metric: str | None = None, lo: int | None = None, hi: int | None = None, where: Where | None = None, deal: Deal | None = None, upsert: bool = True) -> Labelled:
        rows = self.table
        if metric is not None:
            rows = rows.where(self.metric == metric)
        if lo is not None:
            rows = rows.where(F.col(self.time) >= F.lit(ntz(lo)).cast("timestamp_ntz"))
        if hi is not None:
            rows = rows.where(F.col(self.time) < F.lit(ntz(hi + 1)).cast("timestamp_ntz"))
        found = self._mapped(rows)
        if where is not None:
            found = found.with_frame(found.frame.where(where(found)))
        return last_write_wins(found, deal) if upsert else found


def events_source(spark: SparkSession, sf_dir: str) -> TableSource:
    """events: metric event_type, label shard (user_id mod 4), ts and value; later event_id wins."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return TableSource(events, F.col("event_type"), {"shard": F.col("user_id") % 4}, "ts", "value", ["event_id"])


def lineitem_source(spark: SparkSession, sf_dir: str) -> TableSource:
    """lineitem: one metric of quantities by return flag and line status, with many samples at one time."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    labels = {"returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus")}
    return TableSource(items, F.lit("lineitem_quantity"), labels, "l_shipdate", "l_quantity", ["l_orderkey", "l_linenumber"])
