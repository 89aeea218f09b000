"""A sample store in Parquet: batches in, upserts on read, compaction, retention, a catalog of series with a cap.

Layout: ``batch=<first>-<last>/kind=points/day=<n>`` holds samples, ``batch=<first>-<last>/kind=series`` the series that
the batch brought. A write is staged aside and takes the next number by a rename that fails if the number is taken; then
it checks the cap anew and tries the next one. So a reader sees all of a batch or none, and no writer's batch is lost.

A merge of batches is a folder that spans their numbers. A folder within the span of another is shadowed: readers pass
over it from the moment the wider one is there, and ``vacuum`` deletes it later, when readers that listed it are done.
Each point carries the number of the batch that it came with (null in that batch itself, whose folder tells it) and its
row there, so the order of writes survives merges, and a point that two folders hold counts once.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.dedup import last_write_wins
from tidemark.sources.adapters import Where
from tidemark.sources.files import Files
from tidemark.sources.model import Labelled, MapLabelled, labels_of, series_of

DAY = 24 * 3600 * 1000
HOUR = 3600 * 1000
POINTS = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("series", T.StringType()),
    T.StructField("ts", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("origin", T.LongType()),
    T.StructField("row", T.LongType()),
    T.StructField("batch", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("day", T.IntegerType()),
])
SERIES = T.StructType([T.StructField("metric", T.StringType()), T.StructField("series", T.StringType())])
#: Series that a label filter lists in the scan itself; more are found by a join with the catalog.
LISTED = 200


class TooManySeries(ValueError):
    """A batch that would take a metric over the cap; nothing of it is written."""


class TooManyBatches(RuntimeError):
    """A write while more batches wait for compaction than the store allows; nothing of it is written."""


class SampleStore:
    """max_series caps the series of a metric, max_batches the batches that wait for compaction; 0 lifts a cap."""

    def __init__(self, spark: SparkSession, root: str, max_series: int = 100_000, max_batches: int = 0) -> None:
        self.spark, self.root, self.max_series, self.max_batches = spark, root.rstrip("/"), max_series, max_batches
        self.files = Files(spark, self.root)

    # Folders

    def _folder(self, span: tuple[int, int]) -> str:
        return f"{self.root}/batch={span[0]:012d}-{span[1]:012d}"

    def _spans(self) -> list[tuple[int, int]]:
        """All that are there, shadowed ones too."""
        names = [name.removeprefix("batch=") for name, _ in self.files.listed(self.root) if name.startswith("batch=")]
        return sorted((int(a), int(b)) for a, b in (n.split("-") for n in names))

    def spans(self) -> list[tuple[int, int]]:
        """First and last number of each folder that no other one shadows, oldest first."""
        live: list[tuple[int, int]] = []
        for a, b in sorted(self._spans(), key=lambda s: (s[0], -s[1])):
            if not live or b > live[-1][1]:
                live.append((a, b))
        return live

    def batches(self) -> list[int]:
        """The last number of each live folder, oldest first."""
        return [b for _, b in self.spans()]

    def _points(self, spans: list[tuple[int, int]] | None = None) -> DataFrame:
        """Samples (metric, series, ts, value, ingest_seq, batch, day) of all live folders in one scan, as written."""
        folders = [f"{self._folder(s)}/kind=points" for s in (self.spans() if spans is None else spans)]
        rows = self.spark.read.schema(POINTS).option("basePath", self.root).parquet(*folders) if folders else self.spark.createDataFrame([], POINTS)
        number = F.coalesce("origin", F.substring("batch", 1, 12).cast("long"))
        return rows.select("metric", "series", "ts", "value", F.struct(number.alias("batch"), "row").alias("ingest_seq"), "batch", "day")

    def catalog(self) -> DataFrame:
        """(metric, series) of every series, once; no sample is read."""
        folders = [f"{self._folder(s)}/kind=series" for s in self.spans()]
        rows = self.spark.read.schema(SERIES).parquet(*folders) if folders else self.spark.createDataFrame([], SERIES)
        return rows.distinct()

    # Writes

    def _stage(self, rows: DataFrame) -> str:
        """Points (metric, series, ts, value, origin, row) by day, sorted by series and time for the row groups' sake."""
        staged = f"{self.root}/_staged-{uuid.uuid4().hex}"  # readers pass over names that begin so
        rows = rows.withColumn("day", F.floor(F.col("ts") / DAY).cast("int"))
        rows = rows.repartition("day", "metric", "series").sortWithinPartitions("day", "metric", "series", "ts")
        rows.write.partitionBy("day").parquet(f"{staged}/kind=points")
        return staged

    def _staged(self, staged: str) -> DataFrame:
        """Series of staged points, once each."""
        schema = T.StructType([*SERIES.fields, T.StructField("day", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{staged}/kind=points").select("metric", "series").distinct()

    def check_series(self, new: DataFrame) -> None:
        """Raises TooManySeries if series (metric, series) that aren't in the catalog take a metric over the cap."""
        if self.max_series <= 0:
            return
        more = new.where("metric <> ''").groupBy("metric").agg(F.count("*").alias("new"))
        if self.spans():
            there = self.catalog().groupBy("metric").agg(F.count("*").alias("old"))
            more = more.join(there, "metric", "left")
        else:
            more = more.withColumn("old", F.lit(0))
        first = more.where(F.col("new") + F.coalesce("old", F.lit(0)) > self.max_series).orderBy("metric").first()
        if first:
            raise TooManySeries(f"metric {first.metric!r} would have {first.new + (first.old or 0)} series; the limit is {self.max_series}")

    def write(self, batch: DataFrame) -> int:
        """Appends a batch (metric, labels, ts, value) as a whole and returns its number.

        Of rows of one batch for one point the later one wins: partitions in order, rows of a partition in order.
        """
        if 0 < self.max_batches <= len(self.spans()):
            raise TooManyBatches(f"{self.max_batches} batches wait for compaction")
        rows = batch.select("metric", series_of(F.col("labels")).alias("series"), "ts", "value", F.lit(None).cast("long").alias("origin"), F.monotonically_increasing_id().alias("row"))
        staged = self._stage(rows)
        try:
            brought = None
            while True:
                spans = self.spans()
                number = max((b for _, b in self._spans()), default=0) + 1
                new = self._staged(staged)
                if spans:
                    new = new.join(self.catalog(), ["metric", "series"], "left_anti")
                if brought is None:
                    brought = f"{staged}/kind=series"
                    new.write.parquet(brought)
                    new = self.spark.read.schema(SERIES).parquet(brought)
                self.check_series(new)
                if self.files.take(staged, self._folder((number, number))):
                    return number
        except BaseException:
            self.files.delete(staged)
            raise

    # Reads

    def all(self) -> Labelled:
        """Every sample as stored, no upsert applied; of one writer after another the ingest_seq tells the order."""
        return Labelled(self._points().drop("batch", "day"), None)

    def labelled_series(self) -> Labelled:
        """The catalog, for listings."""
        return Labelled(self.catalog(), None)

    def _matching(self, rows: DataFrame, metric: str | None, where: Where) -> DataFrame:
        """rows of the series that a predicate on labels holds for, which is tested once a series."""
        known = self.catalog()
        if metric is not None:
            known = known.where(F.col("metric") == metric)
        known = MapLabelled(known.withColumn("labels", labels_of(F.col("series"))), None)
        held = known.frame.where(where(known)).select("metric", "series")
        few = held.limit(LISTED + 1).collect() if metric is not None else []
        if metric is not None and len(few) <= LISTED:
            return rows.where(F.col("series").isin([r.series for r in few]))
        return rows.join(held, ["metric", "series"], "left_semi")

    def scan(self, metric: str | None = None, lo: int | None = None, hi: int | None = None, where: Where | None = None, deal=None, upsert: bool = True) -> Labelled:
        """Upserted samples of a metric in [lo, hi] whose labels fit; see FrameSource.scan."""
        rows = self._points()
        if metric is not None:
            rows = rows.where(F.col("metric") == metric)
        if lo is not None:
            rows = rows.where((F.col("day") >= lo // DAY) & (F.col("ts") >= lo))
        if hi is not None:
            rows = rows.where((F.col("day") <= hi // DAY) & (F.col("ts") <= hi))
        if where is not None:
            rows = self._matching(rows, metric, where)
        found = Labelled(rows.drop("batch", "day"), None)
        return last_write_wins(found, deal) if upsert else found

    def series_counts(self) -> DataFrame:
        """(metric, series) of what the catalog holds: the number of distinct label sets a metric."""
        return self.catalog().where("metric <> ''").groupBy("metric").agg(F.count("*").alias("series"))

    # Maintenance

    def _merge(self, spans: list[tuple[int, int]], target: str, span: tuple[int, int], fresh: bool = False) -> bool:
        """Writes the upserted points and the series of some folders as one folder of the store at target.

        Points are dealt by day and series once, for the upsert and for the sort. fresh forgets where they came from.
        """
        other = SampleStore(self.spark, target, 0)
        rows = self._points(spans).repartition("day", "metric", "series")
        once = rows.groupBy("day", "metric", "series", "ts").agg(F.max_by(F.struct("value", "ingest_seq"), "ingest_seq").alias("x"))
        origin = F.lit(0).cast("long") if fresh else F.col("x.ingest_seq.batch")
        once = once.select("day", "metric", "series", "ts", "x.value", origin.alias("origin"), F.col("x.ingest_seq.row").alias("row"))
        staged = f"{target}/_staged-{uuid.uuid4().hex}"
        once.sortWithinPartitions("day", "metric", "series", "ts").write.partitionBy("day").parquet(f"{staged}/kind=points")
        other._staged(staged).write.parquet(f"{staged}/kind=series")
        if other.files.take(staged, other._folder(span)):
            return True
        other.files.delete(staged)
        return False

    def compact(self) -> int:
        """Merges all live folders into one with a row a point; returns how many, 0 if there are fewer than two.

        Batches that are written meanwhile are not among them and stay after them. The catalog of the merged folder
        holds the series that still have a point. A compaction that another one overtakes changes nothing.
        """
        there = self.spans()
        if len(there) < 2:
            return 0
        return len(there) if self._merge(there, self.root, (there[0][0], there[-1][1])) else 0

    def compact_tiers(self, fanout: int = 4) -> int:
        """Merges neighbouring folders of similar size, fanout of them at least; returns how many were merged.

        Sizes within a factor of fanout are similar, so a point is rewritten about once a tier and not with every run.
        """
        there, merged, k = self.spans(), 0, 0
        sizes = [max(1, self.files.size(self._folder(s))) for s in there]
        while k < len(there):
            end = k + 1
            while end < len(there) and max(sizes[k : end + 1]) <= fanout * min(sizes[k : end + 1]):
                end += 1
            if end - k >= fanout and self._merge(there[k:end], self.root, (there[k][0], there[end - 1][1])):
                merged += end - k
            k = end
        return merged

    def vacuum(self, older_than: int = HOUR, now: int | None = None) -> int:
        """Deletes shadowed folders once what shadows them is that old, and staged ones that were left so long ago.

        The age, in milliseconds, must exceed what a reader or a writer takes. Returns how many went.
        """
        now = int(time.time() * 1000) if now is None else now
        live, gone = self.spans(), 0
        times = dict(self.files.listed(self.root))
        age = lambda name: now - times[name]
        name_of = lambda s: self._folder(s).rsplit("/", 1)[1]
        for a, b in self._spans():
            over = next((s for s in live if s != (a, b) and s[0] <= a and b <= s[1]), None)
            if over and name_of(over) in times and age(name_of(over)) >= older_than:
                gone += self.files.delete(self._folder((a, b)))
        for name in times:
            if name.startswith("_staged-") and age(name) >= older_than:
                gone += self.files.delete(f"{self.root}/{name}")
        return gone

    def retain(self, now: int, period: int) -> int:
        """Drops the day partitions whose last sample is before now - period; 0 keeps all. Returns how many went.

        Days that ended before are known by their number; only the day of the cut itself is read.
        """
        if period <= 0:
            return 0
        cut, spans = now - period, self.spans()
        first = cut // DAY
        gone = [
            f"{self._folder(s)}/kind=points/{name}"
            for s in spans
            for name, _ in self.files.listed(f"{self._folder(s)}/kind=points")
            if name.startswith("day=") and int(name.removeprefix("day=")) < first
        ]
        last = self._points(spans).where(F.col("day") == first).groupBy("batch").agg(F.max("ts").alias("last")).where(F.col("last") < cut)
        gone += [f"{self.root}/batch={r.batch}/kind=points/day={first}" for r in last.collect()]
        return sum(bool(self.files.delete(name)) for name in gone)

    def snapshot(self, target: str) -> int:
        """Writes the upserted samples and their series to a new store at target; returns the last batch in it.

        Executors copy; a target that holds a store already is an error.
        """
        there = self.spans()
        span = (1, there[-1][1] if there else 1)
        if SampleStore(self.spark, target).spans() or not self._merge(there, target.rstrip("/"), span):
            raise ValueError(f"{target} holds a store already")
        return span[1]

    def restore(self, source: str) -> int:
        """Replaces all samples by those of the store at source, at once for readers; returns the new batch's number.

        What is written meanwhile and numbered before is replaced too, what is numbered later stays.
        """
        other = SampleStore(self.spark, source)
        there = other.spans()
        if not there:
            raise ValueError(f"{source} holds no store")
        while True:
            number = max((b for _, b in self._spans()), default=0) + 1
            if other._merge(there, self.root, (1, number), fresh=True):
                return number

    def status(self) -> dict[str, int]:
        """Numbers of live batches, of stored points and of series."""
        return {"batches": len(self.spans()), "points": self._points().count(), "series": self.catalog().count()}


def upserted(store: SampleStore) -> Labelled:
    """All samples of a store, one row a point."""
    return last_write_wins(store.all())
