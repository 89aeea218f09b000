"""A shard store with size-tiered compaction and versioned manifests.

An arrival is appended as a run of small immutable Parquet shards. A manifest lists the live shards; a new version is
written aside and takes effect by one rename that fails if the version exists, so readers see a whole version or none
and of two writers one starts anew. Compaction sorts shards into tiers by size, each ``FANOUT`` times the one below, and
merges a tier of enough shards into files of about ``TARGET`` bytes. A merge concatenates whole input splits without a
shuffle, so a tier of any size is one job whose tasks each write one file. The driver handles manifest rows only.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, table

TARGET = 128 << 20
#: Shards below this size share the lowest tier.
SMALLEST = 1 << 20
FANOUT = 4


class VersionTaken(Exception):
    """Another writer committed the version first."""


class ShardStore:
    """Shards under a root folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, smallest: int = SMALLEST, fanout: int = FANOUT) -> None:
        self.spark, self.root, self.target, self.smallest, self.fanout = spark, root.rstrip("/"), target, smallest, fanout
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Committed versions in order."""
        folder = self._path(f"{self.root}/versions")
        found = self._files().listStatus(folder) if self._files().exists(folder) else []
        return sorted(int(x.getPath().getName()) for x in found)

    def manifest(self, version: int | None = None) -> DataFrame | None:
        """(file, bytes, rows, arrival) of the live shards of a version, the latest by default; None before the first."""
        there = self.versions()
        if not there:
            return None
        return self.spark.read.parquet(f"{self.root}/versions/{version if version is not None else there[-1]:012d}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version's shards."""
        found = self.manifest(version)
        files = [r.file for r in found.select("file").toLocalIterator()] if found is not None else []
        if not files:
            raise ValueError("the store has no shards")
        return self.spark.read.parquet(*files)

    def commit(self, entries: DataFrame, version: int) -> int:
        """Makes entries the given version; VersionTaken if it exists."""
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        entries.coalesce(1).write.parquet(staged)
        self._files().mkdirs(self._path(f"{self.root}/versions"))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 0)
        try:
            context.rename(self._path(staged), self._path(f"{self.root}/versions/{version:012d}"), options)
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            self._files().delete(self._path(staged), True)
            raise VersionTaken(version) from None
        return version

    def _entries(self, run: str, arrival: Column) -> DataFrame:
        """Manifest rows of a run, from the files' metadata: no column of the data is read."""
        files = self.spark.read.parquet(run).select("_metadata.file_path", "_metadata.file_size")
        counted = files.groupBy("file_path", "file_size").agg(F.count("*").alias("rows"))
        return counted.select(F.col("file_path").alias("file"), F.col("file_size").alias("bytes"), "rows", arrival.cast("string").alias("arrival"))

    def append(self, rows: DataFrame, arrival: str) -> int:
        """Writes rows as shards, one a partition that has any, and commits them. Returns the version.

        Without a row a version is committed that lists no shard more. Repeated rows stay repeated.
        """
        run = f"{self.root}/data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(run)
        made = self._entries(run, F.lit(arrival))
        while True:
            there = self.versions()
            live = self.manifest()
            try:
                return self.commit(made if live is None else live.unionByName(made), there[-1] + 1 if there else 1)
            except VersionTaken:
                continue

    def tier(self) -> Column:
        """The tier of a manifest row: how often its size is FANOUT times the smallest; null from half the target on."""
        steps = F.floor(F.log(F.greatest(F.col("bytes") / self.smallest, F.lit(1.0))) / F.log(F.lit(float(self.fanout))) + 1e-9)
        return F.when(F.col("bytes") * 2 < self.target, steps.cast("int"))

    def compact_once(self) -> bool:
        """Merges each tier of FANOUT shards or more and commits the result; False if there is none."""
        there, live = self.versions(), self.manifest()
        if live is None:
            return False
        live = live.withColumn("tier", self.tier())
        tiers = live.where("tier is not null").groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).where(F.col("n") >= self.fanout)
        made, merged, runs = [], [], []
        for t in sorted(tiers.collect()):  # a row a tier: about log(target / smallest)
            files = [r.file for r in live.where(F.col("tier") == t.tier).select("file").toLocalIterator()]
            run = f"{self.root}/data/{uuid.uuid4().hex}"
            self.spark.read.parquet(*files).coalesce(max(1, round(t.bytes / self.target))).write.option("compression", "zstd").parquet(run)
            made.append(self._entries(run, F.lit("merged")))
            merged.append(t.tier)
            runs.append(run)
        if not made:
            return False
        kept = live.where(F.col("tier").isNull() | ~F.col("tier").isin(merged)).drop("tier")
        try:
            self.commit(reduce(DataFrame.unionByName, made, kept), there[-1] + 1)
        except VersionTaken:
            for run in runs:  # no manifest names them
                self._files().delete(self._path(run), True)
            raise
        return True

    def compact(self) -> int:
        """Merges until no tier has FANOUT shards, each round in a version of its own. Returns the latest version."""
        while True:
            try:
                if not self.compact_once():
                    return self.versions()[-1] if self.versions() else 0
            except VersionTaken:
                continue  # the shards of the other writer join the next round

    def vacuum(self, keep: int = 1, older_than: float = 3600.0, now: float | None = None) -> int:
        """Deletes versions but the latest ``keep``, then the shards that no version left lists. Returns their number.

        Only what was last changed ``older_than`` seconds ago goes, so readers of an old version and writers of a new
        one that are younger are safe; runs that a writer left behind without a commit go too.
        """
        now = time.time() if now is None else now
        there, cut = self.versions(), (now - older_than) * 1000
        files = lambda name: list(self._files().listStatus(self._path(name))) if self._files().exists(self._path(name)) else []
        old = {int(x.getPath().getName()) for x in files(f"{self.root}/versions") if x.getModificationTime() <= cut} & set(there[:-keep])
        for v in sorted(old):
            self._files().delete(self._path(f"{self.root}/versions/{v:012d}"), True)
        listed: set[str] = set()
        for v in set(there) - old:  # manifest rows, as everywhere on the driver
            listed |= {r.name for r in self.manifest(v).select(F.regexp_extract("file", r"/data/(.*)$", 1).alias("name")).toLocalIterator()}
        gone = 0
        for run in (x.getPath().getName() for x in files(f"{self.root}/data")):
            shards = [x for x in files(f"{self.root}/data/{run}") if x.getPath().getName().startswith("part-")]
            dead = [x for x in shards if f"{run}/{x.getPath().getName()}" not in listed and x.getModificationTime() <= cut]
            for x in dead:
                self._files().delete(x.getPath(), False)
            gone += len(dead)
            if dead and len(dead) == len(shards):
                self._files().delete(self._path(f"{self.root}/data/{run}"), True)
        for x in files(f"{self.root}/staged"):
            if x.getModificationTime() <= cut:
                self._files().delete(x.getPath(), True)
        return gone


def arrival_of(doc_id: Column) -> Column:
    """Five arrivals of falling size that make up the whole table: a half, a quarter, an eighth and two sixteenths."""
    part = F.pmod(F.coalesce(doc_id, F.lit(0)), F.lit(16))
    return F.when(part < 8, 0).when(part < 12, 1).when(part < 14, 2).when(part < 15, 3).otherwise(4)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents appended in five arrivals, compacted, and read by the latest manifest: (doc_id, arrival, n_bytes, text_md5).

    Each row is in one live shard; null texts have a null checksum; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, scratch(spark, "shards"))
    arrival = arrival_of(F.col("doc_id"))
    for k in range(5):
        store.append(docs.withColumn("arrival", arrival).where(F.col("arrival") == k), str(k))
    store.compact()
    store.vacuum(older_than=0)  # no one else reads this store
    rows = store.read() if store.manifest().limit(1).count() else docs.withColumn("arrival", arrival)
    return rows.select("doc_id", "arrival", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL = """
SELECT doc_id,
  CASE WHEN part < 8 THEN 0 WHEN part < 12 THEN 1 WHEN part < 14 THEN 2 WHEN part < 15 THEN 3 ELSE 4 END AS arrival,
  CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5
FROM (SELECT doc_id, text, ((coalesce(doc_id, 0) % 16) + 16) % 16 AS part FROM documents)
"""
