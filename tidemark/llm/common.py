"""Helpers shared by the operators: table access, durable intermediate results, word pattern."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Words are maximal runs of anything but space and the controls 9 to 13.
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the master is local is a temporary folder made; a cluster without the setting is an
    error, since a folder of one machine would be invisible to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    if not urlparse(found).scheme and found.startswith("/") and spark.sparkContext.master.startswith("local"):
        found = f"file://{found}"
    return found


#: This process's part of the shared folder.
RUN = f"tidemark/{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{RUN}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str | None = None) -> bool:
    """Deletes an intermediate result that nothing reads any more; without a path all that this process wrote aside."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or f"{shared_dir(spark)}/{RUN}")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so that a lost executor costs a read and not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from compressed Parquet in the shared folder; for what is too large for a plain checkpoint."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that shuffles and sorts both sides, whatever Spark takes their sizes for.

    Rows that an explode makes aren't in Spark's estimate, nor what Parquet packs: a table of hundreds of MB seems to be
    under the limit of a broadcast, which the driver holds as a whole.
    """
    return df.hint("merge")


#: Rows of an Arrow batch, at most. A text may have megabytes and a bucket a thousand members, and a batch is held twice.
BATCH_ROWS = 500


def _release() -> None:
    """Gives freed memory back, since a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow with small batches: the session's batch size is lowered to BATCH_ROWS if it is larger."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _release()

    return df.mapInArrow(tidied, schema)


def keep_rows(docs: DataFrame, text: str, made: Callable[[], Callable[[Iterator[str | None]], list[bool]]]) -> DataFrame:
    """The rows of docs whose text passes, whatever their other columns. made() gives a task its test of many texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = made()
        for batch in batches:
            texts = (x.as_py() for x in batch.column(batch.schema.get_field_index(text)))
            yield batch.filter(pa.array(test(texts), pa.bool_()))

    return map_in_arrow(docs, run, docs.schema)
