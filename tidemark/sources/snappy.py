"""Snappy blocks: by the library that Spark's JVM brings, and by Arrow in tasks, which have no JVM at hand."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession

#: What a block may unpack to, in bytes; a small body may claim any size.
MOST = 64 << 20


class Snappy:
    def __init__(self, spark: SparkSession) -> None:
        self._codec = spark.sparkContext._jvm.org.xerial.snappy.Snappy

    def unpack(self, data: bytes) -> bytes:
        """The bytes of a block; ValueError if it is none, or one of more than MOST bytes."""
        try:
            size = self._codec.uncompressedLength(bytearray(data))
            if size > MOST:
                raise ValueError(f"{size} bytes when unpacked")
            return bytes(self._codec.uncompress(bytearray(data)))
        except ValueError:
            raise
        except Exception as error:
            raise ValueError("not a Snappy block") from error

    def pack(self, data: bytes) -> bytes:
        return bytes(self._codec.compress(bytearray(data)))


class TaskSnappy:
    """The same blocks, without a session."""

    def unpack(self, data: bytes) -> bytes:
        """The bytes of a block; ValueError if it is none, or one of more than MOST bytes."""
        size = 0
        for k, byte in enumerate(data[:5]):
            size |= (byte & 127) << 7 * k
            if byte < 128:
                break
        else:
            raise ValueError("not a Snappy block")
        if size > MOST:
            raise ValueError(f"{size} bytes when unpacked")
        try:
            return pa.decompress(data, size, "snappy", asbytes=True)
        except (pa.ArrowException, OSError) as error:
            raise ValueError("not a Snappy block") from error

    def pack(self, data: bytes) -> bytes:
        return pa.compress(data, "snappy", asbytes=True)
