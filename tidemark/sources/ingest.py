"""Ways in: JSON writes, protobuf remote writes, Influx lines, and a generator of synthetic samples."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.model import LABELS, NAME, SCHEMA

WRITE = T.StructType([T.StructField("samples", T.ArrayType(SCHEMA))])
#: Largest body of a write, in bytes.
MAX_BODY = 4 << 20


class BadWrite(ValueError):
    """A write without samples, or one that can't be read."""


class TooLarge(BadWrite):
    """A body over the limit."""


def read_json_writes(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Samples of files of JSON writes, one ``{"samples": [...]}`` a line (or a file)."""
    bodies = spark.read.schema(WRITE).option("multiLine", multi_line).json(path)
    return bodies.select(F.inline("samples"))


def parse_json(body: str) -> list[tuple]:
    """(metric, labels, ts, value) of one JSON write; one without samples is an error."""
    try:
        samples = json.loads(body, parse_constant=lambda c: (_ for _ in ()).throw(BadWrite(f"{c} is not JSON")))["samples"]
        found = [(s.get("metric", ""), s.get("labels"), int(s.get("ts", 0)), float(s.get("value", 0.0))) for s in samples or []]
    except (ValueError, KeyError, TypeError, AttributeError) as error:
        raise BadWrite(f"bad JSON: {error}") from error
    if not found:
        raise BadWrite("no samples")
    return found


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise BadWrite("truncated message")
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value & (1 << 64) - 1

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if kind == 2:
            size = varint()
        if size is None or at + size > len(data):
            raise BadWrite("bad message")
        yield tag >> 3, kind, data[at : at + size]
        at += size


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def parse_remote_write(data: bytes) -> list[tuple]:
    """(metric, labels or None, ts, value) of a remote-write message; series without a name are dropped.

    Of the wire format: series are field 1 of the message; labels (name 1, value 2) field 1 and samples (value 1 as a
    double, milliseconds 2) field 2 of a series. Exemplars and histograms are not read.
    """
    found = []
    for number, kind, series in _fields(data):
        if (number, kind) != (1, 2):
            continue
        labels, points = {}, []
        for n, k, part in _fields(series):
            if (n, k) == (1, 2):
                pair = {m: v for m, w, v in _fields(part) if w == 2}
                labels[pair.get(1, b"").decode()] = pair.get(2, b"").decode()
            elif (n, k) == (2, 2):
                values = {(m, w): v for m, w, v in _fields(part)}
                points.append((_signed(values.get((2, 0), 0)), struct.unpack("<d", values.get((1, 1), bytes(8)))[0]))
        metric = labels.pop(NAME, "")
        if metric:
            found += [(metric, labels or None, ts, value) for ts, value in points]
    if not found:
        raise BadWrite("no samples")
    return found


def parse_remote_read(data: bytes) -> list[tuple[int, int, list[tuple[str, str, str]]]]:
    """(start, end, [(name, operator, value)]) of each query of a remote-read message.

    Of the wire format: queries are field 1; start, end and matchers fields 1 to 3 of a query; type (0 to 3 for =, !=,
    =~, !~), name and value fields 1 to 3 of a matcher.
    """
    operators, found = ("=", "!=", "=~", "!~"), []
    for number, kind, query in _fields(data):
        if (number, kind) != (1, 2):
            continue
        start = end = 0
        matchers = []
        for n, k, part in _fields(query):
            if (n, k) == (1, 0):
                start = _signed(part)
            elif (n, k) == (2, 0):
                end = _signed(part)
            elif (n, k) == (3, 2):
                own = {m: v for m, _, v in _fields(part)}
                if own.get(1, 0) > 3:
                    raise BadWrite("unknown matcher type")
                matchers.append((own.get(2, b"").decode(), operators[own.get(1, 0)], own.get(3, b"").decode()))
        found.append((start, end, matchers))
    return found


def _field(number: int, kind: int, value: bytes | int) -> bytes:
    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
        return bytes(out)

    head = varint(number << 3 | kind)
    if kind == 0:
        return head + varint(value & (1 << 64) - 1)
    return head + (varint(len(value)) if kind == 2 else b"") + value


def remote_write_body(samples: Iterable[tuple[str, tuple[tuple[str, str], ...], int, float]]) -> bytes:
    """A remote-write message with a series for each sample (metric, other labels, ts, value)."""

    @cache
    def named(metric: str, labels: tuple[tuple[str, str], ...]) -> bytes:
        return b"".join(_field(1, 2, _field(1, 2, k.encode()) + _field(2, 2, v.encode())) for k, v in ((NAME, metric), *labels))

    return b"".join(_field(1, 2, named(metric, labels) + _field(2, 2, _field(1, 1, struct.pack("<d", v)) + _field(2, 0, t))) for metric, labels, t, v in samples)


def remote_read_answer(results: list[list[tuple[tuple[tuple[str, str], ...], list[tuple[int, float]]]]]) -> bytes:
    """A remote-read answer: for each query its series, each as sorted labels and (ts, value) in order."""
    out = b""
    for series in results:
        body = b""
        for labels, points in series:
            own = b"".join(_field(1, 2, _field(1, 2, k.encode()) + _field(2, 2, v.encode())) for k, v in labels)
            own += b"".join(_field(2, 2, _field(1, 1, struct.pack("<d", v)) + _field(2, 0, t)) for t, v in points)
            body += _field(1, 2, own)
        out += _field(1, 2, body)
    return out


def decode(body: bytes, content_type: str = "", encoding: str = "", unsnap=None) -> list[tuple]:
    """(metric, labels, ts, value) of a write's body, JSON or protobuf.

    ``unsnap`` decompresses Snappy; it is tried where the body isn't declared to be compressed. A body that starts with
    a brace and is no message is taken for JSON.
    """
    if len(body) > MAX_BODY:
        raise TooLarge(f"over {MAX_BODY} bytes")
    if not body:
        raise BadWrite("empty body")
    if "json" in content_type:
        return parse_json(body.decode())
    if "snappy" in encoding and unsnap is None:
        raise BadWrite("no Snappy decoder is given")
    data = body
    if unsnap is not None:
        try:
            data = unsnap(body)
        except Exception as error:
            if "snappy" in encoding:
                raise BadWrite(f"bad Snappy: {error}") from error
    try:
        return parse_remote_write(data)
    except (BadWrite, UnicodeDecodeError):
        if body.lstrip()[:1] == b"{":
            return parse_json(body.decode())
        raise


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A frame of samples from decoded rows."""
    return spark.createDataFrame(rows, SCHEMA)


def read_influx(spark: SparkSession, path: str) -> DataFrame:
    """Samples of files of Influx lines ``measurement,tags fields nanoseconds``.

    The metric is measurement_field of the first numeric field; lines that don't fit are left out. No escapes.
    """
    return influx_lines(spark.read.text(path))


def influx_lines(lines: DataFrame) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts.alias("p")).where(F.size("p") == 3)
    rows = rows.select(F.split(F.col("p")[0], ",").alias("head"), F.split(F.col("p")[1], ",").alias("fields"), F.expr("try_cast(p[2] AS BIGINT)").alias("ns"))
    number = lambda f: F.regexp_replace(F.element_at(F.split(f, "=", 2), 2), r"^([-+0-9.eE]+)[iu]$", "$1").try_cast("double")
    numeric = F.filter("fields", lambda f: f.contains("=") & ~f.startswith("=") & number(f).isNotNull())
    tags = F.filter(F.slice("head", 2, 1_000_000), lambda t: t.contains("=") & ~t.startswith("="))
    rows = rows.where("ns is not null AND head[0] <> ''").withColumn("first", F.get(numeric, 0)).where("first is not null")
    labels = F.map_from_entries(F.transform(tags, lambda t: F.struct(F.split(t, "=", 2)[0].alias("k"), F.split(t, "=", 2)[1].alias("v"))))
    return rows.select(
        F.concat(F.col("head")[0], F.lit("_"), F.split("first", "=", 2)[0]).alias("metric"),
        F.when(F.size(tags) > 0, labels).otherwise(F.create_map().cast(LABELS)).alias("labels"),
        F.expr("ns div 1000000").alias("ts"),
        number(F.col("first")).alias("value"),
    )


def synthetic(spark: SparkSession, series: int, points: int, start: int = 1_704_067_200_000, step: int = 10_000, seed: int = 1, parts: int | None = None) -> DataFrame:
    """Samples of ``series`` series over ten metrics, job, env and host: counters for even metrics, gauges for odd ones."""
    rows = spark.range(0, series * points, 1, parts) if parts else spark.range(series * points)
    k, i = F.pmod("id", F.lit(series)), F.floor(F.col("id") / series)
    noise = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000.0
    metric = F.pmod(k, F.lit(10))
    labels = F.create_map(F.lit("job"), F.concat(F.lit("job-"), F.pmod(k, F.lit(6))), F.lit("env"), F.concat(F.lit("env-"), F.pmod(k, F.lit(3))), F.lit("host"), F.concat(F.lit("host-"), F.floor(k / 10)))
    value = F.when(metric % 2 == 0, i * 10 + noise).otherwise(50 + 10 * F.sin(i / 30.0) + noise)
    return rows.select(F.concat(F.lit("metric_"), metric.cast("string")).alias("metric"), labels.alias("labels"), (F.lit(start) + i * step).alias("ts"), value.alias("value"))
