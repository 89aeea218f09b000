"""The sample model: one row a point, a metric name, labels, milliseconds and a double.

A frame of samples has the columns metric, ts, value, maybe ingest_seq, and labels in one of two forms: a map column
``labels`` (names known only from the data) or one nullable column ``l_<name>`` a label (names known beforehand, null
for a missing label). The second form groups and compares without maps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("ts", T.LongType()),
    T.StructField("value", T.DoubleType()),
])
STORED = T.StructType([*SCHEMA.fields, T.StructField("ingest_seq", T.LongType())])
LABELS = "map<string,string>"
NAME = "__name__"


def series_of(labels: Column) -> Column:
    """Canonical text of a label set, equal for equal sets in any order; a null set is the empty one."""
    entries = F.sort_array(F.map_entries(F.coalesce(labels, F.create_map().cast(LABELS))))
    return F.coalesce(F.to_json(F.map_from_entries(entries)), F.lit("{}"))


def labels_of(series: Column) -> Column:
    return F.from_json(series, T.MapType(T.StringType(), T.StringType()))


@dataclass(frozen=True)
class Labelled:
    """A frame whose label sets are told by key columns: flat ones for known names, else ``series``."""

    frame: DataFrame
    names: tuple[str, ...] | None

    @property
    def keys(self) -> list[str]:
        return ["series"] if self.names is None else [f"l_{n}" for n in self.names]

    def label(self, name: str) -> Column:
        """The value of a label, null where it is missing."""
        if self.names is None:
            return labels_of(F.col("series"))[name]
        return F.col(f"l_{name}") if name in self.names else F.lit(None).cast("string")

    def labels(self) -> Column:
        if self.names is None:
            return labels_of(F.col("series"))
        if not self.names:
            return F.create_map().cast(LABELS)
        pairs = [x for n in self.names for x in (F.lit(n), F.col(f"l_{n}"))]
        return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())

    def with_frame(self, frame: DataFrame) -> Labelled:
        return Labelled(frame, self.names)


@dataclass(frozen=True)
class MapLabelled(Labelled):
    """Samples that still have their labels as a map, for predicates before the map becomes text."""

    def label(self, name: str) -> Column:
        return F.col("labels")[name]

    def labels(self) -> Column:
        return F.coalesce(F.col("labels"), F.create_map().cast(LABELS))


def prom_labels(metric: Column, labels: Column) -> Column:
    """Labels with the metric as ``__name__``; a label of that name wins over the metric."""
    named = F.when(metric.isNotNull() & ~F.coalesce(F.map_contains_key(labels, F.lit(NAME)), F.lit(False)), F.create_map(F.lit(NAME), metric))
    return F.map_concat(F.coalesce(named, F.create_map().cast(LABELS)), F.coalesce(labels, F.create_map().cast(LABELS)))
