"""Upserts: of the samples of a series at one time, the one written last stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.model import Labelled

#: Gives samples dealt to partitions, perhaps with a column _b of the part of the series that a row is dealt to.
Deal = Callable[[Labelled], DataFrame]


def last_write_wins(samples: Labelled, deal: Deal | None = None) -> Labelled:
    """One row for each (metric, label set, ts), with the value of the greatest ingest_seq.

    A partial aggregation runs before the shuffle, so rewriting a point any number of times doesn't skew a task. With
    ``deal`` the rows are dealt first, for a reader that sorts parts of series next and then needs no shuffle of its
    own.
    """
    rows = deal(samples) if deal else samples.frame
    keys = ["metric", *samples.keys, *(["_b"] if "_b" in rows.columns else []), "ts"]
    kept = rows.groupBy(*keys).agg(F.max_by("value", "ingest_seq").alias("value"))
    return samples.with_frame(kept)
