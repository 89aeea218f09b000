"""The anomaly detector over a stream of samples, one state a series.

Series are told by metric and label set. Samples are folded in the order in which they arrive. A series that nothing
has been heard of for ``ttl`` milliseconds of processing time starts anew; this stands for a bound on the number of
series, since a stream has no order of use across its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.anomaly import EVENT, START, Settings, step
from tidemark.sources.model import series_of

OUTPUT = T.StructType([T.StructField("metric", T.StringType()), T.StructField("series", T.StringType()), *EVENT.fields])
STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("fast", T.DoubleType()), T.StructField("slow", T.DoubleType()), T.StructField("variance", T.DoubleType())])
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Detector(StatefulProcessor):
    def __init__(self, how: Settings, ttl: int | None) -> None:
        self.how, self.ttl = how, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("detector", STATE, ttlDurationMs=self.ttl) if self.ttl else handle.getValueState("detector", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else START
        found = []
        for part in rows:
            for ts, value in zip(part["ts"].tolist(), part["value"].tolist(), strict=True):
                state, event = step(state, float(value), self.how)
                if event:
                    found.append((*key, ts, value, *event))
        self.state.update(state)
        yield pd.DataFrame(found, columns=OUTPUT.names)

    def close(self) -> None:
        pass


def detect_stream(samples: DataFrame, how: Settings | None = None, ttl: int | None = 6 * 3600 * 1000) -> DataFrame:
    """(metric, series, ts, value, expected, z_score, type) of the anomalies in a stream of samples.

    The session must keep state in RocksDB (``PROVIDER``) for state with a time to live.
    """
    keyed = samples.select("metric", series_of(F.col("labels")).alias("series"), "ts", "value").where("value is not null")
    stateful = Detector(how or Settings(), ttl)
    return keyed.groupBy("metric", "series").transformWithStateInPandas(stateful, OUTPUT, "Append", "ProcessingTime" if ttl else "None")
