import math
import random

import pytest

from tidemark.operators.anomaly import START, Settings, detect, filtered, step
from tidemark.sources.adapters import FrameSource
from tidemark.sources.model import SCHEMA, STORED
from tidemark.streaming.anomalies import PROVIDER, detect_stream


def events(values, how=Settings()):
    state, found = START, []
    for k, v in enumerate(values):
        state, event = step(state, v, how)
        if event:
            found.append((k, event[2]))
    return found


JITTER = [10 + (k % 3 - 1) * 0.1 for k in range(50)]


def test_detector():
    assert events([*JITTER, 100]) == [(50, "spike")] and events([*JITTER, 0.1]) == [(50, "drop")]
    assert events([42.0] * 100) == [] and events([1.0, 1000.0] * 5) == []
    assert events([42.0] * 20 + [43.0])[0] == (20, "spike")
    assert events([math.nan, math.inf, -math.inf] * 20) == [] and events([*JITTER, math.nan, 100]) == [(51, "spike")]
    assert "drift" in {kind for _, kind in events([*JITTER, *(10 + 2 * k for k in range(40))], Settings(threshold=1.5))}
    state, event = step((20, 5.0, 5.0, 0.0), 6.0, Settings())
    assert event == (5.0, 100.0, "spike") and state[0] == 21
    for bad in ({"alpha": 0}, {"threshold": 0}, {"warmup": -1}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_batch_equals_a_loop_over_each_series(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for s in range(9):
        values = [rng.gauss(10, 1) + (50 if rng.random() < 0.03 else 0) for _ in range(rng.randint(1, 300))]
        rows += [("m", {"s": str(s)} if s else None, 1000 * k // 2, v, k) for k, v in enumerate(values)]
        want |= {(s, 1000 * k // 2, kind) for k, kind in events(values)}
    rng.shuffle(rows)
    got = detect(FrameSource(spark.createDataFrame(rows, STORED)).all())
    assert {(0 if r.series == "{}" else int(r.series[6]), r.ts, r.type) for r in got.collect()} == want and want
    assert detect(FrameSource(spark.createDataFrame([], STORED)).all()).count() == 0


def test_filters(spark):
    rows = [("cpu_a", 1.0, "spike"), ("cpu/a", 5.0, "drop"), ("mem", 9.0, "drift"), ("cpu_b", 9.0, "drop")]
    own = spark.createDataFrame(rows, "metric string, z_score double, type string")
    names = lambda **k: sorted(r.metric for r in filtered(own, **k).collect())
    assert names() == ["cpu/a", "cpu_a", "cpu_b", "mem"] and names(metric="cpu*") == ["cpu_a", "cpu_b"] and names(metric="cpu?[ab]") == ["cpu_a", "cpu_b"]
    assert names(min_z=5.0) == ["cpu/a", "cpu_b", "mem"] and names(types=" spike, drift,") == ["cpu_a", "mem"] and names(metric="[") == [] and names(metric=r"me\m") == ["mem"] and names(metric="cpu_[^a]") == ["cpu_b"]
    with pytest.raises(ValueError):
        filtered(own, types="spike,jump")


def test_stream_keeps_state_between_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    (tmp_path / "in").mkdir()
    rows = [("m", {"a": "1"}, k, v) for k, v in enumerate([*JITTER, 100.0])]
    for k, part in enumerate((rows[:30], rows[30:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.json(str(tmp_path / f"made{k}"))
        for f in (tmp_path / f"made{k}").glob("part-*"):
            f.rename(tmp_path / "in" / f"{k}.json")
    samples = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = detect_stream(samples).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.sql("SELECT * FROM found").collect()
    assert [(r.metric, r.series, r.ts, r.type) for r in got] == [("m", '{"a":"1"}', 50, "spike")]
