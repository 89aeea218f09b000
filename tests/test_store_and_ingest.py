import json
import math
import re
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalog, render
from tidemark.plans.engine import Engine
from tidemark.sources import ingest
from tidemark.sources.model import SCHEMA
from tidemark.sources.snappy import Snappy, TaskSnappy
from tidemark.sources.store import DAY, SampleStore, TooManyBatches, TooManySeries, upserted


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def points(samples):
    return sorted((r.ts, r.value) for r in samples.frame.collect())


def test_later_batches_win_before_and_after_compaction(spark, tmp_path):
    store = SampleStore(spark, f"file://{tmp_path}/s")
    assert store.batches() == [] and store.scan("a").frame.count() == 0 and store.compact() == 0
    assert store.write(frame(spark, [("a", None, 10, 1.0), ("a", None, -DAY, 9.0)])) == 1
    assert store.compact() == 0
    store.write(frame(spark, [("a", {}, 10, 2.0), ("b", {"k": "v"}, 20, 3.0)]))
    for _ in range(2):
        assert points(store.scan("a")) == [(-DAY, 9.0), (10, 2.0)] and points(store.scan("b", 0, 19)) == [] and points(upserted(store)) == [(-DAY, 9.0), (10, 2.0), (20, 3.0)]
        store.compact()
    assert len(store.batches()) == 1 and store.status() == {"batches": 1, "points": 3, "series": 2}
    assert store.vacuum() == 0 and store.vacuum(0, now=2**60) == 2 and points(upserted(store)) == [(-DAY, 9.0), (10, 2.0), (20, 3.0)]
    store.write(frame(spark, [("a", None, 10, 7.0)]))
    assert points(store.scan("a", 0)) == [(10, 7.0)]
    assert [(r.metric, r.series) for r in store.series_counts().orderBy("metric").collect()] == [("a", 1), ("b", 1)]
    store.snapshot(f"file://{tmp_path}/copy")
    assert points(SampleStore(spark, f"file://{tmp_path}/copy").scan("a", 0)) == [(10, 7.0)]
    assert [r.value for r in Engine(spark, store).query("a", 20).collect()] == [7.0]


def test_two_writers_of_a_number_both_keep_their_batch(spark, tmp_path):
    one, two = (SampleStore(spark, f"file://{tmp_path}/s", max_series=2) for _ in "ab")
    one.write(frame(spark, [("a", {"k": "0"}, 1, 1.0)]))
    take, raced = one.files.take, []

    def late(staged, name):
        if not raced:  # between this writer's choice of a number and its rename, another one takes it
            raced.append(two.write(frame(spark, [("a", {"k": "1"}, 2, 2.0)])))
        return take(staged, name)

    one.files.take = late
    assert one.write(frame(spark, [("a", {"k": "0"}, 3, 3.0)])) == 3 and raced == [2]
    assert points(SampleStore(spark, one.root).scan("a")) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert not [n for n, _ in one.files.listed(one.root) if n.startswith("_")]
    # the cap is checked anew: each alone would fit, both don't
    raced.clear()
    two.max_series = one.max_series = 3
    with pytest.raises(TooManySeries):
        late2 = one.write
        one.files.take = lambda staged, name: (raced or raced.append(two.write(frame(spark, [("a", {"k": "2"}, 4, 4.0)]))), take(staged, name))[1]
        late2(frame(spark, [("a", {"k": "3"}, 5, 5.0)]))
    assert one.batches() == [1, 2, 3, 4] and not [n for n, _ in one.files.listed(one.root) if n.startswith("_")]


def test_a_write_during_compaction_stays_after_it(spark, tmp_path):
    store, other = (SampleStore(spark, f"file://{tmp_path}/s") for _ in "ab")
    for v in (1.0, 2.0):
        store.write(frame(spark, [("a", None, 10, v), ("a", None, 20 + int(v), v)]))
    merge = store._merge

    def slow(*args):
        other.write(frame(spark, [("a", None, 10, 9.0)]))
        return merge(*args)

    store._merge = slow
    assert store.compact() == 2 and store.spans() == [(1, 2), (3, 3)]
    want = [(10, 9.0), (21, 1.0), (22, 2.0)]
    assert points(store.scan("a")) == want
    store._merge = merge
    assert other.compact() == 2 and points(store.scan("a")) == want and store.vacuum(0, now=2**60) == 4 and points(store.scan("a")) == want
    # another compaction was first: nothing changes and nothing is left behind
    store.write(frame(spark, [("a", None, 30, 1.0)]))
    spans = store.spans()
    other.compact()
    store.spans = lambda: spans
    assert store.compact() == 0 and not [n for n, _ in store.files.listed(store.root) if n.startswith("_")]


def test_tiers_merge_neighbours_of_similar_size(spark, tmp_path):
    store = SampleStore(spark, f"file://{tmp_path}/s")
    store.write(spark.range(60_000).selectExpr("'a' AS metric", "map('k', CAST(id % 50 AS STRING)) AS labels", "id AS ts", "rand(1) AS value"))
    for k in range(4):
        store.write(frame(spark, [("a", {"k": "1"}, k, float(k))]))
    assert store.compact_tiers() == 4 and store.spans() == [(1, 1), (2, 5)] and store.compact_tiers() == 0
    assert store.scan("a").frame.count() == 60_000 + 3 and store.catalog().count() == 50
    assert points(store.scan("a", 0, 3, lambda s: s.label("k") == "1")) == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0)]


def test_rows_of_a_batch_keep_their_order_in_any_number_of_partitions(spark, tmp_path):
    store = SampleStore(spark, f"file://{tmp_path}/s")
    store.write(spark.range(0, 200, 1, 200).selectExpr("'a' AS metric", "map() AS labels", "0L AS ts", "CAST(id AS DOUBLE) AS value"))
    assert points(store.scan("a")) == [(0, 199.0)]
    store.write(frame(spark, [("b", None, 0, 1.0)]))
    store.compact()
    assert points(store.scan("a")) == [(0, 199.0)]


def test_listings_read_no_samples_and_label_filters_reach_the_scan(spark, tmp_path):
    store = SampleStore(spark, f"file://{tmp_path}/s")
    store.write(spark.range(3000).selectExpr("'a' AS metric", "map('k', CAST(id % 300 AS STRING)) AS labels", "id AS ts", "1D AS value"))
    engine = Engine(spark, store)
    assert [r.name for r in engine.label_names().collect()] == ["__name__", "k"] and engine.label_values("k").count() == 300
    for listing in (engine.label_names(), engine.label_values("k"), store.series_counts()):
        plan = listing._jdf.queryExecution().executedPlan().toString()
        assert "kind=points" not in plan and "value:double" not in plan
    plan = engine.query('a{k=~"1.?"}', 3000)._jdf.queryExecution().optimizedPlan().toString()
    scan = re.search(r"Filter \((.*)\n.*Relation \[", plan)  # what stands right above the relation goes to the files
    assert scan and re.search(r"series#\d+ IN", scan[1]) and "from_json" not in scan[1]
    assert engine.query('count(a{k=~"1.?"})', 3000).collect()[0].value == 11 and engine.query('count(a{k!="7"})', 3000).collect()[0].value == 299


def test_snapshot_and_restore(spark, tmp_path):
    store, copy = SampleStore(spark, f"file://{tmp_path}/s"), f"file://{tmp_path}/copy"
    for v in (1.0, 2.0):
        store.write(frame(spark, [("a", None, 10, v), ("b", {"k": "v"}, 20, v)]))
    store.snapshot(copy)
    with pytest.raises(ValueError):
        store.snapshot(copy)
    store.write(frame(spark, [("a", None, 10, 5.0), ("c", None, 1, 1.0)]))
    assert store.restore(copy) == 4 and points(upserted(store)) == [(10, 2.0), (20, 2.0)]
    assert sorted(r.metric for r in store.catalog().collect()) == ["a", "b"]
    store.write(frame(spark, [("a", None, 10, 7.0)]))
    assert points(store.scan("a")) == [(10, 7.0)] and store.compact() == 2 and points(store.scan("a")) == [(10, 7.0)]
    with pytest.raises(ValueError):
        store.restore(f"file://{tmp_path}/nothing")


def test_writes_wait_for_compaction(spark, tmp_path):
    store = SampleStore(spark, f"file://{tmp_path}/s", max_batches=2)
    for k in range(2):
        store.write(frame(spark, [("a", None, k, 1.0)]))
    with pytest.raises(TooManyBatches):
        store.write(frame(spark, [("a", None, 9, 1.0)]))
    store.compact()
    store.write(frame(spark, [("a", None, 9, 1.0)]))
    assert len(points(store.scan("a"))) == 3


def test_days_prune_the_scan(spark, tmp_path):
    store = SampleStore(spark, f"file://{tmp_path}/s")
    store.write(frame(spark, [("a", None, k * DAY, 1.0) for k in range(5)]))
    plan = store.scan("a", DAY, 2 * DAY).frame._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(metric,a)" in plan


def test_retention_drops_days_that_ended_before(spark, tmp_path):
    store = SampleStore(spark, f"file://{tmp_path}/s")
    store.write(frame(spark, [("a", None, k * DAY + 5, float(k)) for k in range(6)]))
    assert store.retain(10 * DAY, 0) == 0
    assert store.retain(6 * DAY, 2 * DAY - 5) == 4 and points(store.scan("a"))[0] == (4 * DAY + 5, 4.0)  # the day of the cut has a later sample
    assert store.retain(6 * DAY, 2 * DAY - 5) == 0 and points(store.scan("a")) == [(4 * DAY + 5, 4.0), (5 * DAY + 5, 5.0)]


def test_series_cap_takes_a_batch_whole_or_not_at_all(spark, tmp_path):
    store = SampleStore(spark, f"file://{tmp_path}/s", max_series=2)
    store.write(frame(spark, [("m", {"a": "1"}, 1, 1.0), ("m", {"a": "2"}, 1, 1.0)]))
    with pytest.raises(TooManySeries):
        store.write(frame(spark, [("n", None, 1, 1.0), ("m", {"a": "3"}, 1, 1.0)]))
    assert store.batches() == [1]
    store.write(frame(spark, [("m", {"a": "2"}, 2, 1.0), ("n", None, 1, 1.0), *(("", {"k": str(k)}, 1, 1.0) for k in range(5))]))
    with pytest.raises(TooManySeries):
        store.write(frame(spark, [("q", {"k": str(k)}, 1, 1.0) for k in range(3)]))
    SampleStore(spark, f"file://{tmp_path}/free", 0).write(frame(spark, [("q", {"k": str(k)}, 1, 1.0) for k in range(30)]))


def test_json_bodies(spark, tmp_path):
    body = {"samples": [{"metric": "m", "labels": {"a": "b"}, "ts": 5, "value": 1.5}, {"metric": "n", "ts": 6, "value": 2}]}
    assert ingest.parse_json(json.dumps(body)) == [("m", {"a": "b"}, 5, 1.5), ("n", None, 6, 2.0)]
    for bad in ("", "[]", "{}", '{"samples": []}', '{"samples": [{"ts": "x"}]}', '{"samples": [{"metric": "m", "value": NaN}]}'):
        with pytest.raises(ingest.BadWrite):
            ingest.parse_json(bad)
    (tmp_path / "w.json").write_text(json.dumps(body) + "\n" + json.dumps(body))
    assert ingest.read_json_writes(spark, str(tmp_path / "w.json")).count() == 4
    assert ingest.frame(spark, ingest.decode(json.dumps(body).encode(), "application/json")).count() == 2


def field(number, kind, value):
    def varint(x):
        out = b""
        while True:
            out += bytes([x & 127 | (128 if x > 127 else 0)])
            x >>= 7
            if not x:
                return out

    head = varint(number << 3 | kind)
    return head + (varint(value & (1 << 64) - 1) if kind == 0 else value if kind == 1 else varint(len(value)) + value)


def series(labels, samples):
    body = b"".join(field(1, 2, field(1, 2, k.encode()) + field(2, 2, v.encode())) for k, v in labels)
    body += b"".join(field(2, 2, field(1, 1, struct.pack("<d", v)) + field(2, 0, t)) for t, v in samples)
    return field(1, 2, body + field(3, 2, b"ignored"))


def test_remote_write_bodies():
    data = series([("__name__", "m"), ("a", "ü")], [(5, 1.5), (-7, math.inf)]) + series([("a", "b")], [(1, 1)]) + series([("__name__", "n")], [(9, 0)])
    want = [("m", {"a": "ü"}, 5, 1.5), ("m", {"a": "ü"}, -7, math.inf), ("n", None, 9, 0.0)]
    assert ingest.parse_remote_write(data) == want and ingest.decode(data) == want
    assert ingest.decode(data[::-1], encoding="snappy", unsnap=lambda x: x[::-1]) == want
    assert ingest.decode(b' {"samples": [{"metric": "m"}]}') == [("m", None, 0, 0.0)]
    for bad in (b"", b"\xff\xff", data[:-3], series([("a", "b")], [(1, 1)])):
        with pytest.raises(ingest.BadWrite):
            ingest.decode(bad)
    with pytest.raises(ingest.BadWrite):
        ingest.decode(data, encoding="snappy")
    with pytest.raises(ingest.TooLarge):
        ingest.decode(b"x" * (ingest.MAX_BODY + 1))


def test_influx_lines(spark):
    lines = ["cpu,host=a,r=x usage=1.5,idle=2 1700000000123456789", 'cpu name="s",n=3i 5000000', "bad", "cpu f=x 1", "cpu,h f=1 z", "mem used=1e3 -1000000", ""]
    got = sorted((r.metric, dict(r.labels), r.ts, r.value) for r in ingest.influx_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect())
    assert got == [("cpu_n", {}, 5, 3.0), ("cpu_usage", {"host": "a", "r": "x"}, 1_700_000_000_123, 1.5), ("mem_used", {}, -1, 1000.0)]


def test_synthetic_samples(spark):
    rows = ingest.synthetic(spark, 50, 20)
    assert rows.count() == 1000 and rows.select("metric", F.col("labels")["host"], "ts").distinct().count() == 1000
    assert rows.select("metric").distinct().count() == 10


def test_wire_formats(spark):
    texts = [render.number(x) for x in (1.0, -0.5, 1e21, 1.5e-7, 123456789.125, math.nan, math.inf, -math.inf, 0.0, 1e-5, 2.5e16, -1.25e20)]
    assert texts == ["1", "-0.5", "1000000000000000000000", "0.00000015", "123456789.125", "NaN", "+Inf", "-Inf", "0", "0.00001", "25000000000000000", "-125000000000000000000"]
    rows = frame(spark, [("m", {"b": "1"}, 2000, 1.0), ("m", {"a": "1"}, 1500, 2.0), ("m", {"b": "1"}, 1000, math.nan), (None, {}, 0, 5.0)])
    assert render.vector(rows.where("ts = 1500").collect())["data"] == {"resultType": "vector", "result": [{"metric": {"__name__": "m", "a": "1"}, "value": [1.5, "2"]}]}
    found = render.matrix(rows.collect())["data"]["result"]
    assert found[0] == {"metric": {}, "values": [[0.0, "5"]]} and found[-1]["values"] == [[1.0, "NaN"], [2.0, "1"]] and len(found) == 3
    assert render.plain_instant(rows.where("ts = 0").collect()) == [{"metric": None, "labels": {}, "timestamp": 0, "value": 5.0}]
    assert [render.seconds("1.5"), render.step("0.25")] == [1500, 250]
    for bad in ("x", "NaN", "inf"):
        with pytest.raises(ValueError):
            render.seconds(bad)
    with pytest.raises(ValueError):
        render.step("0")


def test_remote_writes_are_decoded_in_tasks(spark, tmp_path, monkeypatch):
    events = spark.range(12_001).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("ts"), F.col("id").alias("user_id"), F.lit("ü").alias("event_type"), (F.col("id") / 4).alias("value"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("toLocalIterator", "collect", "toPandas", "toArrow", "foreach"):
        monkeypatch.setattr(type(events), name, None)
    found = catalog.remote_write_snappy(spark, str(tmp_path))
    monkeypatch.undo()
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    want = [("ü", str(k), len(range(k, 12_001, 4)), sum(range(k, 12_001, 4)) / 4) for k in range(4)]
    assert sorted(map(tuple, found.collect())) == want
    events.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    assert catalog.remote_write_snappy(spark, f"{tmp_path}/none").collect() == []


def test_snappy_of_tasks(spark):
    own, jvm = TaskSnappy(), Snappy(spark)
    for data in (b"", b"m", b"some" * 50_000, bytes(range(256))):
        assert own.unpack(jvm.pack(data)) == own.unpack(own.pack(data)) == jvm.unpack(own.pack(data)) == data
    packed = own.pack(b"some" * 1000)
    for bad in (b"", b"\xff" * 9, packed[:-3], b"\x05" + packed[2:], b"\xff\xff\xff\xff\x0f" + packed, b"no block"):
        for codec in (own, jvm):
            with pytest.raises(ValueError):
                codec.unpack(bad)


def test_bodies_of_remote_writes():
    samples = [("m", (("a", "ü"),), 5, 1.5), ("m", (("a", "ü"),), -7, math.inf), ("n", (), 9, 0.0)]
    assert ingest.parse_remote_write(ingest.remote_write_body(samples)) == [(m, dict(labels) or None, ts, v) for m, labels, ts, v in samples]
