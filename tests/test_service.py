import json

import pytest

from tests.test_store_and_ingest import field, series
from tidemark.plans.engine import Config
from tidemark.plans import service as service_module
from tidemark.plans.service import BadRequest, Service
from tidemark.plans.settings import ServiceSettings, Upkeep, load
from tidemark.streaming.registry import Filter, Registry
from tidemark.operators.anomaly import Settings
from tidemark.sources import ingest
from tidemark.sources.snappy import Snappy
from tidemark.sources.store import SampleStore


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    store = SampleStore(spark, f"file://{tmp_path_factory.mktemp('service')}/s", max_series=10)
    own = Service(spark, store, Config(), retention=0, clock=lambda: 12.0)
    body = {"samples": [{"metric": "up", "labels": {"job": "api"}, "ts": 10_000, "value": 1}, {"metric": "up", "labels": {"job": "web"}, "ts": 10_000, "value": 2}]}
    assert own.call("POST", "/api/v1/write", body=json.dumps(body).encode(), content_type="application/json") == {"status": "ok", "accepted": 2}
    own.call("POST", "/api/v1/write", body=series([("__name__", "up"), ("job", "web")], [(10_000, 5.0), (11_000, 6.0)]))
    return own


def test_query_language(service):
    got = service.call("GET", "/api/v1/query", {"query": "sum(up)", "time": "10.0"})
    assert got == {"status": "success", "data": {"resultType": "vector", "result": [{"metric": {}, "value": [10.0, "6"]}]}}
    assert service.call("GET", "/api/v1/query", {"query": 'up{job="web"}'})["data"]["result"] == [{"metric": {"__name__": "up", "job": "web"}, "value": [12.0, "6"]}]
    got = service.call("GET", "/api/v1/query_range", {"query": "up", "start": "10", "end": "11.5", "step": "1"})
    assert [r["values"] for r in got["data"]["result"]] == [[[10.0, "1"], [11.0, "1"]], [[10.0, "5"], [11.0, "6"]]]


def test_plain_reads(service):
    got = service.call("GET", "/api/v1/query", {"metric": "up", "l_job": "web", "t": "11000"})
    assert got["data"] == {"resultType": "vector", "result": [{"metric": "up", "labels": {"job": "web"}, "timestamp": 11_000, "value": 6.0}]}
    assert service.call("GET", "/api/v1/query", {"metric": "up", "t": "10000"})["data"]["result"] == []
    assert len(service.call("GET", "/api/v1/query", {"metric": "up", "t": "10000", "partial": "1"})["data"]["result"]) == 2
    got = service.call("GET", "/api/v1/query_range", {"metric": "up", "start": "0", "end": "20000", "partial": "true"})
    assert [r["values"] for r in got["data"]["result"]] == [[[10_000, 1.0]], [[10_000, 5.0], [11_000, 6.0]]]


def test_listings_and_maintenance(service):
    assert service.call("GET", "/api/v1/labels")["data"] == ["__name__", "job"] and service.call("GET", "/api/v1/label/job/values")["data"] == ["api", "web"]
    got = service.call("GET", "/api/v1/series", {"match[]": ["up", 'up{job="api"}'], "start": "0", "end": "20000"})
    assert sorted(x["job"] for x in got["data"]) == ["api", "web"]
    assert service.call("GET", "/api/v1/series", {"metric": "up", "start": "0", "end": "20000"})["data"] == []
    assert service.call("POST", "/api/v1/retention")["removed"] == 0 and service.call("GET", "/healthz") == {"status": "ok"}
    assert service.call("GET", "/api/v1/status")["batches"] >= 1


def test_remote_read(service):
    matcher = lambda kind, name, value: field(3, 2, field(1, 0, kind) + field(2, 2, name) + field(3, 2, value))
    body = field(1, 2, field(1, 0, 0) + field(2, 0, 20_000) + matcher(0, b"__name__", b"up") + matcher(2, b"job", b"w.*"))
    assert ingest.parse_remote_read(body) == [(0, 20_000, [("__name__", "=", "up"), ("job", "=~", "w.*")])]
    answer = service.call("POST", "/api/v1/read", body=body)
    snappy = Snappy(service.spark)
    (result,) = [v for n, _, v in ingest._fields(snappy.unpack(answer)) if n == 1]
    assert service.call("POST", "/api/v1/read", body=snappy.pack(body), encoding="SNAPPY") == answer
    with pytest.raises(BadRequest):
        service.call("POST", "/api/v1/read", body=body, encoding="snappy")
    assert ingest.parse_remote_write(result) == [("up", {"job": "web"}, 10_000, 5.0), ("up", {"job": "web"}, 11_000, 6.0)]


@pytest.mark.parametrize(
    ("method", "path", "params", "status"),
    [
        ("GET", "/api/v1/query", {}, 400), ("GET", "/api/v1/query", {"metric": "up", "t": "x"}, 400), ("GET", "/api/v1/query", {"query": "("}, 400), ("GET", "/api/v1/query", {"query": "up", "time": "2024-01-01"}, 400),
        ("GET", "/api/v1/query_range", {"query": "up", "start": "1", "end": "0", "step": "1"}, 400), ("GET", "/api/v1/query_range", {"query": "up", "start": "0", "end": "1", "step": "0"}, 400), ("GET", "/api/v1/query_range", {"query": "up", "start": "0", "end": "1", "step": "0.0001"}, 400),
        ("GET", "/api/v1/query_range", {"metric": "up", "start": "0", "end": str(91 * 86_400_000)}, 400), ("GET", "/api/v1/series", {"match[]": [" "], "start": "0", "end": "1"}, 400), ("GET", "/api/v1/series", {"match[]": ["1x"], "start": "0", "end": "1"}, 400),
        ("GET", "/nowhere", {}, 404), ("POST", "/api/v1/write", {}, 400), ("POST", "/api/v1/read", {}, 400),
    ],
)
def test_bad_requests(service, method, path, params, status):
    with pytest.raises(BadRequest) as error:
        service.call(method, path, params)
    assert error.value.status == status


def test_limits(service):
    with pytest.raises(BadRequest) as error:
        service.call("POST", "/api/v1/write", body=b"x" * (ingest.MAX_BODY + 1))
    assert error.value.status == 413
    many = {"samples": [{"metric": "up", "labels": {"job": str(k)}, "ts": 1, "value": 1} for k in range(9)]}
    with pytest.raises(BadRequest) as error:
        service.call("POST", "/api/v1/write", body=json.dumps(many).encode(), content_type="application/json")
    assert error.value.status == 429


def test_snappy_writes(spark, tmp_path):
    own = Service(spark, SampleStore(spark, f"file://{tmp_path}/s"))
    message, snappy = series([("__name__", "m"), ("k", "v" * 500)], [(5, 1.5), (6, 2.5)]), Snappy(spark)
    packed = snappy.pack(message)
    assert len(packed) < len(message) and snappy.unpack(packed) == message
    for k, (body, encoding) in enumerate([(packed, "snappy"), (packed, ""), (packed, "Snappy"), (message, "")]):
        assert own.call("POST", "/api/v1/write", body=body, encoding=encoding, content_type="Application/X-Protobuf") == {"status": "ok", "accepted": 2}, k
    json_body = json.dumps({"samples": [{"metric": "j", "ts": 1, "value": 1}]}).encode()
    assert own.call("POST", "/api/v1/write", body=json_body, content_type="Application/JSON")["accepted"] == 1
    with pytest.raises(BadRequest):
        own.call("POST", "/api/v1/write", body=message, encoding="snappy")
    text = own.call("GET", "/metrics")
    assert "tidemark_samples_accepted_total 9\n" in text and 'tidemark_writes_rejected_total{reason="bad_write"} 1' in text and "tidemark_store_series 2\n" in text and "tidemark_store_batches 5" in text


def test_anomalies_are_served_and_dropped_when_full(spark, tmp_path):
    own = Service(spark, SampleStore(spark, f"file://{tmp_path}/s", max_batches=1), anomalies=Registry())
    frames = own.call("GET", "/api/v1/anomalies", {"metric": "cpu*", "types": "spike"})
    assert next(frames) == ": connected\n\n"
    values = [10 + (k % 3 - 1) * 0.1 for k in range(50)] + [100.0]
    own.call("POST", "/api/v1/write", body=series([("__name__", "mem")], list(enumerate(values))) + series([("__name__", "cpu"), ("a", "1")], list(enumerate(values))))
    event = json.loads(next(frames).removeprefix("data: "))
    assert (event["metric"], event["labels"], event["ts"], event["type"]) == ("cpu", {"a": "1"}, 50, "spike")
    frames.close()
    assert not own.anomalies._subscribers and own.anomalies.events == 2
    with pytest.raises(BadRequest) as error:
        own.call("POST", "/api/v1/write", body=series([("__name__", "mem")], [(1, 1.0)]))
    assert error.value.status == 503
    for params in ({"types": "jump"}, {"min_z": "x"}):
        with pytest.raises(BadRequest):
            own.call("GET", "/api/v1/anomalies", params)
    idle = Registry().frames(ping=0.01)
    assert [next(idle), next(idle)] == [": connected\n\n", ": ping\n\n"]


def test_registry_bounds():
    registry = Registry(Settings(threshold=1.0, warmup=1), max_series=2)
    q = registry.subscribe()
    for k in range(250):
        registry.observe([("m", None, k, float(k % 2) * 1.5**k)])
    assert q.qsize() == 64 and registry.dropped == registry.events - 64 > 0
    registry.observe([("a", None, 5, 1.0), ("b", None, 6, 1.0)])  # m was used last before them, so it goes
    assert len(registry) == 2 and registry.observe([("m", None, 7, 1e9)]) == [] and len(registry) == 2
    assert registry.prune(now=107, age=100) == 1 and len(registry) == 1
    assert Filter("c?u/[ab]", 2).holds({"metric": "cpu/a", "z_score": 2.0, "type": "drop"}) and not Filter("c*").holds({"metric": "c/a", "z_score": 9, "type": "drop"})
    assert Filter("c[^a]").holds({"metric": "cb", "z_score": 1, "type": "drop"}) and not any(Filter("c[^a]").holds({"metric": m, "z_score": 1, "type": "drop"}) for m in ("ca", "c/"))


def test_settings_and_upkeep(spark, tmp_path):
    env = {"TIDEMARK_MAX_SERIES": "7", "TIDEMARK_RETENTION": "60", "TIDEMARK_ANOMALIES": "false", "OTHER": "x"}
    assert load(["--max-series=9", "--root", "r"], env) == ServiceSettings(root="r", max_series=9, retention=60.0, anomalies=False)
    assert load([], {}) == ServiceSettings()
    for flags, environ in ((["--max-series=x"], {}), (["--nothing=1"], {}), ([], {"TIDEMARK_ANOMALIES": "maybe"}), (["--anomaly-alpha=2"], {}), (["--retention=-1"], {}), (["--root="], {})):
        with pytest.raises(ValueError):
            load(flags, environ)
    own = service_module.service(spark, ServiceSettings(root=f"file://{tmp_path}/s", retention=3600.0), clock=lambda: 10.0**6)
    own.call("POST", "/api/v1/write", body=series([("__name__", "m")], [(0, 1.0), (10**9 - 1000, 2.0)]))
    assert own.upkeep.tick(0.0) == {} and own.upkeep.tick(9.0) == {} and own.upkeep.tick(10.0) == {"retention": 1} and own.upkeep.tick(11.0) == {}
    assert own.call("GET", "/api/v1/status")["points"] == 1
    failing = Upkeep()
    failing.add("bad", 0, 1, lambda: 1 / 0)
    failing.add("good", 0, 1, lambda: 5)
    done = failing.tick(1.0)
    assert isinstance(done["bad"], ZeroDivisionError) and done["good"] == 5


def test_answers_are_bounded(service):
    small = Service(service.spark, service.store, max_rows=1)
    for path, params in (("/api/v1/labels", {}), ("/api/v1/series", {"match[]": "up", "start": "0", "end": "20000"}), ("/api/v1/query_range", {"metric": "up", "start": "0", "end": "20000", "partial": "1"})):
        with pytest.raises(BadRequest) as error:
            small.call("GET", path, params)
        assert error.value.status == 422
