"""Requests by form parameters, answered as JSON-ready objects: a server's handlers without the server.

Plain reads take milliseconds; the query language takes seconds with a fraction. A request that can't be answered is a
BadRequest, whose status is that of HTTP.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.matchers import Matcher
from tidemark.functions.selector import BadSelector, parse_series
from tidemark.operators.anomaly import Settings
from tidemark.plans import render
from tidemark.plans.engine import Config, Engine
from tidemark.plans.settings import ServiceSettings, Upkeep
from tidemark.sources import ingest
from tidemark.sources.snappy import Snappy
from tidemark.sources.store import SampleStore, TooManyBatches, TooManySeries
from tidemark.streaming.registry import Filter, Registry

HOUR = 3600.0
Params = Mapping[str, str | list[str]]


class BadRequest(ValueError):
    def __init__(self, message: str, status: int = 400) -> None:
        super().__init__(message)
        self.status = status


def _one(params: Params, name: str) -> str:
    value = params.get(name, "")
    return (value if isinstance(value, str) else value[0] if value else "").strip()


def _whole(params: Params, name: str) -> int:
    try:
        return int(_one(params, name))
    except ValueError:
        raise BadRequest(f"{name} in milliseconds is required") from None


def _labels(params: Params) -> dict[str, str]:
    return {k[2:]: v if isinstance(v, str) else v[0] for k, v in params.items() if k.startswith("l_") and len(k) > 2}


def _partial(params: Params) -> bool:
    return _one(params, "partial").lower() in ("1", "true", "yes")


def _interval(params: Params) -> tuple[int, int]:
    start, end = _whole(params, "start"), _whole(params, "end")
    if end < start:
        raise BadRequest("end before start")
    return start, end


#: Rows of an answer, at most: an answer is put together on the driver.
MAX_ROWS = 1_000_000


def service(spark: SparkSession, settings: ServiceSettings, clock: Callable[[], float] = time.time) -> Service:
    """A service as settings say. Its ``upkeep.tick(clock())`` is to be called now and then."""
    store = SampleStore(spark, settings.root, settings.max_series, settings.max_batches)
    config = Config(int(settings.lookback * 1000), int(settings.max_window * 1000))
    how = Settings(settings.anomaly_alpha, settings.anomaly_threshold, settings.anomaly_warmup)
    own = Service(spark, store, config, int(settings.retention * 1000), clock, Registry(how, settings.anomaly_max_series) if settings.anomalies else None)
    if settings.retention:
        own.upkeep.add("retention", settings.retention_first, settings.retention_every, own.retain)
    own.upkeep.add("compaction", settings.compact_every, settings.compact_every, store.compact_tiers)
    own.upkeep.add("vacuum", HOUR, HOUR, store.vacuum)
    if own.anomalies is not None and settings.anomaly_stale:
        own.upkeep.add("anomalies", 600.0, 600.0, lambda: own.anomalies.prune(int(clock() * 1000), int(settings.anomaly_stale * 1000)))
    return own


class Service:
    def __init__(self, spark: SparkSession, store: SampleStore, config: Config | None = None, retention: int = 0, clock: Callable[[], float] = time.time, anomalies: Registry | None = None, max_rows: int = MAX_ROWS) -> None:
        self.spark, self.store, self.retention, self.clock, self.anomalies, self.max_rows = spark, store, retention, clock, anomalies, max_rows
        self.engine, self.snappy, self.upkeep = Engine(spark, store, config), Snappy(spark), Upkeep()
        self.accepted, self.rejected, self.reads = 0, Counter(), Counter()
        self.counts: dict[str, int] = {}
        self.routes: dict[tuple[str, str], Callable[[Params, bytes], object]] = {
            ("GET", "/api/v1/query"): self.query,
            ("GET", "/api/v1/query_range"): self.query_range,
            ("GET", "/api/v1/labels"): lambda p, b: self._done([r.name for r in self._rows(self.engine.label_names())]),
            ("GET", "/api/v1/anomalies"): self.anomaly_frames,
            ("GET", "/metrics"): lambda p, b: self.metrics(),
            ("GET", "/api/v1/series"): self.series,
            ("GET", "/api/v1/status"): lambda p, b: self.store.status() | {"requests": dict(self.counts)},
            ("GET", "/healthz"): lambda p, b: {"status": "ok"},
            ("GET", "/livez"): lambda p, b: {"status": "ok"},
            ("GET", "/-/healthy"): lambda p, b: {"status": "ok"},
            ("GET", "/-/ready"): lambda p, b: {"status": "ok"},
            ("POST", "/api/v1/write"): self.write,
            ("POST", "/api/v1/read"): self.read,
            ("POST", "/api/v1/flush"): lambda p, b: {"status": "ok"},
            ("POST", "/api/v1/compact"): lambda p, b: {"status": "ok", "merged": self.store.compact()},
            ("POST", "/api/v1/retention"): lambda p, b: {"status": "ok", "removed": self.retain()},
        }

    def call(self, method: str, path: str, params: Params | None = None, body: bytes = b"", content_type: str = "", encoding: str = "") -> object:
        """The answer to a request; BadRequest if it has none."""
        params = dict(params or {})
        if method == "GET" and path.startswith("/api/v1/label/") and path.endswith("/values"):
            name = unquote(path.removeprefix("/api/v1/label/").removesuffix("/values")).strip()
            if not name:
                raise BadRequest("a label name is required")
            return self._done([r.value for r in self._rows(self.engine.label_values(name))])
        handler = self.routes.get((method, path))
        if handler is None:
            raise BadRequest(f"no route {method} {path}", 404)
        self.counts[path] = self.counts.get(path, 0) + 1
        try:
            return handler(params | {"content-type": content_type, "content-encoding": encoding}, body)
        except BadRequest:
            raise
        except ingest.TooLarge as error:
            self.rejected["too_large"] += 1
            raise BadRequest(str(error), 413) from error
        except TooManySeries as error:
            self.rejected["too_many_series"] += 1
            raise BadRequest(str(error), 429) from error
        except TooManyBatches as error:
            self.rejected["too_many_batches"] += 1
            raise BadRequest(str(error), 503) from error
        except ValueError as error:
            if path == "/api/v1/write":
                self.rejected["bad_write"] += 1
            raise BadRequest(str(error)) from error

    def _rows(self, rows: DataFrame) -> list:
        """The rows of an answer; too many for the driver are an error and not fetched."""
        found = rows.take(self.max_rows + 1)
        if len(found) > self.max_rows:
            raise BadRequest(f"more than {self.max_rows} rows; narrow the request", 422)
        return found

    def retain(self) -> int:
        return self.store.retain(int(self.clock() * 1000), self.retention)

    def metrics(self) -> str:
        """Counters and gauges in the text format of scrapers."""
        held = self.store.status()
        rows = [("samples_accepted_total", "counter", {"": self.accepted})]
        rows.append(("writes_rejected_total", "counter", {f'{{reason="{k}"}}': n for k, n in sorted(self.rejected.items())} or {"": 0}))
        rows.append(("reads_total", "counter", {f'{{kind="{k}"}}': n for k, n in sorted(self.reads.items())} or {"": 0}))
        rows += [(f"store_{k}", "gauge", {"": n}) for k, n in held.items()]
        rows.append(("requests_total", "counter", {f'{{path="{k}"}}': n for k, n in sorted(self.counts.items())} or {"": 0}))
        if self.anomalies is not None:
            rows += [("anomaly_events_total", "counter", {"": self.anomalies.events}), ("anomaly_events_dropped_total", "counter", {"": self.anomalies.dropped}), ("anomaly_detectors", "gauge", {"": len(self.anomalies)})]
        return "".join(f"# TYPE tidemark_{name} {kind}\n" + "".join(f"tidemark_{name}{labels} {n}\n" for labels, n in values.items()) for name, kind, values in rows)

    def anomaly_frames(self, params: Params, body: bytes = b"") -> Iterator[str]:
        """Server-sent events of anomalies from now on, for a server to send as they come."""
        if self.anomalies is None:
            raise BadRequest("anomaly detection is off", 503)
        return self.anomalies.frames(Filter(_one(params, "metric"), _one(params, "min_z") or 0.0, _one(params, "types")))

    def _done(self, data: object) -> dict:
        return {"status": "success", "data": data}

    def query(self, params: Params, body: bytes = b"") -> dict:
        """An instant query of the language, or the samples of a metric at exactly a time."""
        if text := _one(params, "query"):
            at = render.seconds(_one(params, "time")) if _one(params, "time") else int(self.clock() * 1000)
            self.reads["instant"] += 1
            return render.vector(self._rows(self.engine.query(text, at)))
        metric = self._metric(params)
        self.reads["plain"] += 1
        rows = self.engine.at(metric, _labels(params), _whole(params, "t"), _partial(params))
        return self._done({"resultType": "vector", "result": render.plain_instant(self._rows(rows))})

    def query_range(self, params: Params, body: bytes = b"") -> dict:
        """A range query of the language, or the samples of a metric in an interval."""
        if text := _one(params, "query"):
            start, end = render.seconds(_one(params, "start")), render.seconds(_one(params, "end"))
            if end < start:
                raise BadRequest("end before start")
            self.reads["range"] += 1
            return render.matrix(self._rows(self.engine.query_range(text, start, end, render.step(_one(params, "step")))))
        self.reads["plain"] += 1
        rows = self.engine.between(self._metric(params), _labels(params), *_interval(params), _partial(params))
        return self._done({"resultType": "matrix", "result": render.plain_range(self._rows(rows))})

    def _metric(self, params: Params) -> str:
        if not (metric := _one(params, "metric")):
            raise BadRequest("metric is required")
        return metric

    def series(self, params: Params, body: bytes = b"") -> dict:
        """Label objects of series by match[] selectors, or by a metric and labels."""
        start, end = _interval(params)
        given = params.get("match[]", [])
        if given:
            try:
                selectors = [parse_series(x) for x in ([given] if isinstance(given, str) else given) if x.strip()]
            except BadSelector as error:
                raise BadRequest(f"match[]: {error}") from error
            if not selectors:
                raise BadRequest("at least one match[] that isn't empty is required")
            rows = self.engine.series(selectors, start, end)
        else:
            rows = self.engine.series([(self._metric(params), _labels(params))], start, end, _partial(params))
        return self._done([dict(r.labels) for r in self._rows(self.engine.prom_series(rows))])

    def write(self, params: Params, body: bytes) -> dict:
        """Samples of a body, as a whole or not at all."""
        rows = ingest.decode(body, _one(params, "content-type").lower(), _one(params, "content-encoding").lower(), self.snappy.unpack)
        self.store.write(ingest.frame(self.spark, rows))
        self.accepted += len(rows)
        if self.anomalies is not None:
            self.anomalies.observe(rows)
        return {"status": "ok", "accepted": len(rows)}

    def read(self, params: Params, body: bytes) -> bytes:
        """The answer to a remote-read message, a Snappy block as the protocol has it; a plain message is taken too."""
        try:
            body = self.snappy.unpack(body)
        except ValueError:
            if "snappy" in _one(params, "content-encoding").lower():
                raise
        queries = [(start, end, [Matcher(*m) for m in matchers]) for start, end, matchers in ingest.parse_remote_read(body)]
        self.reads["remote"] += 1
        rows = self._rows(self.engine.remote_read(queries))
        found: list[dict] = [{} for _ in queries]
        for r in sorted(rows, key=lambda r: r.ts):
            labels = tuple(sorted(({"__name__": r.metric} | dict(r.labels or {})).items()))
            found[r["query"]].setdefault(labels, []).append((r.ts, r.value))
        return self.snappy.pack(ingest.remote_read_answer([sorted(x.items()) for x in found]))
