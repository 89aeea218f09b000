"""Anomalies of samples as a service takes them in: detectors of bounded number, and subscribers of their events.

This is the form for one process that answers writes; a stream of any size is ``anomalies.detect_stream``. Samples are
folded in the order in which they arrive. At most ``max_series`` detectors are kept, the least recently used one goes
first and its series starts anew; ``prune`` drops those whose last sample is too old by its own time.
"""

from __future__ import annotations

import json
import queue
import re
import threading
from collections import OrderedDict
from collections.abc import Iterable, Iterator

from tidemark.functions.regex import glob_to_java
from tidemark.operators.anomaly import KINDS, START, Settings, State, step

#: Events that wait for a subscriber; when there are more, new ones are dropped for that one.
BUFFER = 64
#: Seconds without an event after which a subscriber's connection is kept alive by a comment.
PING = 15.0
Sample = tuple[str, dict[str, str] | None, int, float]


class Filter:
    """Events of metrics that fit a glob, of a score at least, of the listed types; see operators.anomaly.filtered."""

    def __init__(self, metric: str = "", min_z: str | float = 0.0, types: str = "") -> None:
        pattern = glob_to_java(metric) if metric else ".*"
        # Java says "and no slash" by an intersection and the end of the text by another letter
        self.metric = re.compile(pattern.replace("&&[^/]]", "/]").replace(r"\z", r"\Z"), re.DOTALL) if pattern else None
        self.min_z = float(min_z or 0)
        self.types = {t for t in (x.strip() for x in types.split(",")) if t}
        for t in self.types - set(KINDS):
            raise ValueError(f"{t!r} is not one of {', '.join(KINDS)}")

    def holds(self, event: dict) -> bool:
        return bool(self.metric and self.metric.match(event["metric"])) and event["z_score"] >= self.min_z and (not self.types or event["type"] in self.types)


class Registry:
    def __init__(self, how: Settings | None = None, max_series: int = 1_000_000) -> None:
        self.how, self.max_series = how or Settings(), max_series
        self._states: OrderedDict[tuple, tuple[State, int]] = OrderedDict()
        self._subscribers: list[queue.Queue] = []
        self._lock = threading.Lock()
        self.events = self.dropped = 0

    def __len__(self) -> int:
        return len(self._states)

    def observe(self, samples: Iterable[Sample]) -> list[dict]:
        """Folds samples in order and gives the events to subscribers and back."""
        found = []
        with self._lock:
            for metric, labels, ts, value in samples:
                key = (metric, tuple(sorted((labels or {}).items())))
                state, _ = self._states.pop(key, (START, ts))
                state, event = step(state, value, self.how)
                self._states[key] = (state, ts)
                if len(self._states) > self.max_series > 0:
                    self._states.popitem(last=False)
                if event:
                    expected, score, kind = event
                    found.append({"metric": metric, "labels": dict(labels or {}), "ts": ts, "value": value, "expected": expected, "z_score": score, "type": kind})
            for event in found:
                self.events += 1
                for q in self._subscribers:
                    try:
                        q.put_nowait(event)
                    except queue.Full:
                        self.dropped += 1
        return found

    def prune(self, now: int, age: int) -> int:
        """Drops detectors whose last sample is before now - age (milliseconds); returns how many went."""
        with self._lock:
            old = [k for k, (_, ts) in self._states.items() if ts < now - age]
            for k in old:
                del self._states[k]
        return len(old)

    def subscribe(self) -> queue.Queue:
        q: queue.Queue = queue.Queue(BUFFER)
        with self._lock:
            self._subscribers.append(q)
        return q

    def unsubscribe(self, q: queue.Queue) -> None:
        with self._lock:
            self._subscribers.remove(q)

    def frames(self, wanted: Filter | None = None, ping: float = PING) -> Iterator[str]:
        """Server-sent events until the caller closes the iterator: a comment first, then data, a comment when idle."""
        q = self.subscribe()

        def run() -> Iterator[str]:
            try:
                yield ": connected\n\n"
                while True:
                    try:
                        event = q.get(timeout=ping)
                    except queue.Empty:
                        yield ": ping\n\n"
                        continue
                    if wanted is None or wanted.holds(event):
                        yield f"data: {json.dumps(event)}\n\n"
            finally:
                self.unsubscribe(q)

        return run()
