"""Settings of a service: flags over environment over defaults, and the upkeep that they schedule."""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields

PREFIX = "TIDEMARK_"
HOUR = 3600.0


@dataclass(frozen=True)
class ServiceSettings:
    """Times in seconds; 0 turns a cap, retention or pruning off."""

    root: str = "tidemark-store"
    max_series: int = 100_000
    max_batches: int = 0
    max_window: float = 90 * 24 * HOUR
    lookback: float = 300.0
    retention: float = 0.0
    retention_every: float = HOUR
    retention_first: float = 10.0
    compact_every: float = 0.0
    anomalies: bool = True
    anomaly_alpha: float = 0.3
    anomaly_threshold: float = 3.0
    anomaly_warmup: int = 10
    anomaly_max_series: int = 1_000_000
    anomaly_stale: float = 6 * HOUR

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, (int, float)) and value < 0:
                raise ValueError(f"{f.name} can't be negative")
        if not self.root:
            raise ValueError("root is required")
        if not 0 < self.anomaly_alpha <= 1:
            raise ValueError("anomaly_alpha is in (0, 1]")
        if self.retention and not self.retention_every:
            raise ValueError("retention needs retention_every")


def _value(kind: type, text: str, name: str):
    if kind is bool:
        if text.lower() not in ("1", "0", "true", "false", "yes", "no"):
            raise ValueError(f"{name}: {text!r} is neither true nor false")
        return text.lower() in ("1", "true", "yes")
    try:
        return kind(text)
    except ValueError:
        raise ValueError(f"{name}: {text!r} is not {kind.__name__}") from None


def load(flags: Sequence[str] = (), environ: Mapping[str, str] | None = None) -> ServiceSettings:
    """Settings from flags like --max-series=5, else from TIDEMARK_MAX_SERIES, else the defaults."""
    environ = os.environ if environ is None else environ
    parser = argparse.ArgumentParser(exit_on_error=False, add_help=False)
    for f in fields(ServiceSettings):
        parser.add_argument("--" + f.name.replace("_", "-"), dest=f.name)
    try:
        given, unknown = parser.parse_known_args(list(flags))
    except argparse.ArgumentError as error:
        raise ValueError(str(error)) from error
    if unknown:
        raise ValueError(f"unknown flag {unknown[0]}")
    found = {}
    for f in fields(ServiceSettings):
        text = getattr(given, f.name)
        text = environ.get(PREFIX + f.name.upper()) if text is None else text
        if text is not None:
            found[f.name] = _value(type(f.default), text, f.name)
    return ServiceSettings(**found)


@dataclass
class Upkeep:
    """Tasks that run every so many seconds, the first time after first; ``tick`` runs those that are due."""

    tasks: dict[str, tuple[float, float, Callable[[], object]]] = field(default_factory=dict)
    due: dict[str, float] = field(default_factory=dict)

    def add(self, name: str, first: float, every: float, task: Callable[[], object]) -> None:
        if every > 0:
            self.tasks[name] = (first, every, task)

    def tick(self, now: float) -> dict[str, object]:
        """What each due task returned or, if it failed, its exception: one failure doesn't keep the others from running."""
        done = {}
        for name, (first, every, task) in self.tasks.items():
            at = self.due.setdefault(name, now + first)
            if now >= at:
                try:
                    done[name] = task()
                except Exception as error:  # told to the caller
                    done[name] = error
                self.due[name] = now + every
        return done
