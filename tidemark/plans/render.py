"""Answers in the wire formats, from collected rows."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Row

from tidemark.sources.model import NAME


def number(value: float) -> str:
    """The shortest decimal text that reads back as the value, without an exponent."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "+Inf" if value > 0 else "-Inf"
    text = repr(float(value))
    if "e" in text:
        digits, _, power = text.partition("e")
        sign, digits = ("-", digits[1:]) if digits.startswith("-") else ("", digits)
        whole, _, part = digits.partition(".")
        at = len(whole) + int(power)
        digits = (whole + part).rstrip("0") or "0"
        text = sign + ("0." + "0" * -at + digits if at <= 0 else digits.ljust(at, "0") if at >= len(digits) else f"{digits[:at]}.{digits[at:]}")
    text = text.removesuffix(".0")
    return text


def _object(row: Row) -> dict[str, str]:
    named = {NAME: row.metric} if row.metric else {}
    return named | dict(row.labels or {})


def _key(row: Row) -> tuple:
    return (row.metric or "", sorted((row.labels or {}).items()))


def vector(rows: Iterable[Row]) -> dict:
    """The answer to an instant query."""
    found = [{"metric": _object(r), "value": [r.ts / 1000, number(r.value)]} for r in sorted(rows, key=_key)]
    return {"status": "success", "data": {"resultType": "vector", "result": found}}


def matrix(rows: Iterable[Row]) -> dict:
    """The answer to a range query: a series once, its points in order."""
    found: list[dict] = []
    last = None
    for r in sorted(rows, key=lambda r: (*_key(r), r.ts)):
        if _key(r) != last:
            last = _key(r)
            found.append({"metric": _object(r), "values": []})
        found[-1]["values"].append([r.ts / 1000, number(r.value)])
    return {"status": "success", "data": {"resultType": "matrix", "result": found}}


def plain_instant(rows: Iterable[Row]) -> list[dict]:
    return [{"metric": r.metric, "labels": dict(r.labels or {}), "timestamp": r.ts, "value": r.value} for r in sorted(rows, key=_key)]


def plain_range(rows: Iterable[Row]) -> list[dict]:
    """Of rows of samples: a series once, its points in order."""
    found: list[dict] = []
    last = None
    for r in sorted(rows, key=lambda r: (*_key(r), r.ts)):
        if _key(r) != last:
            last = _key(r)
            found.append({"metric": r.metric, "labels": dict(r.labels or {}), "values": []})
        found[-1]["values"].append([r.ts, r.value])
    return found


def seconds(text: str | float) -> int:
    """Seconds, maybe with a fraction, as milliseconds; nothing else is taken."""
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text!r} is not a time")
    return int(value * 1000)


def step(text: str | float) -> int:
    """A step in seconds as milliseconds; it must be positive and finite."""
    value = seconds(text)
    if float(text) <= 0:
        raise ValueError("step must be greater than zero")
    return value
