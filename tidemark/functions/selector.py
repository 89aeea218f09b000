"""Series selectors ``metric`` or ``metric{label="value", ...}`` of the series listing; equality only."""

from __future__ import annotations

import re

METRIC = re.compile(r"[^\W\d][\w:]*")
LABEL = re.compile(r'\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:[^"\\]|\\[\s\S])*)"\s*')


class BadSelector(ValueError):
    """Not a series selector."""


def parse_series(text: str) -> tuple[str, dict[str, str]]:
    """(metric, labels); the last of equal names holds, a comma may end the list."""
    text = text.strip()
    name, brace, rest = text.partition("{")
    if not METRIC.fullmatch(name.strip() if brace else name):
        raise BadSelector(f"invalid metric name {name.strip()!r}")
    if not brace:
        return name, {}
    if not rest.endswith("}"):
        raise BadSelector("unclosed {")
    inner, at, labels = rest[:-1], 0, {}
    while inner[at:].strip():
        m = LABEL.match(inner, at)
        if not m:
            raise BadSelector(f"expected a label, = and a quoted value at {inner[at:]!r}")
        labels[m[1]] = re.sub(r"\\([\s\S])", r"\1", m[2])
        at = m.end()
        if at < len(inner):
            if inner[at] != ",":
                raise BadSelector(f"expected a comma at {inner[at:]!r}")
            at += 1
    return name.strip(), labels
