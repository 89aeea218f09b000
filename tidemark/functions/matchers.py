"""Label matchers as predicates. The query language and remote read treat missing labels differently."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.regex import BadPattern, to_java
from tidemark.sources.model import NAME, Labelled

EQ, NEQ, RE, NRE = "=", "!=", "=~", "!~"


@dataclass(frozen=True)
class Matcher:
    name: str
    op: str
    value: str


@dataclass(frozen=True)
class Plan:
    """A metric and a predicate on labels; impossible if nothing can match."""

    metric: str
    where: Callable[[Labelled], Column] | None
    impossible: bool = False


def all_of(predicates: list[Callable[[Labelled], Column]]) -> Callable[[Labelled], Column] | None:
    if not predicates:
        return None

    def where(samples: Labelled) -> Column:
        held = predicates[0](samples)
        for p in predicates[1:]:
            held = held & p(samples)
        return held

    return where


def equals(name: str, value: str) -> Callable[[Labelled], Column]:
    """The label is there with that value; an empty value doesn't stand for a missing label."""
    return lambda s: s.label(name) == value


def query_matcher(m: Matcher) -> Callable[[Labelled], Column]:
    """A matcher other than equality; a missing label counts as empty, and a bad pattern matches nothing either way."""

    def where(samples: Labelled) -> Column:
        value = F.coalesce(samples.label(m.name), F.lit(""))
        if m.op == NEQ:
            return value != m.value
        try:
            found = value.rlike(to_java(m.value))
        except BadPattern:
            return F.lit(False)
        return found if m.op == RE else ~found

    return where


def query_plan(metric: str, matchers: tuple[Matcher, ...]) -> Plan:
    """Equalities must be present labels, the last of a name holding; the others are tested after them.

    Without a metric nothing matches. ``__name__`` equality compares the metric; other operators on it see the label
    of that name, which samples seldom have.
    """
    equal = {m.name: m.value for m in matchers if m.op == EQ}
    impossible = not metric or equal.get(NAME, metric) != metric
    predicates = [equals(k, v) for k, v in equal.items() if k != NAME]
    return Plan(metric, all_of(predicates + [query_matcher(m) for m in matchers if m.op != EQ]), impossible)


def label_filter(labels: dict[str, str], partial: bool) -> Callable[[Labelled], Column] | None:
    """Samples with these labels, and no others unless ``partial``."""

    def exactly(samples: Labelled) -> Column:
        if samples.names is None:
            return F.size(samples.labels()) == len(labels)
        held = F.lit(True)
        for n in samples.names:
            if n not in labels:
                held = held & samples.label(n).isNull()
        return held

    return all_of([equals(k, v) for k, v in labels.items()] + ([] if partial else [exactly]))


class RemoteReadError(ValueError):
    """A remote-read query that can't be planned."""


def remote_plan(matchers: list[Matcher]) -> Plan:
    """The plan of a remote-read query: an equality on ``__name__`` is required, bad patterns are errors.

    A missing label differs from every value and matches no pattern.
    """
    if not matchers:
        raise RemoteReadError("at least one label matcher is required")
    metric, equal, predicates = "", {}, []
    for m in matchers:
        if not m.name:
            raise RemoteReadError("empty matcher name")
        if m.name == NAME:
            if m.op != EQ:
                raise RemoteReadError("__name__ must use an equality matcher")
            metric = m.value
        elif m.op == EQ:
            if equal.setdefault(m.name, m.value) != m.value:
                raise RemoteReadError(f"conflicting equality matchers for label {m.name!r}")
        elif m.op == NEQ:
            predicates.append(lambda s, m=m: s.label(m.name).isNull() | (s.label(m.name) != m.value))
        elif m.op in (RE, NRE):
            try:
                pattern = to_java(m.value)
            except BadPattern as error:
                raise RemoteReadError(f"bad pattern for label {m.name!r}: {error}") from error
            if m.op == RE:
                predicates.append(lambda s, m=m, p=pattern: F.coalesce(s.label(m.name).rlike(p), F.lit(False)))
            else:
                predicates.append(lambda s, m=m, p=pattern: s.label(m.name).isNull() | ~s.label(m.name).rlike(p))
        else:
            raise RemoteReadError(f"unknown matcher type {m.op!r}")
    if not metric.strip():
        raise RemoteReadError('a __name__ = "..." matcher is required')
    return Plan(metric, all_of([equals(k, v) for k, v in equal.items()] + predicates))
