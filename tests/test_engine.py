"""Query semantics against hand-computed values and an interpreter written from the description of the language."""

import math
import random
import re

import pytest

from tidemark.functions.matchers import Matcher, RemoteReadError, query_plan, remote_plan
from tidemark.functions.ranges import NAMES
from tidemark.functions.selector import BadSelector, parse_series
from tidemark.operators.grid import Grid
from tidemark.plans.engine import Config, Engine, WindowTooLong
from tidemark.plans.promql import Aggregate, Call, Number, parse
from tidemark.sources.adapters import FrameSource
from tidemark.sources.model import SCHEMA, STORED

NAN, INF = float("nan"), float("inf")


def frame(spark, series):
    return spark.createDataFrame([(m, l, t, float(v)) for m, l, points in series for t, v in points], SCHEMA)


def engine(spark, series, **config):
    return Engine(spark, FrameSource(frame(spark, series)), Config(**config))


def values(rows):
    return sorted((tuple(sorted(r.labels.items())), r.ts, r.value) for r in rows.collect())


def one(rows):
    (r,) = rows.collect()
    return r.value


# Fixed values of a known example: a counter by status and a gauge.
SMOKE = [
    ("req_total", {"job": "api", "status": "200"}, [(0, 0), (60_000, 60), (120_000, 120)]),
    ("req_total", {"job": "api", "status": "500"}, [(0, 0), (60_000, 12), (120_000, 24)]),
    ("latency", {"job": "api"}, [(0, 10), (60_000, 20), (120_000, 30)]),
]


@pytest.mark.parametrize(
    ("text", "rows", "first"),
    [('req_total{job="api"}', 2, 120), ("rate(req_total[1m])", 2, 1), ("irate(req_total[1m])", 2, 1), ("increase(req_total[1m])", 2, 60), ("avg_over_time(latency[2m])", 1, 20), ('sum by (job) (req_total{job="api"})', 1, 144), ('count by (job) (req_total{job="api"})', 1, 2)],
)
def test_smoke_table(spark, text, rows, first):
    found = values(engine(spark, SMOKE).query(text, 120_000))
    assert len(found) == rows and found[0][2] == pytest.approx(first)


def test_pinned_numbers(spark):
    counter = [("req", {}, [(0, 0), (15_000, 5), (30_000, 10), (45_000, 15), (60_000, 20)])]
    assert one(engine(spark, counter).query("rate(req[60s])", 60_000)) == pytest.approx(20 / 60)
    reset = [("c", None, [(0, 10), (15_000, 20), (30_000, 5), (45_000, 15)])]
    assert one(engine(spark, reset).query("rate(c[60s])", 45_000)) == pytest.approx(25 / 60)
    assert one(engine(spark, reset).query("irate(c[60s])", 30_000)) == pytest.approx(5 / 15)
    assert one(engine(spark, [("x", {}, [(0, 1), (15_000, 3), (30_000, 5)])]).query("avg_over_time(x[1m])", 60_000)) == 3
    grouped = [("req", {"status": "200", "k": "a"}, [(0, 10), (60_000, 20)]), ("req", {"status": "500"}, [(0, 1), (60_000, 3)]), ("req", {"status": "200", "k": "b"}, [(0, 100), (60_000, 200)])]
    assert [x[2] for x in values(engine(spark, grouped).query("sum by (status) (req)", 60_000))] == [220, 3]
    ramp = [("x", {}, [(0, 0), (30_000, 30), (60_000, 60), (90_000, 90)])]
    assert [x[2] for x in values(engine(spark, ramp).query_range("x", 0, 90_000, 30_000))] == [0, 30, 60, 90]


def test_lookback_and_closed_edges(spark):
    e = engine(spark, [("x", {}, [(1000, 7)])])
    at = lambda t, q="x": [r.value for r in e.query(q, t).collect()]
    assert at(999) == [] and at(1000) == [7] and at(301_000) == [7] and at(301_001) == []
    assert at(601_000, "x[10m]") == [7] and at(601_001, "x[10m]") == []
    assert at(61_000, "count_over_time(x[1m])") == [1] and at(61_001, "count_over_time(x[1m])") == [] and at(61_000, "rate(x[1m])") == []


def test_special_numbers(spark):
    e = engine(spark, [("x", {"k": "a"}, [(0, NAN), (10, NAN)]), ("x", {"k": "b"}, [(0, 5), (10, NAN)]), ("x", {"k": "c"}, [(0, INF), (10, 1)])])
    last = {r.labels["k"]: r.value for r in e.query("min_over_time(x[1m])", 10).collect()}
    assert last == {"a": INF, "b": 5, "c": 1}
    last = {r.labels["k"]: r.value for r in e.query("max_over_time(x[1m])", 10).collect()}
    assert last == {"a": -INF, "b": 5, "c": INF}
    assert one(e.query("min(x)", 10)) == 1 and one(e.query("count(x)", 10)) == 3 and math.isnan(one(e.query("sum(x)", 10)))
    assert one(e.query('max(x{k="a"})', 10)) == -INF


def test_missing_and_empty_labels(spark):
    e = engine(spark, [("x", {"j": "a"}, [(0, 1)]), ("x", {"j": ""}, [(0, 2)]), ("x", None, [(0, 4)]), ("x", {"k": "z"}, [(0, 8)]), ("y", {"j": "a"}, [(0, 16)])])
    total = lambda q: sum(r.value for r in e.query(q, 0).collect())
    assert [total(q) for q in ('x{j=""}', 'x{j!=""}', 'x{j!="a"}', 'x{j=~".*"}', 'x{j!~"a|b"}', 'x{j=~"("}', 'x{j!~"("}', 'x{j="b",j="a"}', 'x{j=~"^a$"}')] == [2, 1, 14, 15, 14, 0, 0, 1, 1]
    assert [total(q) for q in ('x{__name__="x"}', 'x{__name__="y"}', '{__name__="x"}', 'x{__name__=~"x"}', 'x{__name__!="q"}', 'x{__name__=~""}')] == [15, 0, 0, 0, 15, 15]
    got = values(e.query("sum by (j) (x)", 0))
    assert got == [((), 0, 12), ((("j", ""),), 0, 2), ((("j", "a"),), 0, 1)]
    assert values(e.query("sum by () (x)", 0)) == values(e.query("sum(x)", 0)) == [((), 0, 15)] and e.query("sum(none)", 0).count() == 0


def test_names_kept_and_dropped(spark):
    e = engine(spark, SMOKE)
    assert {r.metric for r in e.query("rate(req_total[2m])", 120_000).collect()} == {"req_total"}
    assert {r.metric for r in e.query("sum(req_total)", 120_000).collect()} == {None}
    assert [(r.metric, r.labels, r.value) for r in e.query_range("-2", 0, 10, 5).collect()] == [(None, {}, -2.0)] * 3


def test_upserts_and_identity(spark):
    rows = [("up", {"a": "1", "b": "2"}, 10, 1.0, 1), ("up", {"b": "2", "a": "1"}, 10, 2.0, 2), ("up", None, 10, 5.0, 3), ("up", {}, 10, 6.0, 4)]
    e = Engine(spark, FrameSource(spark.createDataFrame(rows, STORED)))
    assert one(e.query("sum(up)", 10)) == 8 and one(e.query("count(up)", 10)) == 2


def test_limits_and_errors(spark):
    e = engine(spark, SMOKE, max_window=1000)
    for call in (lambda: e.query_range("up", 0, 1001, 10), lambda: e.query("x[2s]", 0), lambda: e.between("m", {}, 0, 1001), lambda: e.remote_read([(0, 1001, [Matcher("__name__", "=", "m")])])):
        with pytest.raises(WindowTooLong):
            call()
    for bad in ((0, 10, 0), (0, 10, -1), (10, 0, 1)):
        with pytest.raises(ValueError):
            Grid(*bad)
    engine(spark, SMOKE, max_window=0).query_range("latency", 0, 10**12, 10**11).count()
    assert e.between("", {}, 0, 10).count() == 0 and e.between("latency", {"job": "api"}, 5, 0).count() == 0


# An interpreter of its own for random comparison.


def samples_of(series, metric, matchers, lo, hi):
    for m, labels, points in series:
        labels = labels or {}
        if m != metric or not metric:
            continue
        held = True
        for x in matchers:
            value = labels.get(x.name)
            if x.op == "=":
                held &= value == x.value
            elif x.op == "!=":
                held &= (value or "") != x.value
            else:
                held &= bool(re.fullmatch(x.value, value or "")) == (x.op == "=~")
        if held:
            yield labels, sorted((t, v) for t, v in dict(points).items() if lo <= t <= hi)


def interpret(series, expr, t, lookback=300_000):
    if isinstance(expr, Number):
        return [({}, expr.value)]
    if isinstance(expr, Aggregate):
        groups = {}
        for labels, value in interpret(series, expr.inner, t):
            groups.setdefault(tuple((n, labels[n]) for n in expr.by if n in labels), []).append(value)
        f = {"sum": math.fsum, "count": len, "avg": lambda v: math.fsum(v) / len(v), "min": min, "max": max}[expr.op]
        return [(dict(k), float(f(v))) for k, v in groups.items()]
    if isinstance(expr, Call):
        out, w = [], expr.argument.width
        for labels, p in samples_of(series, expr.argument.metric, expr.argument.matchers, t - w, t):
            v = [x[1] for x in p]
            if not v:
                continue
            ups = [b - a if b >= a else b for a, b in zip(v, v[1:])]
            mean = math.fsum(v) / len(v)
            if expr.name in ("rate", "increase", "irate") and len(v) < 2:
                continue
            f = {
                "rate": lambda: math.fsum(ups) / (w / 1000), "increase": lambda: math.fsum(ups), "irate": lambda: ups[-1] / ((p[-1][0] - p[-2][0]) / 1000),
                "avg_over_time": lambda: mean, "sum_over_time": lambda: math.fsum(v), "count_over_time": lambda: len(v), "min_over_time": lambda: min(v), "max_over_time": lambda: max(v),
                "stddev_over_time": lambda: math.sqrt(math.fsum((x - mean) ** 2 for x in v) / len(v)),
            }[expr.name]
            out.append((labels, float(f())))
        return out
    w = expr.width or lookback
    return [(labels, p[-1][1]) for labels, p in samples_of(series, expr.metric, expr.matchers, t - w, t) if p]


def random_query(rng, depth=0):
    kind = rng.random()
    if kind < 0.35 and depth < 2:
        op, by = rng.choice(["sum", "count", "avg", "min", "max"]), rng.choice(["", " by (a)", " by (b, a)", " by (zz)"])
        return f"{op}{by} ({random_query(rng, depth + 1)})"
    matchers = rng.sample(['a="1"', 'a!="1"', 'b=~"x|y"', 'b!~"x"', 'a=~".*"', 'b!=""'], rng.randint(0, 2))
    selector = rng.choice(["m", "n"]) + ("{" + ",".join(matchers) + "}" if matchers else "")
    width = f"[{rng.choice([7, 10, 20, 35, 100, 300])}s]"
    if kind < 0.85:
        return f"{rng.choice(NAMES)}({selector}{width})"
    return selector + rng.choice(["", width])


@pytest.mark.parametrize("bucket", [None, 25_000])
def test_random_queries_equal_the_interpreter(spark, bucket):
    rng = random.Random(11)
    series = []
    for metric in "mn":
        for a in (None, "1", "2"):
            for b in (None, "x", "y", ""):
                labels = {k: v for k, v in (("a", a), ("b", b)) if v is not None}
                if rng.random() < 0.8:
                    times = rng.sample(range(0, 400_000, 1000), rng.randint(1, 60)) + ([10_000 * k for k in range(5)] if rng.random() < 0.5 else [])
                    series.append((metric, labels or None, [(t, rng.randint(0, 50) / 2) for t in set(times)]))
    own = frame(spark, series).cache()
    e = Engine(spark, FrameSource(own), Config(bucket=bucket))
    queries = [random_query(rng) for _ in range(36 if bucket is None else 12)] + ["sum_over_time(m[300s])", "min_over_time(n[350s])", "count_over_time(m[330s])"]
    for text in queries:
        start, step = rng.choice([0, 3000, 100_000]), rng.choice([1000, 5000, 13_000, 10_000])
        grid = Grid(start, start + rng.randint(0, 120) * 1000, step)
        expr = parse(text)
        want = sorted((tuple(sorted(labels.items())), t, round(v, 6)) for t in range(grid.start, grid.end + 1, grid.step) for labels, v in interpret(series, expr, t))
        got = sorted((k, t, round(v, 6)) for k, t, v in values(e.query_range(text, grid.start, grid.end, grid.step)))
        assert [x[:2] for x in got] == [x[:2] for x in want], text
        assert all(abs(x[2] - y[2]) < 1e-5 for x, y in zip(got, want, strict=True)), text


def test_plain_reads_and_listings(spark):
    e = engine(spark, [("m", {"env": "a", "k": "1"}, [(1, 1)]), ("m", {"env": "b", "k": "2"}, [(2, 2), (3, 10)]), ("n", {"q": ""}, [(5, 1)])])
    assert e.at("m", {"env": "b", "k": "2"}, 3).count() == 1 and e.at("m", {"env": "b"}, 3).count() == 0 and e.at("m", {"env": "b"}, 3, partial=True).count() == 1
    (r,) = e.by_series(e.between("m", {"env": "b"}, 0, 10, partial=True)).collect()
    assert [(p.ts, p.value) for p in r.points] == [(2, 2.0), (3, 10.0)] and r.labels == {"env": "b", "k": "2"}
    assert [r.name for r in e.label_names().collect()] == ["__name__", "env", "k", "q"]
    assert [r.value for r in e.label_values("env").collect()] == ["a", "b"] and e.label_values("q").count() == 0
    assert [r.value for r in e.label_values("__name__").collect()] == ["m", "n"]
    found = e.series([("m", {"env": "a"}), ("m", {}), ("n", {})], 2, 9)
    assert sorted((r.metric, tuple(sorted(r.labels.items()))) for r in found.collect()) == [("m", (("env", "b"), ("k", "2"))), ("n", (("q", ""),))]
    assert e.prom_series(found).where("labels['__name__'] = metric").count() == 2


def test_series_selectors():
    assert parse_series(' m{a="1", b="x\\"y",}') == ("m", {"a": "1", "b": 'x"y'}) and parse_series("größe") == ("größe", {}) and parse_series("m{}") == ("m", {})
    assert parse_series('m{a="1",a="2"}') == ("m", {"a": "2"})
    for bad in ("", "1m", "{a=\"1\"}", "m{a=\"1\"", "m{a=1}", 'm{a!="1"}', 'm{a="1" b="2"}', 'm{a="x}'):
        with pytest.raises(BadSelector):
            parse_series(bad)


def test_remote_read_rules(spark):
    e = engine(spark, [("m", {"j": "api-v1"}, [(100, 1)]), ("m", {"j": "web"}, [(100, 2)]), ("m", None, [(100, 4)])])
    name = Matcher("__name__", "=", "m")
    total = lambda *m: sum(r.value for r in e.remote_read([(0, 200, [name, *m])]).collect())
    assert [total(Matcher("j", *x)) for x in (("!=", "web"), ("!=", ""), ("=~", "api.*"), ("=~", ".*"), ("!~", "api.*"), ("=", "web"))] == [5, 7, 1, 3, 6, 2]
    for bad in ([], [Matcher("j", "=", "a")], [Matcher("__name__", "=~", "m")], [name, Matcher("j", "=", "a"), Matcher("j", "=", "b")], [name, Matcher("j", "=~", "(")], [name, Matcher("j", "!~", "(?=x)")], [name, Matcher("", "=", "a")], [name, Matcher("j", "?", "")], [Matcher("__name__", "=", " ")]):
        with pytest.raises(RemoteReadError):
            remote_plan(bad)
    with pytest.raises(ValueError):
        e.remote_read([(2, 1, [name])])
    assert query_plan("m", (Matcher("__name__", "=", "n"),)).impossible


def test_plans_push_down_and_keep_to_the_jvm(spark):
    from tidemark.plans.catalog import AT, DAY
    from tidemark.plans.catalog import engine as events

    text = events(spark, "/root/testdata/sf0.001").query("sum by (shard) (rate(click[1d]))", AT + DAY)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), IsNotNull(ts), EqualTo(event_type,click), GreaterThanOrEqual(ts" in text.replace("IsNotNull(ts), IsNotNull(event_type)", "IsNotNull(event_type), IsNotNull(ts)")
    assert "props" not in text.split("ReadSchema")[1] and "Python" not in text and "NestedLoop" not in text


def test_sorting_queries_shuffle_samples_once(spark):
    from tidemark.plans.catalog import AT, DAY, STEP
    from tidemark.plans.catalog import engine as events

    e = events(spark, "/root/testdata/sf0.001")
    # samples once, by series and bucket; the others are of partial results, combined before
    for text, exchanges in (("click[1d]", 1), ("rate(click[1d])", 2), ("irate(click[1d])", 1), ("sum by (shard) (rate(click[1d]))", 3), ("sum_over_time(click[1d])", 2)):
        plan = e.query_range(text, AT, AT + DAY, STEP)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == exchanges and plan.count("REPARTITION_BY_COL") == (text[:3] != "sum" or "rate" in text), (text, plan)


def test_one_hot_series_is_the_work_of_many_tasks(spark):
    from tidemark.operators.grid import bucket_of, in_buckets

    rows = spark.range(200_000).selectExpr("'x' AS metric", "map() AS labels", "id * 1000 AS ts", "CAST(id AS DOUBLE) AS value")
    grid = Grid(0, 200_000_000, 300_000)
    dealt = in_buckets(FrameSource(rows).scan(), bucket_of(grid, 300_000), 300_000, 300_000)
    assert dealt.select("_b").distinct().count() > 80 and dealt.count() < 1.3 * 200_000
    rate = Engine(spark, FrameSource(rows), Config()).query_range("rate(x[5m])", grid.start, grid.end, grid.step)
    assert rate.where("ts > 0 AND abs(value - 1) > 1e-9").count() == 0 and rate.count() == 667 - 1


def test_long_windows_make_rows_with_samples_and_points(spark):
    rows = spark.range(20_000).selectExpr("'x' AS metric", "map() AS labels", "id * 1000 AS ts", "CAST(id % 7 AS DOUBLE) AS value")
    e = Engine(spark, FrameSource(rows), Config())
    for text in ("sum_over_time(x[1h])", "rate(x[1h])", "stddev_over_time(x[1h])"):
        found = e.query_range(text, 0, 20_000_000, 10_000)
        assert found.count() >= 2000
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "sequence" in plan  # blanks of blocks, not points of samples
        nodes = e.query_range(text, 0, 20_000_000, 10_000)
        nodes.write.format("noop").mode("overwrite").save()
        made = _rows_of(nodes, "Generate")
        assert max(made) <= 20_000 * 1.3 + 4 * 2001, (text, made)


def _rows_of(df, name):
    """Output rows of the operators of a name in a query that ran, by its metrics."""
    found, stack = [], [df._jdf.queryExecution().executedPlan()]
    df._jdf.queryExecution().executedPlan().executeCollect()
    while stack:
        node = stack.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            stack.append(node.plan())
            continue
        if node.nodeName().startswith(name):
            metric = node.metrics().get("numOutputRows")
            found.append(metric.get().value())
        children = node.children()
        stack += [children.apply(k) for k in range(children.size())]
    return found or [0]


def test_long_windows_equal_short_ones_with_special_numbers(spark, monkeypatch):
    from tidemark.functions import ranges

    rng = random.Random(5)
    odd = [NAN, INF, -INF, 0.0]
    series = [("x", {"k": str(k)}, [(t, rng.choice(odd) if k % 3 == 0 and rng.random() < 0.1 else rng.random() * 50) for t in sorted(rng.sample(range(0, 300_000, 500), rng.choice([1, 2, 30, 200])))]) for k in range(12)]
    e = Engine(spark, FrameSource(frame(spark, series).cache()), Config())
    close = lambda a, b: a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= 1e-7 * max(1, abs(a), abs(b))
    for name in ("avg_over_time", "max_over_time", "stddev_over_time", "rate"):
        for width, step in ((20, 5), (60, 13)):
            got = []
            for limit in (10**9, 0):
                monkeypatch.setattr(ranges, "MANY_POINTS", limit)
                got.append(values(e.query_range(f"{name}(x[{width}s])", 10_000, 310_000, step * 1000)))
            assert [x[:2] for x in got[0]] == [x[:2] for x in got[1]] and all(close(x[2], y[2]) for x, y in zip(*got, strict=True)), (name, width, step)
