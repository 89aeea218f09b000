"""Registered queries of the metrics engine and the SQL that states the same results.

Samples come from events (metric event_type, label shard, value) and lineitem. Values are rounded to six digits on both
sides, since sums run in another order.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.matchers import Matcher
from tidemark.functions.ranges import NAMES
from tidemark.functions.selector import parse_series
from tidemark.operators.anomaly import Settings, detect, filtered
from tidemark.plans.engine import DAY, Config, Engine, WindowTooLong
from tidemark.sources.adapters import FrameSource, events_source, lineitem_source
from tidemark.sources.ingest import WRITE, decode, influx_lines, remote_write_body
from tidemark.sources.snappy import TaskSnappy
from tidemark.sources.store import SampleStore, TooManySeries

HOUR = 3600 * 1000
START = 1_704_067_200_000
END = START + 30 * DAY - 6 * HOUR
STEP = 6 * HOUR
AT = START + 20 * DAY
Query = Callable[[SparkSession, str], DataFrame]

#: Shared parts of the SQL: samples, upserted samples, and grid points.
EV = "ev AS (SELECT event_type AS metric, CAST(user_id % 4 AS VARCHAR) AS shard, epoch_us(ts) // 1000 AS ts, value, event_id AS seq FROM events)"
S = f"{EV}, s AS (SELECT metric, shard, ts, arg_max(value, seq) AS value FROM ev GROUP BY metric, shard, ts)"
GRID = f"g AS (SELECT unnest(generate_series({START}, {END}, {STEP})) AS t)"


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    return Engine(spark, events_source(spark, sf_dir))


def rounded(value: Column) -> Column:
    return F.round(value, 6) + F.lit(0.0)


def flat(rows: DataFrame, *labels: str, metric: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """Result rows with scalar label columns."""
    named = [F.col("labels")[n].alias(n) for n in labels]
    return rows.select(*extra, *(["metric"] if metric else []), *named, "ts", rounded(F.col("value")).alias("value"))


def ranged(text: str, *labels: str, metric: bool = True) -> Query:
    return lambda spark, d: flat(engine(spark, d).query_range(text, START, END, STEP), *labels, metric=metric)


def window(metric: str, width: int, where: str = "TRUE") -> str:
    """Samples of each grid point's closed window, with the one before in the window."""
    return (
        f"WITH {S}, {GRID}, w AS (SELECT t, metric, shard, ts, value, lag(ts) OVER p AS pts, lag(value) OVER p AS pv, row_number() OVER (PARTITION BY shard, t ORDER BY ts DESC) AS back "
        f"FROM g JOIN s ON metric = '{metric}' AND ts BETWEEN t - {width} AND t AND {where} WINDOW p AS (PARTITION BY shard, t ORDER BY ts))"
    )


ONE = "shard = '1'"
RISE = "CASE WHEN pv IS NULL THEN 0 WHEN value >= pv THEN value - pv ELSE value END"
#: SQL of each range function over w, with a one-day window.
RANGE_SQL = {
    "rate": (f"sum({RISE}) / 86400.0", "HAVING count(*) >= 2"),
    "increase": (f"sum({RISE})", "HAVING count(*) >= 2"),
    "avg_over_time": ("sum(value) / count(*)", ""),
    "sum_over_time": ("sum(value)", ""),
    "count_over_time": ("CAST(count(*) AS DOUBLE)", ""),
    "min_over_time": ("min(value)", ""),
    "max_over_time": ("max(value)", ""),
    "stddev_over_time": ("stddev_pop(value)", ""),
}


def range_sql(name: str, width: int = DAY) -> str:
    if name == "irate":
        return f"{window('click', width)} SELECT metric, shard, t AS ts, round(CASE WHEN value - pv < 0 THEN value ELSE value - pv END / ((ts - pts) / 1000.0), 6) + 0.0 AS value FROM w WHERE back = 1 AND pts < ts"
    value, having = RANGE_SQL[name]
    return f"{window('click', width)} SELECT metric, shard, t AS ts, round({value}, 6) + 0.0 AS value FROM w GROUP BY metric, shard, t {having}"


def last_sql(width: int, where: str = "TRUE", metric: str = "click") -> str:
    return f"{window(metric, width, where)} SELECT metric, shard, t AS ts, round(value, 6) + 0.0 AS value FROM w WHERE back = 1"


def aggregate_sql(op: str, by: bool) -> str:
    value = {"sum": "sum(value)", "count": "CAST(count(*) AS DOUBLE)", "avg": "avg(value)", "min": "min(value)", "max": "max(value)"}[op]
    shard = "shard, " if by else ""
    return f"{window('view', DAY)}, v AS (SELECT shard, t, value FROM w WHERE back = 1) SELECT {shard}t AS ts, round({value}, 6) + 0.0 AS value FROM v GROUP BY {shard}t"


def raw_sql(where: str) -> str:
    return f"WITH {S} SELECT metric, shard, ts, round(value, 6) + 0.0 AS value FROM s WHERE {where}"


def shared_root(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; a temporary one only for a local master without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    found = found or f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{found}/store-{uuid.uuid4().hex}"


def as_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as samples with a label map and an ingest order."""
    source = events_source(spark, sf_dir).all()
    return source.frame.select("metric", source.labels().alias("labels"), "ts", "value", "ingest_seq")


def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the second rewriting a third of the points, compacted: one row a point, the later value."""
    rows = engine(spark, sf_dir).source.scan()
    rows = rows.frame.select("metric", rows.labels().alias("labels"), "ts", "value")
    store = SampleStore(spark, shared_root(spark))
    store.write(rows)
    store.write(rows.where("ts % 3 = 0").withColumn("value", -F.col("value")))
    store.compact()
    found = store.scan()
    return found.frame.select("metric", found.label("shard").alias("shard"), "ts", rounded(F.col("value")).alias("value"))


def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points a day that stay in a store when days that ended over ten days before the last one go."""
    rows = engine(spark, sf_dir).source.scan()
    store = SampleStore(spark, shared_root(spark))
    store.write(rows.frame.select("metric", rows.labels().alias("labels"), "ts", "value"))
    store.retain(START + 30 * DAY, 10 * DAY)
    return store.scan().frame.groupBy(F.floor(F.col("ts") / DAY).cast("long").alias("day")).agg(F.count("*").alias("points"))


def store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship over a store instead of the table."""
    store = SampleStore(spark, shared_root(spark))
    rows = engine(spark, sf_dir).source.scan("click")
    store.write(rows.frame.select("metric", rows.labels().alias("labels"), "ts", "value"))
    return flat(Engine(spark, store).query_range("sum by (shard) (rate(click[1d]))", START, END, STEP), "shard", metric=False)


def json_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events packed in JSON write bodies of one user each, and read back."""
    rows = as_stored(spark, sf_dir)
    bodies = rows.groupBy(F.pmod("ingest_seq", F.lit(64)).alias("k")).agg(F.to_json(F.struct(F.collect_list(F.struct("metric", "labels", "ts", "value")).alias("samples"))).alias("body"))
    read = bodies.select(F.inline(F.from_json("body", WRITE)["samples"]))
    return read.groupBy("metric", F.col("labels")["shard"].alias("shard")).agg(F.count("*").alias("points"), rounded(F.sum("value")).alias("total"))


def influx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as Influx lines, some of them broken, and read back."""
    rows = as_stored(spark, sf_dir)
    text = F.concat(F.lit("ev,shard="), F.col("labels")["shard"], F.lit(' note="x",'), F.col("metric"), F.lit("="), F.col("value").cast("string"), F.lit(",k=1i "), (F.col("ts") * 1_000_000 + 7).cast("string"))
    lines = rows.select(F.when(F.col("ingest_seq") % 10 == 0, F.lit("broken line")).otherwise(text).alias("value"))
    return influx_lines(lines).groupBy("metric", F.col("labels")["shard"].alias("shard")).agg(F.count("*").alias("points"), F.min("ts").alias("first"), rounded(F.sum("value")).alias("total"))


def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of each series in time order with a lower threshold, so that there are some."""
    samples = events_source(spark, sf_dir).all()
    found = detect(samples, Settings(threshold=2.0))
    return found.select("metric", F.col("l_shard").alias("shard"), "ts", rounded(F.col("value")).alias("value"), rounded(F.col("expected")).alias("expected"), rounded(F.col("z_score")).alias("z_score"), "type")


EWMA_SQL = f"""
WITH RECURSIVE {EV}, o AS (SELECT *, row_number() OVER (PARTITION BY metric, shard ORDER BY ts, seq) AS k FROM ev), f AS (
  SELECT metric, shard, ts, value, k, value AS fast, value AS slow, CAST(0 AS DOUBLE) AS var, CAST(NULL AS DOUBLE) AS pf, CAST(NULL AS DOUBLE) AS ps, CAST(NULL AS DOUBLE) AS pv FROM o WHERE k = 1
  UNION ALL
  SELECT o.metric, o.shard, o.ts, o.value, o.k, 0.3 * o.value + (1 - 0.3) * f.fast, 0.05 * o.value + (1 - 0.05) * f.slow,
    0.3 * ((o.value - f.fast) * (o.value - f.fast)) + (1 - 0.3) * f.var, f.fast, f.slow, f.var
  FROM f JOIN o ON o.metric = f.metric AND o.shard = f.shard AND o.k = f.k + 1
), e AS (
  SELECT *, sqrt(pv) AS sd FROM f WHERE k > 10
), z AS (
  SELECT *, CASE WHEN sd < 1e-10 THEN 100 ELSE abs(value - pf) / sd END AS score FROM e
  WHERE CASE WHEN sd < 1e-10 THEN abs(value - pf) >= 1e-10 ELSE abs(value - pf) / sd > 2 END
)
SELECT metric, shard, ts, round(value, 6) + 0.0 AS value, round(pf, 6) + 0.0 AS expected, round(score, 6) + 0.0 AS z_score,
  CASE WHEN sd > 1e-10 AND abs(pf - ps) / sd > 1 THEN 'drift' WHEN value > pf THEN 'spike' ELSE 'drop' END AS type FROM z
"""


def first_at(spark: SparkSession, sf_dir: str, metric: str, since: int, where: str = "TRUE") -> int:
    """The time of the first sample of a metric from a time on, so that reads of one time have something to find."""
    rows = events_source(spark, sf_dir).all().frame.where((F.col("metric") == metric) & (F.col("ts") >= since)).where(where)
    return rows.agg(F.min("ts")).first()[0]


def first_sql(metric: str, since: int, where: str = "TRUE") -> str:
    return f"(SELECT min(ts) FROM s WHERE metric = '{metric}' AND ts >= {since} AND {where})"


def with_control(query: Query) -> Query:
    """A query that gives nothing, together with one that gives something."""
    control = ranged('purchase{shard="1"}[1d]', "shard")
    return lambda spark, d: query(spark, d).unionByName(control(spark, d))


def control_sql() -> str:
    return last_sql(DAY, "shard = '1'", "purchase")


def told(spark: SparkSession, cases: dict[str, Callable[[], object]], *errors: type[Exception]) -> DataFrame:
    """(name, rejected) of calls that are planned, or refused, on the driver."""
    found = []
    for name, call in cases.items():
        try:
            call()
            found.append((name, False))
        except errors:
            found.append((name, True))
    return spark.createDataFrame(found, "name string, rejected boolean")


def told_sql(rejected: str, accepted: str) -> str:
    rows = [f"('{n}', TRUE)" for n in rejected.split()] + [f"('{n}', FALSE)" for n in accepted.split()]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(name, rejected)"


def remote_read_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, own = Matcher("__name__", "=", "click"), engine(spark, sf_dir)
    read = lambda *m, start=START: lambda: own.remote_read([(start, AT, list(m))])
    cases = {
        "no_matcher": read(), "no_name": read(Matcher("shard", "=", "1")), "name_pattern": read(Matcher("__name__", "=~", "click")), "conflict": read(name, Matcher("shard", "=", "1"), Matcher("shard", "=", "2")),
        "bad_pattern": read(name, Matcher("shard", "=~", "(")), "empty_label": read(name, Matcher("", "=", "1")), "reversed": read(name, start=AT + 1),
        "fine": read(name), "same_twice": read(name, Matcher("shard", "=", "1"), Matcher("shard", "=", "1")),
    }
    return told(spark, cases, ValueError)


def window_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, free = engine(spark, sf_dir), Engine(spark, events_source(spark, sf_dir), Config(max_window=0))
    long = START + 90 * DAY + 1
    cases = {
        "range": lambda: own.query_range("click", START, long, DAY), "plain": lambda: own.between("click", {}, START, long), "lookback": lambda: own.query("click[91d]", AT),
        "remote": lambda: own.remote_read([(START, long, [Matcher("__name__", "=", "click")])]),
        "at_the_cap": lambda: own.query_range("click", START, long - 1, DAY), "series": lambda: own.series([("click", {})], START, long), "lifted": lambda: free.query_range("click", START, long, DAY),
    }
    return told(spark, cases, WindowTooLong)


def with_nan(spark: SparkSession, sf_dir: str) -> FrameSource:
    """events, every third value not a number."""
    rows = as_stored(spark, sf_dir)
    return FrameSource(rows.withColumn("value", F.when(F.col("ingest_seq") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))))


NAN_VALUE = "CASE WHEN event_id % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS value"
NAN_S = S.replace(" value, event_id", f" {NAN_VALUE}, event_id")


def nan_query(text: str, *labels: str, metric: bool = True) -> Query:
    """A query over values of which some are not numbers; infinities are told by a number."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Engine(spark, with_nan(spark, sf_dir)).query_range(text, START, END, STEP)
        v = F.col("value")
        told_ = F.when(F.isnan(v), F.lit(-1e9)).when(v == float("inf"), F.lit(1e9)).when(v == float("-inf"), F.lit(-2e9)).otherwise(v)
        return flat(rows.withColumn("value", told_), *labels, metric=metric)

    return run


def nan_sql(value: str) -> str:
    """One function of each window of click, an hour long, over those values."""
    base = window("click", HOUR).replace(f"WITH {S}", f"WITH {NAN_S}")
    return f"{base} SELECT metric, shard, t AS ts, round({value}, 6) + 0.0 AS value FROM w GROUP BY metric, shard, t"


def nan_aggregate_sql(value: str) -> str:
    base = window("click", DAY).replace(f"WITH {S}", f"WITH {NAN_S}")
    return f"{base}, v AS (SELECT t, value FROM w WHERE back = 1) SELECT t AS ts, round({value}, 6) + 0.0 AS value FROM v GROUP BY t"


NAN_LEAST, NAN_GREATEST = "coalesce(min(value) FILTER (WHERE NOT isnan(value)), 1e9)", "coalesce(max(value) FILTER (WHERE NOT isnan(value)), -2e9)"


def plain_rows(spark: SparkSession, sf_dir: str, metric: str | None = None) -> DataFrame:
    """Upserted events as a batch for a store."""
    rows = engine(spark, sf_dir).source.scan(metric)
    return rows.frame.select("metric", rows.labels().alias("labels"), "ts", "value")


def stored(store: SampleStore) -> DataFrame:
    found = store.scan()
    return found.frame.select("metric", found.label("shard").alias("shard"), "ts", rounded(F.col("value")).alias("value"))


def store_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch that writes each point five times, the versions in order in 150 partitions: the last one holds."""
    store = SampleStore(spark, shared_root(spark))
    versions = F.explode(F.sequence(F.lit(0), F.lit(4)))
    rows = plain_rows(spark, sf_dir).withColumn("version", versions).repartitionByRange(150, "version", "ts")
    store.write(rows.withColumn("value", F.col("value") + F.col("version")))
    return stored(store)


def store_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label names, values and series of a store of three batches, by its catalog."""
    store = SampleStore(spark, shared_root(spark))
    for metric in ("click", "view", "click"):
        store.write(plain_rows(spark, sf_dir, metric))
    own = Engine(spark, store)
    listed = lambda df, kind: df.select(F.lit(kind).alias("kind"), df[df.columns[0]].alias("value"))
    found = listed(own.label_names(), "name").union(listed(own.label_values("shard"), "shard")).union(listed(own.label_values("__name__"), "metric"))
    return found.union(store.catalog().select(F.lit("series"), F.concat_ws("/", "metric", F.get_json_object("series", "$.shard"))))


def store_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label matchers on a store: tested once a series on the catalog, then in the scan by the series that fit."""
    store = SampleStore(spark, shared_root(spark))
    store.write(plain_rows(spark, sf_dir))
    return flat(Engine(spark, store).query_range('sum_over_time(click{shard=~"[12]",shard!="2"}[1d])', START, END, STEP), "shard")


def store_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot, then writes over it, then the snapshot again."""
    store, copy = SampleStore(spark, shared_root(spark)), shared_root(spark)
    store.write(plain_rows(spark, sf_dir))
    store.snapshot(copy)
    store.write(plain_rows(spark, sf_dir, "click").withColumn("value", F.lit(-1.0)))
    store.restore(copy)
    return stored(store)


def cap_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each series in a store with a cap of two: a batch over it is rejected with all its metrics."""
    store = SampleStore(spark, shared_root(spark), max_series=2)
    rows = plain_rows(spark, sf_dir)
    store.write(rows.where("metric = 'click' AND labels['shard'] < '2'"))
    for batch in (rows.where("metric = 'click' OR metric = 'view' AND labels['shard'] = '0'"), rows.where("metric = 'view'")):
        try:
            store.write(batch)
        except TooManySeries:
            continue
    store.write(rows.where("metric = 'purchase' AND labels['shard'] = '3'"))
    found = store.scan()
    return found.frame.groupBy("metric", found.label("shard").alias("shard")).agg(F.count("*").alias("points"))


def remote_write_snappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as Snappy remote-write messages of some thousand samples each, decoded again: points and totals a series.

    Messages are made and decoded in the tasks, from rows that are dealt out evenly however few row groups the files
    have; a task gives one row a series.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        snappy, total = TaskSnappy(), {}
        bodies: list[tuple[str, tuple[tuple[str, str], ...], int, float]] = []

        def flush() -> None:
            for metric, labels, _, value in decode(snappy.pack(remote_write_body(bodies)), "application/x-protobuf", "snappy", snappy.unpack):
                own = total.setdefault((metric, labels["shard"]), [0, 0.0])
                own[0], own[1] = own[0] + 1, own[1] + value
            bodies.clear()

        for batch in batches:
            for m, s, t, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bodies.append((m, (("shard", s),), t, v))
                if len(bodies) == 5000:
                    flush()
        if bodies:
            flush()
        rows = [(*k, *v) for k, v in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.float64()))], names=["metric", "shard", "points", "total"])

    rows = events_source(spark, sf_dir).all().frame.repartition("ingest_seq", "ts").select("metric", "l_shard", "ts", "value")
    made = rows.mapInArrow(run, "metric string, shard string, points long, total double")
    return made.groupBy("metric", "shard").agg(F.sum("points").alias("points"), rounded(F.sum("total")).alias("total"))


def remote(*matchers: Matcher) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = engine(spark, sf_dir).remote_read([(START, AT, [Matcher("__name__", "=", "click"), *matchers]), (AT, AT + DAY, [Matcher("__name__", "=", "view"), *matchers])])
        return flat(found, "shard", extra=("query",))

    return run


def remote_sql(where: str) -> str:
    return (
        f"WITH {S} SELECT CASE metric WHEN 'click' THEN 0 ELSE 1 END AS query, metric, shard, ts, round(value, 6) + 0.0 AS value FROM s "
        f"WHERE (metric = 'click' AND ts BETWEEN {START} AND {AT} OR metric = 'view' AND ts BETWEEN {AT} AND {AT + DAY}) AND {where}"
    )


def sum_by_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range function over samples with many writes at one time, years of them: the cap on the window is lifted."""
    own = Engine(spark, lineitem_source(spark, sf_dir), Config(max_window=0))
    rows = own.query_range("max by (returnflag) (sum_over_time(lineitem_quantity[4w]))", 788_918_400_000, 978_307_200_000, 28 * DAY)
    return flat(rows, "returnflag", metric=False)


SUM_BY_FLAGS_SQL = f"""
WITH s AS (SELECT l_returnflag AS f, l_linestatus AS l, epoch_ms(l_shipdate) AS ts, arg_max(l_quantity, l_orderkey * 100 + l_linenumber) AS value FROM lineitem GROUP BY ALL),
g AS (SELECT unnest(generate_series(788918400000, 978307200000, {28 * DAY})) AS t),
w AS (SELECT t, f, l, sum(value) AS value FROM g JOIN s ON ts BETWEEN t - {28 * DAY} AND t GROUP BY ALL)
SELECT f AS returnflag, t AS ts, round(max(value), 6) + 0.0 AS value FROM w GROUP BY ALL
"""


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "sum_by_rate": ranged("sum by (shard) (rate(click[1d]))", "shard", metric=False),
        "native_range_partial": lambda s, d: flat(engine(s, d).between("click", {}, START, AT, partial=True), "shard"),
        "native_range_exact": lambda s, d: flat(engine(s, d).between("click", {"shard": "1"}, START, AT), "shard"),
        "native_instant": lambda s, d: flat(engine(s, d).at("click", {"shard": "1"}, first_at(s, d, "click", START + DAY, "l_shard = '1'")), "shard"),
        "native_instant_partial": lambda s, d: flat(engine(s, d).at("view", {}, first_at(s, d, "view", AT), partial=True), "shard"),
        "native_range_by_series": lambda s, d: engine(s, d).by_series(engine(s, d).between("purchase", {}, START, AT, partial=True)).select("metric", F.col("labels")["shard"].alias("shard"), F.size("points").cast("long").alias("points"), F.col("points")[0]["ts"].alias("first")),
        "select_eq": ranged('click{shard="2"}[1d]', "shard"),
        "select_neq": ranged('click{shard!="2"}[1d]', "shard"),
        "select_neq_missing": ranged('click{zone!="a",shard!=""}[1d]', "shard"),
        "select_eq_empty": with_control(ranged('click{zone=""}[1d]', "shard")),
        "select_regex": ranged('click{shard=~"[01]|3"}[1d]', "shard"),
        "select_regex_missing": ranged('click{zone=~".*"}[1d]', "shard"),
        "select_not_regex": ranged('click{shard!~"0|1"}[1d]', "shard"),
        "select_bad_regex": with_control(ranged('click{shard!~"("}[1d]', "shard")),
        "select_name": ranged('click{__name__="click",shard=~"1"}[1d]', "shard"),
        "select_without_metric": with_control(ranged('{__name__="click"}[1d]', "shard")),
        "instant_lookback": lambda s, d: flat(engine(s, d).query("click", first_at(s, d, "click", AT) + 60_000), "shard"),
        "instant_lookback_day": lambda s, d: flat(engine(s, d).query("click[1d]", AT), "shard"),
        "range_lookback": ranged("click", "shard"),
        "remote_read_eq": remote(Matcher("shard", "=", "1")),
        "remote_read_neq": remote(Matcher("shard", "!=", "1"), Matcher("zone", "!=", "")),
        "remote_read_re": remote(Matcher("shard", "=~", "[12]")),
        "remote_read_re_missing": lambda s, d: remote(Matcher("zone", "=~", ".*"))(s, d).unionByName(remote(Matcher("zone", "!~", ".*"), Matcher("shard", "=", "1"))(s, d)),
        "remote_read_nre": remote(Matcher("shard", "!~", "[12]"), Matcher("zone", "!~", "x")),
        "agg_nested": ranged("max(sum by (shard) (avg_over_time(click[1d])))", metric=False),
        "agg_missing_label": ranged("sum by (zone, shard) (max_over_time(click[1d]))", "zone", "shard", metric=False),
        "scalar_grid": ranged("-2.5", metric=False),
        "scalar_sum": ranged("sum(3)", metric=False),
        "sum_over_long_time": ranged("sum_over_time(click[20d])", "shard"),
        "max_over_long_time": ranged("max_over_time(click[20d])", "shard"),
        "sum_by_flags": sum_by_flags,
        "label_names": lambda s, d: engine(s, d).label_names(),
        "label_values": lambda s, d: engine(s, d).label_values("shard"),
        "label_values_name": lambda s, d: engine(s, d).label_values("__name__"),
        "series_list": lambda s, d: engine(s, d).series([("click", {})], START, AT).select("metric", F.col("labels")["shard"].alias("shard")),
        "series_union": lambda s, d: engine(s, d).series([parse_series(x) for x in ('click{shard="1"}', "click", 'view{shard="2",}')], START, AT).select("metric", F.col("labels")["shard"].alias("shard")),
        "series_of_metrics": lambda s, d: engine(s, d).metrics_series([" click", "view", "click"], START, AT).select("metric", F.col("labels")["shard"].alias("shard")),
        "lww_dedup": lambda s, d: (lambda x: x.frame.select("l_returnflag", "l_linestatus", "ts", "value"))(lineitem_source(s, d).scan()),
        "cardinality_report": lambda s, d: FrameSource(as_stored(s, d)).all().frame.select("metric", "series").distinct().groupBy("metric").agg(F.count("*").alias("series")),
        "select_last_of_a_name": ranged('click{shard="1",shard="2"}[1d]', "shard"),
        "select_name_others": ranged('click{__name__!="x",__name__=~""}[1d]', "shard"),
        "agg_absent": ranged('count by (shard) (click{shard=~"1|9"}[1d])', "shard", metric=False),
        "nan_min_over_time": nan_query("min_over_time(click[1h])", "shard"),
        "nan_max_over_time": nan_query("max_over_time(click[1h])", "shard"),
        "nan_count_over_time": nan_query("count_over_time(click[1h])", "shard"),
        "nan_min": nan_query("min(click[1d])", metric=False),
        "nan_max": nan_query("max(click[1d])", metric=False),
        "nan_count": nan_query("count(click[1d])", metric=False),
        "remote_read_errors": remote_read_errors,
        "window_cap": window_cap,
        "remote_write_snappy": remote_write_snappy,
        "cap_rejects": cap_rejects,
        "store_upserts": store_upserts,
        "store_labels": store_labels,
        "store_filter": store_filter,
        "store_restore": store_restore,
        "store_compact": store_compact,
        "store_query": store_query,
        "retention_keep": retention_keep,
        "json_write": json_write,
        "influx_lines": influx,
        "ewma_anomalies": ewma,
        "anomaly_filter": lambda s, d: filtered(ewma(s, d), metric="c*k", min_z=2.5, types="spike, drop"),
    }
    found |= {(f"{name}_range" if name in ("rate", "irate", "increase") else name): ranged(f"{name}(click[1d])", "shard") for name in NAMES}
    for op in ("sum", "count", "avg", "min", "max"):
        found[f"agg_{op}"] = ranged(f"{op}(view[1d])", metric=False)
        found[f"agg_{op}_by"] = ranged(f"{op}(view[1d]) by (shard)", "shard", metric=False)
    return found


def oracle_sql() -> dict[str, str]:
    many = f"WITH {EV} SELECT DISTINCT metric, shard FROM ev WHERE ts BETWEEN {START} AND {AT} AND "
    found = {
        "sum_by_rate": f"{window('click', DAY)}, r AS (SELECT shard, t, sum({RISE}) / 86400.0 AS v FROM w GROUP BY shard, t HAVING count(*) >= 2) SELECT shard, t AS ts, round(sum(v), 6) + 0.0 AS value FROM r GROUP BY shard, t",
        "native_range_partial": raw_sql(f"metric = 'click' AND ts BETWEEN {START} AND {AT}"),
        "native_range_exact": raw_sql(f"metric = 'click' AND shard = '1' AND ts BETWEEN {START} AND {AT}"),
        "native_instant": raw_sql("metric = 'click' AND shard = '1' AND ts = " + first_sql("click", START + DAY, "shard = '1'")),
        "native_instant_partial": raw_sql("metric = 'view' AND ts = " + first_sql("view", AT)),
        "native_range_by_series": f"WITH {S} SELECT metric, shard, count(*) AS points, min(ts) AS first FROM s WHERE metric = 'purchase' AND ts BETWEEN {START} AND {AT} GROUP BY metric, shard",
        "select_eq": last_sql(DAY, "shard = '2'"),
        "select_neq": last_sql(DAY, "shard <> '2'"),
        "select_neq_missing": last_sql(DAY),
        "select_eq_empty": control_sql(),
        "select_regex": last_sql(DAY, "regexp_full_match(shard, '[01]|3')"),
        "select_regex_missing": last_sql(DAY),
        "select_not_regex": last_sql(DAY, "NOT regexp_full_match(shard, '0|1')"),
        "select_bad_regex": control_sql(),
        "select_name": last_sql(DAY, "shard = '1'"),
        "select_without_metric": control_sql(),
        "instant_lookback": f"WITH {S}, a AS (SELECT {first_sql('click', AT)} + 60000 AS t) SELECT metric, shard, t AS ts, round(arg_max(value, s.ts), 6) + 0.0 AS value FROM s, a WHERE metric = 'click' AND s.ts BETWEEN t - 300000 AND t GROUP BY metric, shard, t",
        "instant_lookback_day": f"WITH {S} SELECT metric, shard, CAST({AT} AS BIGINT) AS ts, round(arg_max(value, s.ts), 6) + 0.0 AS value FROM s WHERE metric = 'click' AND s.ts BETWEEN {AT - DAY} AND {AT} GROUP BY metric, shard",
        "range_lookback": last_sql(300_000),
        "remote_read_eq": remote_sql("shard = '1'"),
        "remote_read_neq": remote_sql("shard <> '1'"),
        "remote_read_re": remote_sql("shard IN ('1', '2')"),
        "remote_read_re_missing": remote_sql("shard = '1'"),
        "remote_read_nre": remote_sql("shard NOT IN ('1', '2')"),
        "agg_nested": f"{window('click', DAY)}, a AS (SELECT shard, t, avg(value) AS v FROM w GROUP BY shard, t) SELECT t AS ts, round(max(v), 6) + 0.0 AS value FROM a GROUP BY t",
        "agg_missing_label": f"{window('click', DAY)}, a AS (SELECT shard, t, max(value) AS v FROM w GROUP BY shard, t) SELECT CAST(NULL AS VARCHAR) AS zone, shard, t AS ts, round(sum(v), 6) + 0.0 AS value FROM a GROUP BY shard, t",
        "scalar_grid": f"WITH {GRID} SELECT t AS ts, CAST(-2.5 AS DOUBLE) AS value FROM g",
        "scalar_sum": f"WITH {GRID} SELECT t AS ts, CAST(3 AS DOUBLE) AS value FROM g",
        "sum_over_long_time": range_sql("sum_over_time", 20 * DAY),
        "max_over_long_time": range_sql("max_over_time", 20 * DAY),
        "sum_by_flags": SUM_BY_FLAGS_SQL,
        "label_names": "SELECT '__name__' AS name UNION SELECT 'shard'",
        "label_values": "SELECT DISTINCT CAST(user_id % 4 AS VARCHAR) AS value FROM events",
        "label_values_name": "SELECT DISTINCT event_type AS value FROM events",
        "series_list": many + "metric = 'click'",
        "series_union": many + "(metric = 'click' OR metric = 'view' AND shard = '2')",
        "series_of_metrics": many + "metric IN ('click', 'view')",
        "lww_dedup": "SELECT l_returnflag, l_linestatus, epoch_ms(l_shipdate) AS ts, arg_max(l_quantity, l_orderkey * 100 + l_linenumber) AS value FROM lineitem GROUP BY ALL",
        "cardinality_report": f"WITH {EV} SELECT metric, count(DISTINCT shard) AS series FROM ev GROUP BY metric",
        "store_compact": f"WITH {S} SELECT metric, shard, ts, round(CASE WHEN ts % 3 = 0 THEN -value ELSE value END, 6) + 0.0 AS value FROM s",
        "store_query": "",
        "select_last_of_a_name": last_sql(DAY, "shard = '2'"),
        "select_name_others": last_sql(DAY),
        "agg_absent": f"{window('click', DAY, ONE)} SELECT shard, t AS ts, CAST(count(*) AS DOUBLE) AS value FROM w WHERE back = 1 GROUP BY shard, t",
        "nan_min_over_time": nan_sql(NAN_LEAST),
        "nan_max_over_time": nan_sql(NAN_GREATEST),
        "nan_count_over_time": nan_sql("CAST(count(*) AS DOUBLE)"),
        "nan_min": nan_aggregate_sql(NAN_LEAST),
        "nan_max": nan_aggregate_sql(NAN_GREATEST),
        "nan_count": nan_aggregate_sql("CAST(count(*) AS DOUBLE)"),
        "remote_read_errors": told_sql("no_matcher no_name name_pattern conflict bad_pattern empty_label reversed", "fine same_twice"),
        "window_cap": told_sql("range plain lookback remote", "at_the_cap series lifted"),
        "remote_write_snappy": f"WITH {EV} SELECT metric, shard, count(*) AS points, round(sum(value), 6) + 0.0 AS total FROM ev GROUP BY metric, shard",
        "cap_rejects": f"WITH {S} SELECT metric, shard, count(*) AS points FROM s WHERE metric = 'click' AND shard < '2' OR metric = 'purchase' AND shard = '3' GROUP BY metric, shard",
        "store_upserts": f"WITH {S} SELECT metric, shard, ts, round(value + 4, 6) + 0.0 AS value FROM s",
        "store_labels": f"WITH {EV}, m AS (SELECT * FROM ev WHERE metric IN ('click', 'view')) SELECT 'name' AS kind, '__name__' AS value UNION SELECT 'name', 'shard' UNION SELECT 'shard', shard FROM m UNION SELECT 'metric', metric FROM m UNION SELECT 'series', metric || '/' || shard FROM m",
        "store_filter": f"{window('click', DAY, ONE)} SELECT metric, shard, t AS ts, round(sum(value), 6) + 0.0 AS value FROM w GROUP BY metric, shard, t",
        "store_restore": raw_sql("TRUE"),
        "retention_keep": f"WITH {S}, d AS (SELECT ts // {DAY} AS day, count(*) AS points, max(ts) AS last FROM s GROUP BY 1) SELECT day, points FROM d WHERE last >= {START + 20 * DAY}",
        "json_write": f"WITH {EV} SELECT metric, shard, count(*) AS points, round(sum(value), 6) + 0.0 AS total FROM ev GROUP BY metric, shard",
        "influx_lines": f"WITH {EV} SELECT 'ev_' || metric AS metric, shard, count(*) AS points, min(ts) AS first, round(sum(value), 6) + 0.0 AS total FROM ev WHERE seq % 10 <> 0 GROUP BY metric, shard",
        "ewma_anomalies": EWMA_SQL,
        "anomaly_filter": f"SELECT * FROM ({EWMA_SQL}) WHERE metric LIKE 'c%k' AND z_score >= 2.5 AND type IN ('spike', 'drop')",
    }
    found["store_query"] = found["sum_by_rate"]
    found |= {(f"{name}_range" if name in ("rate", "irate", "increase") else name): range_sql(name) for name in NAMES}
    for op in ("sum", "count", "avg", "min", "max"):
        found[f"agg_{op}"] = aggregate_sql(op, False)
        found[f"agg_{op}_by"] = aggregate_sql(op, True)
    return found
