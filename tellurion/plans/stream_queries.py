"""Registered queries of the streams: each reads a given table as files, runs all that is there, and returns the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import warehouse as W
from ..streaming import changes as C
from ..streaming import rollups as R
from ..streaming import summaries as S
from . import views as V
from .telemetry_queries import ABSENT as ABSENT_ROWS
from .telemetry_queries import STATES
from .warehouse_queries import BASE, CHANGES, base_orders, changes, scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def events(spark, sf) -> DataFrame:
    return R.file_stream(spark, f"{sf}/events.parquet")


#: The watermark after the last batch: an hour before the latest event.
CLOSED = "(SELECT max(epoch_us(ts) // 1000) - 3600000 FROM events)"


@query("e01_stream_ingest", "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type <> 'view'")
def _(spark, sf):
    out = scratch(spark, "ingest")
    R.run_available(events(spark, sf).where("event_type <> 'view'").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")), out)
    return spark.read.parquet(out)


def rolled_sql(width: int, closed: str) -> str:
    return f"SELECT event_type, bucket, CAST(sum(cents) AS BIGINT) AS value_sum, count(*) AS value_count, min(cents) AS value_min, max(cents) AS value_max FROM (SELECT *, ms - ms % {width} AS bucket FROM ev) WHERE bucket + {closed} <= {CLOSED} GROUP BY event_type, bucket"


def _flat(spark, out: str) -> DataFrame:
    return spark.read.parquet(out).select("event_type", F.unix_millis("window.start").alias("bucket"), "value_sum", "value_count", "value_min", "value_max")


def cents(spark, sf) -> DataFrame:
    return events(spark, sf).withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))


@query("e02_stream_rollup", V.sql(rolled_sql(300_000, "300000"), "ev"))
def _(spark, sf):
    out = scratch(spark, "rollup5")
    R.run_available(R.rollup(cents(spark, sf), "5 minutes", ["event_type"], "cents"), out)
    return _flat(spark, out)


@query("e03_stream_cascade", V.sql(rolled_sql(1_800_000, "1800000"), "ev"))
def _(spark, sf):
    out = scratch(spark, "rollup30")
    R.run_available(R.cascade(R.rollup(cents(spark, sf), "5 minutes", ["event_type"], "cents"), "30 minutes", ["event_type"]), out)
    return _flat(spark, out)


@query("e05_stream_discovery", V.sql("SELECT user_id AS service, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM ev GROUP BY ALL", "ev"))
def _(spark, sf):
    root = scratch(spark, "discovery")
    part = lambda df: df.groupBy("service").agg(F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    rows = events(spark, sf).select(F.col("user_id").alias("service"), F.lit(1).cast("bigint").alias("n"), F.unix_millis("ts").alias("first_ms"), F.unix_millis("ts").alias("last_ms"))
    R.run_batches(rows, f"{root}_checkpoint", R.merge_partials(spark, root, part))
    return R.merged(spark, root, part)


@query("e09_stream_sessions", V.sql(
    f"SELECT user_id, min(ms) AS start_ms, count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM (SELECT *, epoch_us(ts) AS us FROM ev))) GROUP BY user_id, s HAVING max(ms) + 7200000 <= {CLOSED}", "ev"))
def _(spark, sf):
    out = scratch(spark, "sessions")
    R.run_available(R.sessions(events(spark, sf), "2 hours", ["user_id"]), out)
    return spark.read.parquet(out).select("user_id", F.unix_millis("session_window.start").alias("start_ms"), "events")


@query("e12_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    out = scratch(spark, "dedupe")
    R.run_available(R.deduplicate(events(spark, sf), ["user_id", "event_type"], "40 days").select("user_id", "event_type"), out)
    return spark.read.parquet(out)


@query("e10_stream_alerts", V.sql("SELECT rule, eval_ms, state FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY rule ORDER BY eval_ms), 'OK') AS before FROM (SELECT fp AS rule, ms - ms % 3600000 AS eval_ms, CASE WHEN count(*) > 1 THEN 'ALERT' ELSE 'OK' END AS state FROM exc GROUP BY ALL)) WHERE state <> before", "exc"))
def _(spark, sf):
    source, out = scratch(spark, "alert-values"), scratch(spark, "alerts")
    x = V.exceptions(spark, sf)
    values = x.groupBy(F.col("fp").cast("bigint").alias("rule"), (F.col("ms") - F.col("ms") % 3_600_000).alias("eval_ms")).agg(F.count("*").cast("double").alias("value"))
    for part in ("eval_ms < 1705400000000", "eval_ms >= 1705400000000"):
        values.where(part).coalesce(1).write.mode("append").parquet(source)
    R.run_available(R.alert_states(R.file_stream(spark, source, files_per_batch=1), "above", 1), out)
    return spark.read.parquet(out)


#: Hourly counts, as far as the stream's last row: what the batch form notifies before it, or at a row of that hour.
STREAM_END = "(SELECT max(ms - ms % 3600000) FROM exc)"


@query("e10_stream_absent_alerts", V.sql(
    "SELECT rule, eval_ms, state FROM ch WHERE changed AND state = 'OK' UNION ALL SELECT rule, eval_ms, 'ALERT' FROM fired", "exc", raw=f"SELECT * FROM ({ABSENT_ROWS}) WHERE eval_ms < {STREAM_END} OR (eval_ms = {STREAM_END} AND value IS NOT NULL)", st=STATES,
    ch="SELECT *, state <> coalesce(lag(state) OVER (PARTITION BY rule ORDER BY eval_ms), 'OK') AS changed FROM st", runs="SELECT *, sum(changed::INT) OVER (PARTITION BY rule ORDER BY eval_ms) AS run FROM ch",
    fired="SELECT rule, eval_ms FROM (SELECT *, row_number() OVER (PARTITION BY rule, run ORDER BY eval_ms) AS k FROM runs WHERE state = 'ALERT') WHERE (k - 1) % 7 = 0"))
def _(spark, sf):
    source, out = scratch(spark, "absent-values"), scratch(spark, "absent-alerts")
    x = V.exceptions(spark, sf).select(F.col("fp").cast("bigint").alias("rule"), "ms")
    counts = x.groupBy("rule", (F.col("ms") - F.col("ms") % V.HOUR).alias("eval_ms")).agg(F.count("*").cast("double").alias("value"))
    rules = x.select("rule").distinct().select("rule", F.lit(V.T0).alias("eval_ms"), F.lit(None).cast("double").alias("value"))
    rows = rules.unionByName(counts).withColumn("ts", F.timestamp_millis("eval_ms")).withColumn("part", F.floor((F.col("eval_ms") - V.T0) / (5 * V.DAY)).cast("int"))
    for part in range(6):
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
    R.run_available(R.alert_notifications(R.file_stream(spark, source, files_per_batch=1), "above", 2, V.HOUR, 6 * V.HOUR, 6 * V.HOUR), out)
    return spark.read.parquet(out)


@query("e15_stream_changes", V.sql("SELECT k, price, status FROM base WHERE k NOT IN (SELECT k FROM ch) UNION ALL SELECT k, price, status FROM ch WHERE op = 'insert' OR (op = 'update' AND k IN (SELECT k FROM base))", base=BASE, ch=CHANGES))
def _(spark, sf):
    source, root = scratch(spark, "changes"), scratch(spark, "versions")
    rows = changes(spark, sf)
    for part in ("k % 3 = 0", "k % 3 = 1", "k % 3 = 2"):
        rows.where(part).coalesce(1).write.mode("append").parquet(source)
    return C.apply_stream(spark, R.file_stream(spark, source, files_per_batch=1), base_orders(spark, sf), root, ["k"], parts=8)


@query("a11_stream_source", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    root = scratch(spark, "counts")
    part = lambda df: df.groupBy("event_type").agg(F.sum("n").alias("n"))
    R.run_batches(events(spark, sf).select("event_type", F.lit(1).cast("bigint").alias("n")), f"{root}_checkpoint", R.merge_partials(spark, root, part))
    return R.merged(spark, root, part)


@query("a12_change_source", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'delete' WHEN o_orderkey % 5 = 0 THEN 'update' ELSE 'insert' END AS op, o_orderkey AS seq FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0")
def _(spark, sf):
    source, out = scratch(spark, "change-log"), scratch(spark, "change-rows")
    changes(spark, sf).write.parquet(source)
    R.run_available(R.file_stream(spark, source).select("k", "op", "seq"), out)
    return spark.read.parquet(out)


def in_parts(spark, sf, label: str, parts: int = 3) -> str:
    """Events as files that a stream takes one by one."""
    path = scratch(spark, label)
    rows = V.event_rows(spark, sf).select("event_type", "k", "user_id", "ms")
    rows.withColumn("_f", F.pmod("k", F.lit(parts))).repartition(parts, "_f").drop("_f").write.parquet(path)
    return path


@query("e13_incremental_summary", V.sql("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY event_type", "ev"))
def _(spark, sf):
    stream = R.file_stream(spark, in_parts(spark, sf, "summary-rows"), files_per_batch=1)
    pairs = S.refresh(spark, stream, scratch(spark, "summary-states"), ["event_type", "user_id"], {"n": (F.count("*"), F.sum("n"))}, fold=2)
    return pairs.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("user_id").alias("users"))


@query("e13_sketched_summary")
def _(spark, sf):
    stream = R.file_stream(spark, in_parts(spark, sf, "sketch-rows"), files_per_batch=1)
    states = {"n": (F.count("*"), F.sum("n")), "users": (F.hll_sketch_agg("user_id"), F.hll_union_agg("users")), "ms": (F.kll_sketch_agg_bigint("ms"), F.kll_merge_agg_bigint("ms"))}
    merged = S.refresh(spark, stream, scratch(spark, "sketch-states"), ["event_type"], states)
    return merged.select("event_type", "n", F.hll_sketch_estimate("users").alias("users"), F.kll_sketch_get_quantile_bigint("ms", F.lit(0.5)).alias("median_ms"))
