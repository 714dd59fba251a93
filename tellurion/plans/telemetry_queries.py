"""Registered queries of the telemetry operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..operators import metrics as M
from ..operators import telemetry as T
from . import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


P = lambda q: f"round(quantile_cont(duration_ns, {q}) / 1000000, 6)"
ERR = "count(*) FILTER (WHERE error)"


@query("c01_trace_summary", V.sql(
    f"SELECT trace_id, min(ts) AS started, max(epoch_us(ts) * 1000 + duration_ns) - min(epoch_us(ts) * 1000) AS length_ns, count(*) AS spans, count(DISTINCT service) AS services, max(name) FILTER (WHERE parent_id IS NULL) AS root_name, bool_or(error) AS failed FROM spans GROUP BY trace_id HAVING bool_or(error)", "spans"))
def _(spark, sf):
    return T.trace_summary(V.spans(spark, sf), failed=True)


@query("c02_trace_detail", V.sql(
    "SELECT s.trace_id, tree_size, first_service, coalesce(x.n, 0) AS exceptions, coalesce(l.n, 0) AS logs FROM (SELECT trace_id, count(*) AS tree_size, min_by(service, span_id) AS first_service FROM spans GROUP BY trace_id) s LEFT JOIN (SELECT event_id AS trace_id, count(*) AS n FROM exc GROUP BY ALL) x USING (trace_id) LEFT JOIN (SELECT service AS trace_id, count(*) AS n FROM logs GROUP BY ALL) l USING (trace_id)", "spans", "exc", "logs"))
def _(spark, sf):
    d = T.trace_detail(V.spans(spark, sf), V.exceptions(spark, sf).withColumn("trace_id", F.col("event_id")), V.logs(spark, sf).withColumn("trace_id", F.col("service")))
    return d.select("trace_id", F.size("tree").alias("tree_size"), F.col("tree")[0]["service"].alias("first_service"), "exceptions", "logs")


@query("c02_trace_events", V.sql("SELECT trace_id, 'span' AS kind, CAST(span_id AS BIGINT) AS id, ts, name AS text FROM spans UNION ALL SELECT event_id, 'exception', event_id, ts, message FROM exc UNION ALL SELECT service, 'log', event_id, ts, body FROM logs", "spans", "exc", "logs"))
def _(spark, sf):
    return T.trace_events(V.spans(spark, sf), V.exceptions(spark, sf).withColumn("trace_id", F.col("event_id")), V.logs(spark, sf).withColumn("trace_id", F.col("service")))


@query("c03_services", V.sql(f"SELECT service, count(*) AS spans, {ERR} AS errors, round({ERR} / count(*), 6) AS error_rate, round(avg(duration_ns) / 1000000, 9) AS avg_ms, {P(0.5)} AS p50_ms, {P(0.99)} AS p99_ms FROM spans GROUP BY service", "spans"))
def _(spark, sf):
    return T.services(V.spans(spark, sf), exact=True)


TOPO = {"topo": f"SELECT p.service AS caller, c.service AS callee, count(*) AS calls, count(*) FILTER (WHERE c.error) AS errors, round(quantile_cont(c.duration_ns, 0.5) / 1000000, 6) AS p50_ms FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_id = p.span_id WHERE c.service <> p.service GROUP BY ALL"}


@query("c04_topology", V.sql("SELECT * FROM topo", "spans", **TOPO))
def _(spark, sf):
    return T.topology(V.spans(spark, sf), exact=True)


@query("c05_service_detail", V.sql(f"SELECT service, count(*) AS spans, {P(0.5)} AS p50_ms, {P(0.9)} AS p90_ms, {P(0.99)} AS p99_ms, round((count(*) FILTER (WHERE duration_ns <= 3000000000) + 0.5 * count(*) FILTER (WHERE duration_ns > 3000000000 AND duration_ns <= 8000000000)) / count(*), 6) AS apdex FROM spans GROUP BY service", "spans"))
def _(spark, sf):
    return T.service_detail(V.spans(spark, sf), 3000, 8000, exact=True)


@query("c05_top_operations", V.sql(f"SELECT *, row_number() OVER (PARTITION BY service ORDER BY calls DESC, name, route) AS place FROM (SELECT service, name, route, count(*) AS calls, {ERR} AS errors FROM spans GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY service ORDER BY calls DESC, name, route) <= 5", "spans"))
def _(spark, sf):
    return T.top_operations(V.spans(spark, sf), 5)


@query("c05_peers", V.sql("SELECT callee AS service, 'upstream' AS direction, caller AS peer, calls FROM topo UNION ALL SELECT caller, 'downstream', callee, calls FROM topo", "spans", **TOPO))
def _(spark, sf):
    return T.peers(V.spans(spark, sf))


def versions_sql(by: str = "") -> str:
    return f"SELECT version{by}, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS requests, {ERR} AS errors, round({ERR} * 100.0 / count(*), 6) AS error_pct, round(count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 1), 9) AS rps, {P(0.5)} AS p50_ms, {P(0.9)} AS p90_ms, {P(0.99)} AS p99_ms FROM spans GROUP BY version{by}"


@query("c06_compare_versions", V.sql("SELECT a.name, a.requests AS requests_a, a.errors AS errors_a, a.error_pct AS error_pct_a, a.p50_ms AS p50_ms_a, a.p99_ms AS p99_ms_a, b.requests AS requests_b, b.errors AS errors_b, b.error_pct AS error_pct_b, b.p50_ms AS p50_ms_b, b.p99_ms AS p99_ms_b FROM (SELECT * FROM v WHERE version = '1996-03') a JOIN (SELECT * FROM v WHERE version = '1996-04') b USING (name)", "spans", v=versions_sql(", name")))
def _(spark, sf):
    return T.compare_versions(V.spans(spark, sf), "1996-03", "1996-04", "name", exact=True)


@query("c07_version_series", V.sql(f"SELECT version, date_trunc('month', ts) AS bucket, count(*) AS requests, {ERR} AS errors, round({ERR} / count(*), 6) AS error_rate, round(count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 1), 9) AS rps FROM spans GROUP BY ALL", "spans"))
def _(spark, sf):
    return T.version_series(V.spans(spark, sf))


@query("c08_between_deployments", V.sql("SELECT * FROM (SELECT service, version, first_seen, lag(version) OVER s AS previous, CAST(epoch(first_seen) - epoch(lag(first_seen) OVER s) AS BIGINT) AS seconds FROM (SELECT service, version, min(ts) AS first_seen FROM spans GROUP BY ALL) WINDOW s AS (PARTITION BY service ORDER BY first_seen, version)) WHERE previous IS NOT NULL", "spans"))
def _(spark, sf):
    return T.between_deployments(V.spans(spark, sf))


@query("c09_faulty_deployments", V.sql(
    "SELECT service, version, first_seen, requests, errors, error_pct, previous, previous_pct, rise_pct, CASE WHEN rise_pct > 500 THEN 'critical' WHEN rise_pct > 200 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT *, round(CASE WHEN previous_pct > 0 THEN (error_pct - previous_pct) / previous_pct * 100 ELSE 100 END, 4) AS rise_pct FROM (SELECT service, version, first_seen, requests, errors, error_pct, lag(version) OVER s AS previous, lag(error_pct) OVER s AS previous_pct FROM v WINDOW s AS (PARTITION BY service ORDER BY first_seen, version)) WHERE previous IS NOT NULL AND error_pct >= 1 AND ((previous_pct > 0 AND error_pct >= previous_pct * 1.1) OR previous_pct < 0.1))",
    "spans", v=versions_sql(", service")))
def _(spark, sf):
    return T.faulty_deployments(V.spans(spark, sf))


@query("c10_versions", V.sql(versions_sql(), "spans"))
def _(spark, sf):
    return T.versions(V.spans(spark, sf), exact=True)


@query("c11_endpoints", V.sql(
    f"SELECT * FROM (SELECT name, route, count(*) AS requests, round({ERR} / count(*), 6) AS error_rate, round(avg(duration_ns) / 1000000, 9) AS avg_ms, {P(0.99)} AS p99_ms FROM spans GROUP BY ALL) JOIN (SELECT name, route, string_agg(CAST(n AS VARCHAR), ',' ORDER BY bucket) AS trend FROM (SELECT name, route, date_trunc('quarter', ts) AS bucket, count(*) AS n FROM spans GROUP BY ALL) GROUP BY ALL) USING (name, route)", "spans"))
def _(spark, sf):
    return T.endpoints(V.spans(spark, sf), exact=True).withColumn("trend", F.array_join(F.col("trend").cast("array<string>"), ","))


@query("c12_errors_by_code", V.sql("SELECT name, route, code, count(*) AS errors, max(ts) AS last_seen FROM spans WHERE error GROUP BY ALL", "spans"))
def _(spark, sf):
    return T.errors_by_code(V.spans(spark, sf))


GROUPS = "SELECT fp, max_by(event_id, (ts, event_id)) AS event_id, max_by(status, (ts, event_id)) AS status, max_by(message, (ts, event_id)) AS message, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM exc GROUP BY fp"


@query("c13_exception_groups", V.sql(GROUPS, "exc"))
def _(spark, sf):
    return T.exception_groups(V.exceptions(spark, sf))


@query("c14_status_counts", V.sql("SELECT status, count(*) AS groups, CAST(sum(n) AS BIGINT) AS events FROM g GROUP BY status", "exc", g=GROUPS))
def _(spark, sf):
    return T.status_counts(V.exceptions(spark, sf))


@query("c15_navigation", V.sql("SELECT fp, event_id, lag(event_id) OVER s AS previous_id, lead(event_id) OVER s AS next_id FROM exc WINDOW s AS (PARTITION BY fp ORDER BY ts, event_id)", "exc"))
def _(spark, sf):
    return T.navigation(V.exceptions(spark, sf))


@query("c16_error_history", V.sql("SELECT date_trunc('hour', ts) AS bucket, count(*) AS n, count(DISTINCT fp) AS groups FROM exc GROUP BY ALL", "exc"))
def _(spark, sf):
    return T.history(V.exceptions(spark, sf), "hour", n=F.count("*"), groups=F.countDistinct("fp"))


@query("c16_group_history", V.sql("SELECT date_trunc('day', ts) AS bucket, fp, count(*) AS n FROM exc GROUP BY ALL", "exc"))
def _(spark, sf):
    return T.history(V.exceptions(spark, sf), "day", "fp")


@query("c16_latency_history", V.sql(f"SELECT date_trunc('month', ts) AS bucket, service, count(*) AS n, round(avg(duration_ns) / 1000000, 9) AS avg_ms, {P(0.95)} AS p95_ms FROM spans GROUP BY ALL", "spans"))
def _(spark, sf):
    return T.history(V.spans(spark, sf), "month", "service", n=F.count("*"), avg_ms=F.round(F.avg("duration_ns") / T.NS_PER_MS, 9), p95_ms=T.millis(0.95, exact=True))


@query("c16_trace_history", V.sql("SELECT date_trunc('month', started) AS bucket, count(*) AS n, round(avg(length_ns) / 1000000, 1) AS avg_ms, max(length_ns) AS longest_ns FROM (SELECT trace_id, min(ts) AS started, max(epoch_us(ts) * 1000 + duration_ns) - min(epoch_us(ts) * 1000) AS length_ns FROM spans GROUP BY trace_id) GROUP BY ALL", "spans"))
def _(spark, sf):
    t = T.trace_summary(V.spans(spark, sf)).withColumnRenamed("started", "ts")
    return T.history(t, "month", n=F.count("*"), avg_ms=F.round(F.avg("length_ns") / T.NS_PER_MS, 1), longest_ns=F.max("length_ns"))


FRAMES = "own"


@query("c17_exception_fingerprint", V.sql("SELECT user_id % 3 AS kind_no, k % 4 AS frame_no, count(*) AS n, CAST(1 AS BIGINT) AS fingerprints FROM ev WHERE event_type = 'error' GROUP BY ALL", "ev"))
def _(spark, sf):
    e = V.event_rows(spark, sf).where("event_type = 'error'").select("k", F.pmod("user_id", F.lit(3)).alias("kind_no"), F.pmod("k", F.lit(4)).alias("frame_no"), "value", "event_id")
    kind = F.element_at(F.array(F.lit("KeyError"), F.lit("Exception"), F.lit("ValueError")), (F.col("kind_no") + 1).cast("int"))
    frame = lambda f, g: F.struct(f.alias("file"), g.alias("function"))
    own = frame(F.concat(F.lit("/home/app"), F.col("event_id").cast("string"), F.lit("/f"), F.col("frame_no").cast("string"), F.lit(".py")), F.concat(F.lit("run(x"), F.col("event_id").cast("string"), F.lit(")")))
    lib = frame(F.concat(F.lit("/usr/lib/x"), F.col("event_id").cast("string")), F.lit("call"))
    fp = T.exception_fingerprint(kind, F.concat(F.lit("no row "), F.col("event_id").cast("string")), F.array(own, lib))
    return e.withColumn("fp", fp).groupBy("kind_no", "frame_no").agg(F.count("*").alias("n"), F.countDistinct("fp").alias("fingerprints"))


@query("c18_incidents", V.sql("SELECT fp, min(ts) AS first_seen, max(ts) AS last_seen, count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12') AS inside FROM exc GROUP BY fp HAVING count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12') > 0", "exc"))
def _(spark, sf):
    return T.incidents(V.exceptions(spark, sf), "2024-01-10", "2024-01-12")


INCIDENTS = "SELECT fp, max(ts) AS last_seen FROM exc GROUP BY fp HAVING count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12') > 0"


@query("c18_incident_context", V.sql("SELECT DISTINCT i.fp, l.event_id AS id FROM i JOIN logs l ON abs(l.ms - epoch_us(i.last_seen) // 1000) <= 600000", "exc", "logs", i=INCIDENTS))
def _(spark, sf):
    i = T.incidents(V.exceptions(spark, sf), "2024-01-10", "2024-01-12")
    return T.incident_context(i, V.logs(spark, sf).withColumnRenamed("event_id", "id"), 600_000)


@query("c18_incident_timeline", V.sql(
    "SELECT DISTINCT fp, kind, id, ms - epoch_us(last_seen) // 1000 AS offset_ms FROM i JOIN (SELECT 'exceptions' AS kind, event_id::VARCHAR AS id, ms FROM exc UNION ALL SELECT 'logs', event_id::VARCHAR, ms FROM logs UNION ALL SELECT 'traces', session::VARCHAR, min(ms) FROM llm GROUP BY session) s ON abs(ms - epoch_us(last_seen) // 1000) <= 3600000", "exc", "logs", "llm", i=INCIDENTS))
def _(spark, sf):
    x = V.exceptions(spark, sf)
    traces = V.llm_requests(spark, sf).groupBy(F.col("session").alias("id")).agg(F.min("ms").alias("ms"))
    return T.incident_timeline(T.incidents(x, "2024-01-10", "2024-01-12"), V.HOUR, exceptions=x.withColumnRenamed("event_id", "id"), logs=V.logs(spark, sf).withColumnRenamed("event_id", "id"), traces=traces)


@query("c19_search_service", V.sql("SELECT event_id, ts, body FROM logs WHERE contains(lower(body), 'click') AND service = 3 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25 12:00:00'", "logs"))
def _(spark, sf):
    return T.search_logs(V.logs(spark, sf), ["Click"], service=3, start="2024-01-05", end="2024-01-25 12:00:00").select("event_id", "ts", "body")


@query("c19_search_logs", V.sql("SELECT event_id, ts, body FROM logs WHERE contains(lower(body), 'error') AND contains(lower(body), '9') AND severity = 'ERROR' ORDER BY ts DESC, event_id DESC LIMIT 200", "logs"))
def _(spark, sf):
    return T.search_logs(V.logs(spark, sf), ["ERROR", "9"], "ERROR", limit=200).select("event_id", "ts", "body")


@query("c20_log_context", V.sql(
    "SELECT t.event_id AS target_id, o.n + (SELECT count(*) FROM logs l WHERE l.ms BETWEEN t.ms - 600000 AND t.ms + 600000 AND l.service <> t.service) AS n FROM logs t JOIN (SELECT service, count(*) AS n FROM logs GROUP BY ALL) o USING (service) WHERE t.event_id % 20 = 0", "logs"))
def _(spark, sf):
    logs = V.logs(spark, sf).withColumn("trace", F.col("service"))
    targets = logs.where("event_id % 20 = 0").select(F.col("event_id").alias("target_id"), F.col("ms").alias("target_ms"), "trace")
    return T.log_context_sizes(targets, logs, 600_000)


@query("c20_log_context_rows", V.sql(
    "SELECT t.event_id AS target_id, l.event_id FROM logs t JOIN logs l ON l.trace = t.trace AND l.service = t.service OR l.ms BETWEEN t.ms - 600000 AND t.ms + 600000 WHERE t.event_id % 20 = 0", "logs"))
def _(spark, sf):
    logs = V.logs(spark, sf).withColumn("trace", F.struct("trace", "service"))
    targets = logs.where("event_id % 20 = 0").select(F.col("event_id").alias("target_id"), F.col("ms").alias("target_ms"), "trace")
    return T.log_context(targets, logs, 600_000)


@query("c20_nearest_logs", V.sql(
    f"""SELECT target_id, id, offset_ms, place::INTEGER AS place FROM (SELECT *, CASE WHEN offset_ms < 0 THEN -row_number() OVER (PARTITION BY target_id, offset_ms < 0 ORDER BY offset_ms DESC, id DESC) ELSE row_number() OVER (PARTITION BY target_id, offset_ms < 0 ORDER BY offset_ms, id) END AS place
      FROM (SELECT t.event_id AS target_id, l.event_id AS id, l.ms - t.ms AS offset_ms FROM logs t JOIN logs l ON l.event_id <> t.event_id AND abs(l.ms - t.ms) <= {6 * V.HOUR} WHERE t.event_id % 20 = 0)) WHERE abs(place) <= 5""", "logs"))
def _(spark, sf):
    logs = V.logs(spark, sf).withColumnRenamed("event_id", "id")
    targets = logs.where("id % 20 = 0").select(F.col("id").alias("target_id"), F.col("ms").alias("target_ms"))
    return T.nearest_in_time(targets, logs, 5, 6 * V.HOUR)


@query("c21_unified_feed", V.sql(
    "SELECT * FROM (SELECT 'exceptions' AS kind, ts, event_id AS id, message AS text FROM exc UNION ALL SELECT 'logs', ts, event_id, body FROM logs UNION ALL SELECT 'flags', ts, event_id, 'flag ' || user_id FROM ev WHERE event_type = 'signup') ORDER BY ts DESC, kind, id LIMIT 100", "exc", "logs"))
def _(spark, sf):
    e = V.event_rows(spark, sf).where("event_type = 'signup'")
    return T.unified_feed(
        100, exceptions=V.exceptions(spark, sf).select("ts", F.col("event_id").alias("id"), F.col("message").alias("text")), logs=V.logs(spark, sf).select("ts", F.col("event_id").alias("id"), F.col("body").alias("text")),
        flags=e.select("ts", F.col("event_id").alias("id"), F.concat(F.lit("flag "), F.col("user_id").cast("string")).alias("text")),
    )


@query("c22_attribute_keys", V.sql("SELECT 'k' AS attribute, count(*) AS rows_with, count(DISTINCT k) AS distinct_values FROM ev UNION ALL SELECT 'type', count(*), count(DISTINCT event_type) FROM ev", "ev"))
def _(spark, sf):
    e = V.event_rows(spark, sf)
    return T.attribute_keys(e.select(F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("type"), F.col("event_type")).alias("attributes")))


@query("c22_attribute_values", V.sql("SELECT CAST(k AS VARCHAR) AS attribute_value, count(*) AS rows_with FROM ev GROUP BY ALL ORDER BY rows_with DESC, attribute_value LIMIT 25", "ev"))
def _(spark, sf):
    e = V.event_rows(spark, sf)
    return T.attribute_values(e.select(F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("type"), F.col("event_type")).alias("attributes")), "k", 25)


@query("c23_discovered_services", V.sql("SELECT service, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS rows, max(CASE WHEN route < 5 THEN 1 ELSE 0 END) AS has_http, max(CASE WHEN route BETWEEN 5 AND 9 THEN 1 ELSE 0 END) AS has_db, max(CASE WHEN route BETWEEN 10 AND 12 THEN 1 ELSE 0 END) AS has_rpc, max(CASE WHEN route > 17 THEN 1 ELSE 0 END) AS has_messaging FROM spans GROUP BY service", "spans"))
def _(spark, sf):
    r = F.col("route")
    return T.discovered_services(V.spans(spark, sf), has_http=r < 5, has_db=r.between(5, 9), has_rpc=r.between(10, 12), has_messaging=r > 17)


@query("c23_discovered_sources", V.sql("SELECT 'metrics' AS source, 'u' || user_id AS service, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS rows FROM ev GROUP BY ALL UNION ALL SELECT 'games', o_orderpriority, min(o_orderdate), max(o_orderdate), count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL", "ev"))
def _(spark, sf):
    samples = V.gauge(spark, sf).select(F.element_at("labels", "uid").alias("service"), F.timestamp_millis("unix_milli").alias("ms_ts"), F.col("seq").alias("event_id"))
    e = V.event_rows(spark, sf).select("event_id", "ts")
    metrics = T.discovered_services(samples.join(e, "event_id").select("service", "ts")).withColumn("source", F.lit("metrics"))
    games = T.discovered_services(sessions(spark, sf).withColumnRenamed("platform", "service")).withColumn("source", F.lit("games"))
    return metrics.unionByName(games).select("source", "service", "first_seen", "last_seen", "rows")


@query("c24_change_impact", V.sql("SELECT c.event_id AS target_id, count(*) FILTER (WHERE x.ms < c.ms) AS before, count(*) FILTER (WHERE x.ms >= c.ms) AS after FROM ev c LEFT JOIN exc x ON abs(x.ms - c.ms) <= 3600000 WHERE c.event_type = 'signup' GROUP BY c.event_id", "exc"))
def _(spark, sf):
    changes = V.event_rows(spark, sf).where("event_type = 'signup'").select(F.col("event_id").alias("target_id"), F.col("ms").alias("target_ms"))
    return T.change_impact(changes, V.exceptions(spark, sf), 3_600_000)


@query("c25_widget", V.sql("SELECT event_type, date_trunc('day', ts) AS bucket, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.9), 6) AS p90, count(*) FILTER (WHERE value > 100) AS large, count(DISTINCT user_id) AS users FROM ev WHERE value > 1 GROUP BY ALL", "ev"))
def _(spark, sf):
    out = T.widget(V.event_rows(spark, sf), {
        "where": "value > 1", "interval": "1 day", "group_by": ["event_type"], "select": [
            {"fn": "count", "alias": "n"}, {"expr": "round(avg(value), 6)", "alias": "mean"}, {"fn": "quantile", "column": "value", "q": 0.9, "exact": True, "alias": "p90"}, {"fn": "countIf", "where": "value > 100", "alias": "large"}, {"fn": "uniq", "column": "user_id", "alias": "users"}],
    })
    return out.withColumn("p90", F.round("p90", 6))


def profiles(spark, sf) -> DataFrame:
    p = V.table(spark, sf, "part")
    return p.select(F.timestamp_millis(F.lit(V.T0) + F.col("p_partkey") % 2880 * 60_000).alias("ts"), F.col("p_brand").alias("profile"), F.split(F.concat_ws(" ", "p_type", "p_name"), " ").alias("stack"), F.col("p_size").cast("bigint").alias("value"))


PROF = {"prof": "SELECT p_brand AS profile, string_split(p_type || ' ' || p_name, ' ') AS stack, CAST(p_size AS BIGINT) AS value, make_timestamp((%d + p_partkey %% 2880 * 60000) * 1000) AS ts FROM part" % V.T0}
FLAME = {**PROF, "flame": "SELECT profile, array_to_string(stack[1:i], ';') AS path, sum(value)::BIGINT AS value FROM (SELECT *, unnest(range(1, len(stack) + 1)) AS i FROM prof) GROUP BY ALL"}


@query("c26_top_functions", V.sql("SELECT fn AS function, CAST(sum(s) AS BIGINT) AS self, CAST(sum(t) AS BIGINT) AS total FROM (SELECT stack[-1] AS fn, value AS s, 0 AS t FROM prof UNION ALL SELECT unnest(list_distinct(stack)), 0, value FROM prof) GROUP BY fn ORDER BY self DESC, function LIMIT 20", **PROF))
def _(spark, sf):
    return T.top_functions(profiles(spark, sf), 20)


@query("c26_function_series", V.sql("SELECT fn AS function, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, CAST(sum(value) AS BIGINT) AS total, count(*) AS stacks FROM (SELECT unnest(list_distinct(stack)) AS fn, value, ts FROM prof) JOIN (SELECT fn FROM (SELECT stack[-1] AS fn, value AS self FROM prof UNION ALL SELECT unnest(stack), 0 FROM prof) GROUP BY fn ORDER BY sum(self) DESC, fn LIMIT 10) USING (fn) GROUP BY ALL", **PROF))
def _(spark, sf):
    return T.function_series(profiles(spark, sf), 10)


@query("c27_flame_graph", V.sql("SELECT * FROM flame", **FLAME))
def _(spark, sf):
    return T.flame_graph(profiles(spark, sf), "profile")


@query("c28_flame_diff", V.sql("SELECT path, coalesce(a.value, 0) AS value_a, coalesce(b.value, 0) AS value_b, coalesce(b.value, 0) - coalesce(a.value, 0) AS diff FROM (SELECT path, value FROM flame WHERE profile = 'Brand#2') a FULL JOIN (SELECT path, value FROM flame WHERE profile = 'Brand#17') b USING (path)", **FLAME))
def _(spark, sf):
    p = profiles(spark, sf)
    return T.flame_diff(p.where("profile = 'Brand#2'"), p.where("profile = 'Brand#17'"))


@query("c29_profile_versions", V.sql("SELECT profile, total, round((total - previous) * 100.0 / previous, 6) AS change_pct FROM (SELECT *, lag(total) OVER (ORDER BY profile) AS previous FROM (SELECT profile, CAST(sum(value) AS BIGINT) AS total FROM prof GROUP BY profile)) WHERE previous IS NOT NULL", **PROF))
def _(spark, sf):
    v = profiles(spark, sf).groupBy("profile").agg(F.sum("value").alias("total"))
    v = v.withColumn("previous", F.lag("total").over(Window.orderBy("profile"))).where("previous is not null")  # a row a version
    return v.select("profile", "total", F.round(T.percent_change(F.col("total"), F.col("previous")), 6).alias("change_pct"))


def infra(spark, sf) -> DataFrame:
    e = V.event_rows(spark, sf)
    pod = F.concat(F.lit("svc-"), F.pmod("k", F.lit(5)).cast("string"), F.lit("-rs-"), F.col("user_id").cast("string"))
    return e.groupBy(F.date_trunc("minute", "ts").alias("minute"), pod.alias("pod"), F.concat(F.lit("node-"), F.pmod("user_id", F.lit(4)).cast("string")).alias("node"), F.col("event_type").alias("metric")).agg(
        F.sum("cents").alias("value_sum"), F.count("*").alias("value_count"), F.min("cents").alias("value_min"), F.max("cents").alias("value_max"),
    )


INFRA = {"infra": "SELECT date_trunc('minute', ts) AS minute, 'svc-' || (k % 5) || '-rs-' || user_id AS pod, 'node-' || (user_id % 4) AS node, event_type AS metric, sum(cents)::BIGINT AS value_sum, count(*) AS value_count, min(cents) AS value_min, max(cents) AS value_max FROM ev GROUP BY ALL"}
MEAN = lambda m: f"sum(value_sum) FILTER (WHERE metric = '{m}') / sum(value_count) FILTER (WHERE metric = '{m}')"


@query("e04_infra_minutes", V.sql("SELECT * FROM infra", "ev", **INFRA))
def _(spark, sf):
    return infra(spark, sf)


@query("c30_infra_summary", V.sql(f"SELECT round(avg(used) / avg(cap) * 100, 6) AS cpu_pct, count(*) AS nodes FROM (SELECT node, {MEAN('click')} AS used, {MEAN('view')} AS cap FROM infra GROUP BY node)", "ev", **INFRA))
def _(spark, sf):
    nodes = infra(spark, sf).groupBy("node").agg(T.mean_of("click").alias("used"), T.mean_of("view").alias("cap"))
    return nodes.agg(F.round(F.try_divide(F.avg("used"), F.avg("cap")) * 100, 6).alias("cpu_pct"), F.count("*").alias("nodes"))


@query("c31_pods", V.sql(f"SELECT pod, node, round({MEAN('click')}, 4) AS cpu, round({MEAN('view')}, 4) AS memory, max(value_max) FILTER (WHERE metric = 'purchase') AS peak, count(DISTINCT metric) AS metrics FROM infra GROUP BY ALL", "ev", **INFRA))
def _(spark, sf):
    return infra(spark, sf).groupBy("pod", "node").agg(F.round(T.mean_of("click"), 4).alias("cpu"), F.round(T.mean_of("view"), 4).alias("memory"), F.max(F.when(F.col("metric") == "purchase", F.col("value_max"))).alias("peak"), F.countDistinct("metric").alias("metrics"))


@query("c31_nodes", V.sql(f"SELECT node, round({MEAN('click')}, 4) AS cpu, round({MEAN('view')}, 4) AS memory, count(DISTINCT pod) AS pods, max(minute) AS last_seen FROM infra GROUP BY ALL", "ev", **INFRA))
def _(spark, sf):
    return infra(spark, sf).groupBy("node").agg(F.round(T.mean_of("click"), 4).alias("cpu"), F.round(T.mean_of("view"), 4).alias("memory"), F.countDistinct("pod").alias("pods"), F.max("minute").alias("last_seen"))


@query("c31_pod_detail", V.sql("SELECT pod, metric, date_trunc('hour', minute) AS bucket, round(sum(value_sum) / sum(value_count), 4) AS mean, max(value_max) AS peak FROM infra GROUP BY ALL", "ev", **INFRA))
def _(spark, sf):
    rows = infra(spark, sf).groupBy("pod", "metric", F.date_trunc("hour", "minute").alias("bucket"))
    return rows.agg(F.round(F.sum("value_sum") / F.sum("value_count"), 4).alias("mean"), F.max("value_max").alias("peak"))


@query("c31_node_detail", V.sql(f"SELECT node, date_trunc('hour', minute) AS bucket, round({MEAN('click')}, 4) AS cpu, round({MEAN('view')}, 4) AS memory, max(value_max) FILTER (WHERE metric = 'purchase') AS peak, count(DISTINCT pod) AS pods, max_by(pod, (value_max, pod)) FILTER (WHERE metric = 'click') AS busiest FROM infra GROUP BY ALL", "ev", **INFRA))
def _(spark, sf):
    rows = infra(spark, sf).groupBy("node", F.date_trunc("hour", "minute").alias("bucket"))
    busiest = F.max(F.when(F.col("metric") == "click", F.struct("value_max", "pod")))["pod"]
    return rows.agg(F.round(T.mean_of("click"), 4).alias("cpu"), F.round(T.mean_of("view"), 4).alias("memory"), F.max(F.when(F.col("metric") == "purchase", F.col("value_max"))).alias("peak"), F.countDistinct("pod").alias("pods"), busiest.alias("busiest"))


@query("c32_workloads", V.sql("SELECT regexp_replace(pod, '-[^-]*-[^-]*$', '') AS workload, count(DISTINCT pod) AS pods, count(DISTINCT node) AS nodes FROM infra GROUP BY ALL", "ev", **INFRA))
def _(spark, sf):
    return infra(spark, sf).groupBy(T.workload("pod").alias("workload")).agg(F.countDistinct("pod").alias("pods"), F.countDistinct("node").alias("nodes"))


def sessions(spark, sf) -> DataFrame:
    """An order is a session, its customer a player in a nation, its line items' suppliers the servers."""
    o, c, n = V.table(spark, sf, "orders"), V.table(spark, sf, "customer"), V.table(spark, sf, "nation")
    named = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("country"), F.col("n_regionkey").alias("region"))
    return o.join(named, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("player"), "country", "region", F.col("o_orderpriority").alias("platform"), (F.col("o_orderstatus") == "F").alias("crashed"), (F.col("o_orderstatus") == "P").alias("abandoned"),
        F.col("o_orderdate").alias("ts"), (F.round(F.col("o_totalprice")).cast("bigint") % 400).alias("rtt_ms"),
    )


SESS = {"sess": "SELECT o_orderkey AS session_id, o_custkey AS player, n_name AS country, n_regionkey AS region, o_orderpriority AS platform, o_orderstatus = 'F' AS crashed, o_orderstatus = 'P' AS abandoned, o_orderdate AS ts, CAST(round(o_totalprice) AS BIGINT) % 400 AS rtt_ms FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"}
SERVERS = {**SESS, "pair": "SELECT DISTINCT session_id, player, region AS client_region, n_regionkey AS server_region, rtt_ms FROM sess JOIN lineitem ON session_id = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"}


def session_servers(spark, sf) -> DataFrame:
    li, su, n = (V.table(spark, sf, t) for t in ("lineitem", "supplier", "nation"))
    server = su.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("server_region"))
    pairs = li.select(F.col("l_orderkey").alias("session_id"), "l_suppkey").join(server, F.col("l_suppkey") == F.col("s_suppkey")).select("session_id", "server_region").distinct()
    return sessions(spark, sf).select("session_id", "player", F.col("region").alias("client_region"), "rtt_ms").join(pairs, "session_id")


@query("c33_geographic_latency", V.sql("SELECT country, count(*) AS sessions, round(avg(rtt_ms), 6) AS avg_ms, round(quantile_cont(rtt_ms, 0.95), 6) AS p95_ms FROM sess GROUP BY country", **SESS))
def _(spark, sf):
    return sessions(spark, sf).groupBy("country").agg(F.count("*").alias("sessions"), F.round(F.avg("rtt_ms"), 6).alias("avg_ms"), F.round(F.percentile("rtt_ms", F.lit(0.95)), 6).alias("p95_ms"))


@query("c34_latency_map", V.sql("SELECT client_region, server_region, count(DISTINCT player) AS players, round(avg(rtt_ms), 6) AS avg_ms FROM pair GROUP BY ALL HAVING count(DISTINCT player) >= 10", **SERVERS))
def _(spark, sf):
    return session_servers(spark, sf).groupBy("client_region", "server_region").agg(F.countDistinct("player").alias("players"), F.round(F.avg("rtt_ms"), 6).alias("avg_ms")).where("players >= 10")


@query("c35_game_summary", V.sql("SELECT platform, region, count(*) AS sessions, count(DISTINCT player) AS players, round(count(*) FILTER (WHERE crashed) / count(*), 6) AS crash_rate, round(count(*) FILTER (WHERE abandoned) / count(*), 6) AS abandon_rate FROM sess GROUP BY GROUPING SETS ((platform), (region), ())", **SESS))
def _(spark, sf):
    s = sessions(spark, sf)
    return s.groupingSets([["platform"], ["region"], []], "platform", "region").agg(F.count("*").alias("sessions"), F.countDistinct("player").alias("players"), F.round(F.count_if("crashed") / F.count("*"), 6).alias("crash_rate"), F.round(F.count_if("abandoned") / F.count("*"), 6).alias("abandon_rate"))


QUALITY_IN = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 1.4 AS avg_fps, l_quantity * 0.8 AS min_fps, l_tax * 500 + 10 AS frame_ms, l_discount * 2500 AS rtt_ms, l_tax * 800 AS jitter_ms, l_discount * 60 AS loss_pct, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS crashes FROM lineitem"
QUALITY_PARTS = """SELECT *, 0.7 * CASE WHEN avg_fps >= 60 THEN 100 WHEN avg_fps >= 30 THEN 50 + (avg_fps - 30) / 30 * 50 WHEN avg_fps >= 15 THEN (avg_fps - 15) / 15 * 50 ELSE 0 END
  + 0.3 * CASE WHEN min_fps >= 30 THEN 100 WHEN min_fps >= 15 THEN 50 + (min_fps - 15) / 15 * 50 ELSE min_fps / 15 * 50 END AS fps,
  0.8 * CASE WHEN rtt_ms <= 30 THEN 100 WHEN rtt_ms <= 100 THEN 100 - (rtt_ms - 30) / 70 * 50 WHEN rtt_ms <= 200 THEN 50 - (rtt_ms - 100) / 100 * 50 ELSE 0 END
  + 0.2 * CASE WHEN jitter_ms <= 5 THEN 100 WHEN jitter_ms <= 20 THEN 100 - (jitter_ms - 5) / 15 * 50 WHEN jitter_ms <= 50 THEN 50 - (jitter_ms - 20) / 30 * 50 ELSE 0 END AS latency,
  CASE WHEN crashes > 0 THEN 0 WHEN ratio <= 1.2 THEN 100 WHEN ratio <= 1.5 THEN 100 - (ratio - 1.2) / 0.3 * 30 WHEN ratio <= 2 THEN 70 - (ratio - 1.5) / 0.5 * 40 ELSE greatest(30 / ratio, 0) END AS stable,
  CASE WHEN loss_pct <= 0.5 THEN 100 WHEN loss_pct <= 2 THEN 100 - (loss_pct - 0.5) / 1.5 * 50 WHEN loss_pct <= 5 THEN 50 - (loss_pct - 2) / 3 * 50 ELSE 0 END AS network
  FROM (SELECT *, frame_ms / (1000.0 / greatest(avg_fps, 1)) AS ratio FROM q)"""


@query("c36_session_quality", V.sql("SELECT l_partkey % 50 AS bucket, count(*) AS sessions, round(avg(0.3 * fps + 0.25 * latency + 0.25 * stable + 0.2 * network), 4) AS quality FROM s GROUP BY ALL", q=QUALITY_IN, s=QUALITY_PARTS))
def _(spark, sf):
    li = V.table(spark, sf, "lineitem")
    s = li.select(
        (F.col("l_partkey") % 50).alias("bucket"), (F.col("l_quantity") * 1.4).alias("avg_fps"), (F.col("l_quantity") * 0.8).alias("min_fps"), (F.col("l_tax") * 500 + 10).alias("frame_ms"), (F.col("l_discount") * 2500).alias("rtt_ms"),
        (F.col("l_tax") * 800).alias("jitter_ms"), (F.col("l_discount") * 60).alias("loss_pct"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("crashes"),
    )
    return T.session_quality(s).groupBy("bucket").agg(F.count("*").alias("sessions"), F.round(F.avg("quality"), 4).alias("quality"))


@query("c37_uptime", V.sql(
    "SELECT check_name, CAST(sum(checks) AS BIGINT) AS checks, round(sum(ok) * 100.0 / sum(checks), 6) AS uptime_pct, round(sum(cents) / sum(checks) / 100.0, 4) AS avg_response, count(*) AS buckets FROM (SELECT o_orderpriority AS check_name, date_trunc('month', o_orderdate) AS bucket, count(*) AS checks, count(*) FILTER (WHERE o_orderstatus <> 'F') AS ok, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY ALL) GROUP BY check_name"))
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    hourly = o.groupBy(F.col("o_orderpriority").alias("check_name"), F.date_trunc("month", "o_orderdate").alias("bucket")).agg(F.count("*").alias("checks"), F.count_if(F.col("o_orderstatus") != "F").alias("ok"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
    return hourly.groupBy("check_name").agg(F.sum("checks").alias("checks"), F.round(F.sum("ok") * 100.0 / F.sum("checks"), 6).alias("uptime_pct"), F.round(F.sum("cents") / F.sum("checks") / 100.0, 4).alias("avg_response"), F.count("*").alias("buckets"))


TOOLS = "SELECT conv_id, turn, conv_id %% 25 AS token, make_timestamp((%d + conv_id * 600000 + turn * 60000) * 1000) AS ts, unnest(['tool' || (conv_id %% 4), 'tool' || (turn %% 6)]) AS tool, length(coalesce(text, '')) AS ms, (conv_id + turn) %% 9 = 0 AS failed FROM conversations" % V.T0


def tool_calls(spark, sf) -> DataFrame:
    c = V.table(spark, sf, "conversations")
    tools = F.array(F.concat(F.lit("tool"), (F.col("conv_id") % 4).cast("string")), F.concat(F.lit("tool"), (F.col("turn") % 6).cast("string")))
    return c.select(
        "conv_id", (F.col("conv_id") % 25).alias("token"), F.timestamp_millis(F.lit(V.T0) + F.col("conv_id") * 600_000 + F.col("turn") * 60_000).alias("ts"), F.explode(tools).alias("tool"),
        F.length(F.coalesce("text", F.lit(""))).alias("ms"), ((F.col("conv_id") + F.col("turn")) % 9 == 0).alias("failed"),
    )


@query("c38_tool_usage", V.sql("SELECT tool, count(*) AS calls, count(*) FILTER (WHERE failed) AS errors, round(quantile_cont(ms, 0.95), 6) AS p95_ms, count(DISTINCT conv_id) AS sessions FROM t GROUP BY tool", t=TOOLS))
def _(spark, sf):
    return tool_calls(spark, sf).groupBy("tool").agg(F.count("*").alias("calls"), F.count_if("failed").alias("errors"), F.round(F.percentile("ms", F.lit(0.95)), 6).alias("p95_ms"), F.countDistinct("conv_id").alias("sessions"))


@query("c38_tool_timeline", V.sql("SELECT tool, date_trunc('hour', ts) AS bucket, count(*) AS calls, count(*) FILTER (WHERE failed) AS errors FROM t GROUP BY ALL", t=TOOLS))
def _(spark, sf):
    return T.history(tool_calls(spark, sf), "hour", "tool", calls=F.count("*"), errors=F.count_if("failed"))


@query("c38_tool_tokens", V.sql("SELECT token, count(*) AS calls, count(DISTINCT tool) AS tools, max(ts) AS last_used FROM t GROUP BY ALL", t=TOOLS))
def _(spark, sf):
    return tool_calls(spark, sf).groupBy("token").agg(F.count("*").alias("calls"), F.countDistinct("tool").alias("tools"), F.max("ts").alias("last_used"))


@query("c39_hourly_rates", V.sql("SELECT date_trunc('hour', ts) AS bucket, count(DISTINCT fp) AS fingerprints, count(DISTINCT user_id) AS traces, count(*) AS events FROM exc GROUP BY ALL", "exc"))
def _(spark, sf):
    return T.history(V.exceptions(spark, sf), "hour", fingerprints=F.countDistinct("fp"), traces=F.countDistinct("user_id"), events=F.count("*"))


@query("c41_red_metrics", V.sql(f"SELECT service, name, route, count(*) AS requests, {ERR} AS errors, CAST(sum(duration_ns) AS BIGINT) AS total_ns, {', '.join(f'count(*) FILTER (WHERE duration_ns <= {b * 1000000}) AS le_{b}' for b in T.RED_BOUNDS_MS)} FROM spans GROUP BY ALL", "spans"))
def _(spark, sf):
    return T.red_metrics(V.spans(spark, sf))


@query("c44_exemplars", V.sql("SELECT service, trace_id, span_id, duration_ns, n FROM (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY service ORDER BY ts DESC, trace_id, span_id) <= 5) JOIN (SELECT trace_id, count(*) AS n FROM spans GROUP BY ALL) USING (trace_id)", "spans"))
def _(spark, sf):
    s = V.spans(spark, sf)
    latest = s.withColumn("r", F.row_number().over(Window.partitionBy("service").orderBy(F.desc("ts"), "trace_id", "span_id"))).where("r <= 5")
    return latest.join(s.groupBy("trace_id").agg(F.count("*").alias("n")), "trace_id").select("service", "trace_id", "span_id", "duration_ns", "n")


@query("c45_maintenance", V.sql(
    "SELECT event_id, ms FROM exc WHERE NOT (ts >= TIMESTAMP '2024-01-05 10:00:00' AND ts < TIMESTAMP '2024-01-06 10:00:00') AND NOT (hour(ts) = 3) AND NOT (isodow(ts) = 2 AND ts >= date_trunc('day', ts) + INTERVAL 20 HOUR AND ts < date_trunc('day', ts) + INTERVAL 22 HOUR) AND NOT (day(ts) = 15 AND hour(ts) < 6)", "exc"))
def _(spark, sf):
    rows = [("a", "once", "2024-01-05 10:00:00", 1440, None, None), ("b", "daily", "04:00:00", 60, None, "Europe/Berlin"), ("c", "weekly", "20:00:00", 120, [2], "UTC"), ("d", "monthly", "00:00:00", 360, [15], "UTC")]
    windows = spark.createDataFrame(rows, "window_id string, kind string, start string, minutes bigint, days array<int>, zone string")
    return T.unsuppressed(V.exceptions(spark, sf), T.occurrences(windows, "2023-12-31", "2024-01-31")).select("event_id", "ms")


@query("c46_latest_per_group", V.sql("SELECT fp, event_id, ts FROM exc QUALIFY row_number() OVER (PARTITION BY fp ORDER BY ts DESC, event_id DESC) <= 100", "exc"))
def _(spark, sf):
    return T.latest_per_group(V.exceptions(spark, sf)).select("fp", "event_id", "ts")


@query("c47_audit_page", V.sql("SELECT event_id, ts, event_type, count(*) OVER () AS total FROM ev WHERE event_type IN ('signup', 'purchase') AND user_id % 2 = 0 ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100", "ev"))
def _(spark, sf):
    hits = V.event_rows(spark, sf).where("event_type in ('signup', 'purchase') and user_id % 2 = 0").select("event_id", "ts", "event_type")
    total = hits.agg(F.count("*").alias("total"))  # one row
    return hits.orderBy(F.desc("ts"), "event_id").offset(100).limit(50).crossJoin(F.broadcast(total))


@query("e10_alerts", V.sql(
    "SELECT rule, eval_ms, state, state <> coalesce(lag(state) OVER (PARTITION BY rule ORDER BY eval_ms), 'OK') AS changed FROM (SELECT rule, eval_ms, coalesce(last_value(CASE WHEN value > 2 THEN 'ALERT' WHEN value IS NOT NULL THEN 'OK' END IGNORE NULLS) OVER (PARTITION BY rule ORDER BY eval_ms ROWS UNBOUNDED PRECEDING), 'OK') AS state FROM (SELECT fp AS rule, t AS eval_ms, n AS value FROM (SELECT DISTINCT fp FROM exc) CROSS JOIN (SELECT unnest(range(1704067200000, 1706659200000, 3600000)) AS t) LEFT JOIN (SELECT fp, ms - ms % 3600000 AS t, count(*) AS n FROM exc GROUP BY ALL) USING (fp, t)))", "exc"))
def _(spark, sf):
    x = V.exceptions(spark, sf)
    counts = x.groupBy("fp", (F.col("ms") - F.col("ms") % 3_600_000).alias("eval_ms")).agg(F.count("*").alias("value"))
    grid = x.select("fp").distinct().withColumn("eval_ms", F.explode(F.sequence(F.lit(V.T0), F.lit(V.T0 + 30 * V.DAY - V.HOUR), F.lit(V.HOUR))))
    values = grid.join(counts, ["fp", "eval_ms"], "left").withColumnRenamed("fp", "rule")
    return T.evaluate_alerts(values, "above", 2).select("rule", "eval_ms", "state", "changed")


ABSENT = f"""SELECT rule, eval_ms, value, CASE WHEN value > 2 THEN 'ALERT' WHEN value IS NOT NULL THEN 'OK' WHEN eval_ms - coalesce(max(CASE WHEN value IS NOT NULL THEN eval_ms END) OVER p, min(eval_ms) OVER p) >= {6 * V.HOUR} THEN 'ALERT' END AS s
  FROM (SELECT fp AS rule, t AS eval_ms, n AS value FROM (SELECT DISTINCT fp FROM exc) CROSS JOIN (SELECT unnest(range({V.T0}, {V.T0 + 30 * V.DAY}, {V.HOUR})) AS t) LEFT JOIN (SELECT fp, ms - ms % {V.HOUR} AS t, count(*) AS n FROM exc GROUP BY ALL) USING (fp, t)) WINDOW p AS (PARTITION BY rule ORDER BY eval_ms ROWS UNBOUNDED PRECEDING)"""
STATES = "SELECT rule, eval_ms, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY rule ORDER BY eval_ms ROWS UNBOUNDED PRECEDING), 'OK') AS state FROM raw"


def hourly_counts(spark, sf) -> DataFrame:
    """Errors of each group at each hour of the month, null where there are none."""
    x = V.exceptions(spark, sf)
    grid = x.select("fp").distinct().withColumn("eval_ms", F.explode(F.sequence(F.lit(V.T0), F.lit(V.T0 + 30 * V.DAY - V.HOUR), F.lit(V.HOUR))))
    return grid.join(T.alert_input(x, F.count("*"), V.HOUR, "fp"), ["fp", "eval_ms"], "left").withColumnRenamed("fp", "rule")


@query("e10_absent_alerts", V.sql("SELECT rule, eval_ms, state, state <> coalesce(lag(state) OVER (PARTITION BY rule ORDER BY eval_ms), 'OK') AS changed FROM st", "exc", raw=ABSENT, st=STATES))
def _(spark, sf):
    return T.evaluate_alerts(hourly_counts(spark, sf), "above", 2, absent_ms=6 * V.HOUR).select("rule", "eval_ms", "state", "changed")


@query("e10_fired_alerts", V.sql(
    f"""SELECT rule, eval_ms, state FROM ch WHERE changed AND state = 'OK' UNION ALL SELECT rule, eval_ms, 'ALERT' FROM fired""", "exc", raw=ABSENT, st=STATES,
    ch="SELECT *, state <> coalesce(lag(state) OVER (PARTITION BY rule ORDER BY eval_ms), 'OK') AS changed FROM st",
    runs="SELECT *, sum(changed::INT) OVER (PARTITION BY rule ORDER BY eval_ms) AS run FROM ch",
    # the grid is hourly, so a run fires again at each seventh evaluation
    fired=f"SELECT rule, eval_ms FROM (SELECT *, row_number() OVER (PARTITION BY rule, run ORDER BY eval_ms) AS k FROM runs WHERE state = 'ALERT') WHERE (k - 1) % 7 = 0"))
def _(spark, sf):
    return T.fired_alerts(T.evaluate_alerts(hourly_counts(spark, sf), "above", 2, absent_ms=6 * V.HOUR), reset_ms=6 * V.HOUR)


@query("e11_alert_inputs", V.sql(f"SELECT ms - ms % {V.DAY} AS eval_ms, CAST(count(*) FILTER (WHERE regexp_full_match(body, 'error.*9.*') OR contains(body, 'click')) AS DOUBLE) AS value FROM logs GROUP BY ALL", "logs"))
def _(spark, sf):
    return T.log_pattern_input(V.logs(spark, sf), ["error*9*", "*click*"], V.DAY)


@query("e11_metric_input", V.sql(f"SELECT metric, ms - ms % {V.HOUR} AS eval_ms, round(avg(value), 6) AS value FROM gauge GROUP BY ALL", "gauge"))
def _(spark, sf):
    rows = V.gauge(spark, sf).withColumnRenamed("unix_milli", "ms")
    return T.alert_input(rows, F.round(F.avg("value"), 6), V.HOUR, "metric")


@query("e11_expression_input", V.sql(f"SELECT t AS eval_ms, round(max(value), 6) AS value FROM (SELECT uid, t, max_by(value, (ms, value)) AS value FROM gauge JOIN (SELECT unnest(range({V.T0}, {V.T0 + 29 * V.DAY + 1}, {V.DAY})) AS t) ON ms BETWEEN t - {V.DAY} AND t WHERE metric = 'click' GROUP BY ALL) GROUP BY t", "gauge"))
def _(spark, sf):
    v = M.instant(M.select_series(V.gauge(spark, sf), "click"), Grid(V.T0, V.T0 + 29 * V.DAY, V.DAY), V.DAY)
    return T.vector_input(v).withColumn("value", F.round("value", 6))


@query("e11_llm_input", V.sql(f"SELECT model, ms - ms % {V.HOUR} AS eval_ms, round(count(*) FILTER (WHERE failed) * 100.0 / count(*), 6) AS error_rate, round(avg(latency_ms) FILTER (WHERE NOT failed), 6) AS latency_avg, CAST(sum(tokens) AS DOUBLE) AS token_usage, CAST(count(*) AS DOUBLE) AS request_count FROM llm GROUP BY ALL", "llm"))
def _(spark, sf):
    r = V.llm_requests(spark, sf)
    parts = [T.llm_input(r, m, V.HOUR, "model").withColumn("value", F.round("value", 6)).withColumnRenamed("value", m) for m in ("error_rate", "latency_avg", "token_usage", "request_count")]
    return reduce(lambda a, b: a.join(b, ["model", "eval_ms"]), parts)


@query("e11_llm_cost_and_p95", V.sql(f"SELECT model, ms - ms % {V.DAY} AS eval_ms, CAST(quantile_disc(latency_ms, 0.95) FILTER (WHERE NOT failed) AS DOUBLE) AS latency_p95, round(sum(tokens * 0.002), 6) AS cost_daily FROM llm GROUP BY ALL", "llm"))
def _(spark, sf):
    r = V.llm_requests(spark, sf).withColumn("cost", F.col("tokens") * F.lit("0.002").cast("decimal(10,6)"))
    p95 = T.llm_input(r, "latency_p95", V.DAY, "model").withColumn("value", F.col("value").cast("double")).withColumnRenamed("value", "latency_p95")
    return p95.join(T.llm_input(r, "cost_daily", V.DAY, "model").withColumn("value", F.round("value", 6)).withColumnRenamed("value", "cost_daily"), ["model", "eval_ms"])
