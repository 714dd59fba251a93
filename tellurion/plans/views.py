"""Inputs of each operator family, derived from the given tables: as DataFrames, and as SQL for the reference queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: 2024-01-01 UTC, in milliseconds. The events lie in the 30 days from it.
T0 = 1_704_067_200_000
HOUR = 3_600_000
DAY = 24 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Its timestamps have no zone; the session's zone is UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ms, cents (whole), k (from props) and day."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", "props", F.unix_millis("ts").alias("ms"), F.round(F.col("value") * 100).cast("bigint").alias("cents"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_date("ts").alias("day"),
    )


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir)
    labels = F.create_map(F.lit("uid"), F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return e.select(F.col("event_type").alias("metric"), labels.alias("labels"), F.col("ms").alias("unix_milli"), "value", F.col("event_id").alias("seq"))


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums per user and type that start anew each day."""
    e = event_rows(spark, sf_dir)
    w = Window.partitionBy("user_id", "event_type", "day").orderBy("ts", "event_id")
    labels = F.create_map(F.lit("uid"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("type"), F.col("event_type"))
    return e.select(F.lit("events_total").alias("metric"), labels.alias("labels"), F.col("ms").alias("unix_milli"), (F.sum("cents").over(w) / 100.0).alias("value"), F.col("event_id").alias("seq"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, su, na = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    named = su.join(F.broadcast(na), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    rows = li.withColumn("span_id", F.row_number().over(order)).join(named, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.col("l_orderkey").alias("trace_id"), "span_id", F.when(F.col("span_id") > 1, F.col("span_id") - 1).alias("parent_id"), F.col("n_name").alias("service"), F.col("l_linestatus").alias("name"),
        F.pmod("l_partkey", F.lit(20)).cast("int").alias("route"), F.col("l_shipdate").alias("ts"), (F.round(F.col("l_extendedprice") * 100).cast("bigint") * 1000).alias("duration_ns"),
        (F.col("l_returnflag") == "R").alias("error"), F.date_format("l_shipdate", "yyyy-MM").alias("version"), F.col("l_quantity").cast("int").alias("code"),
    )


def exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir).where("event_type = 'error'")
    return e.select("event_id", "ts", "ms", "user_id", F.pmod("k", F.lit(10)).alias("fp"), F.when(F.col("value") > 100, "resolved").otherwise("unresolved").alias("status"), F.concat(F.lit("failure "), F.col("k").cast("string")).alias("message"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir)
    return e.select("event_id", "ts", "ms", F.pmod("user_id", F.lit(7)).alias("trace"), F.col("user_id").alias("service"), F.upper(F.when(F.col("event_type") == "error", "error").otherwise("info")).alias("severity"), F.concat_ws(" ", "event_type", "props").alias("body"))


def llm_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    models = F.array(F.lit("alpha-large-2024-05-13"), F.lit("beta-mini"), F.lit("gamma-001"))
    n = F.length(F.coalesce("text", F.lit("")))
    return c.select(
        F.col("conv_id").alias("session"), "turn", "role", "text", F.element_at(models, (F.pmod("conv_id", F.lit(3)) + 1).cast("int")).alias("model"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "baseline").otherwise("target").alias("variant"),
        F.ceil(n / 4).cast("bigint").alias("tokens"), (n % 1000).cast("bigint").alias("latency_ms"), (F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(11)) == 0).alias("failed"),
        F.pmod("conv_id", F.lit(25)).alias("user"), (F.lit(T0) + F.col("conv_id") * 600_000 + F.col("turn") * 60_000).alias("ms"),
    )


SQL = {
    "ev": "SELECT event_id, ts, user_id, event_type, value, props, epoch_us(ts) // 1000 AS ms, CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(ts AS DATE) AS day FROM events",
    "gauge": "SELECT event_type AS metric, 'u' || user_id AS uid, ms, value, event_id AS seq FROM ev",
    "counter": "SELECT 'u' || user_id AS uid, event_type AS type, ms, sum(cents) OVER (PARTITION BY user_id, event_type, day ORDER BY ts, event_id) / 100.0 AS value, event_id AS seq FROM ev",
    "spans": """SELECT l_orderkey AS trace_id, span_id, CASE WHEN span_id > 1 THEN span_id - 1 END AS parent_id, n_name AS service, l_linestatus AS name, CAST(l_partkey % 20 AS INTEGER) AS route, l_shipdate AS ts,
      CAST(round(l_extendedprice * 100) AS BIGINT) * 1000 AS duration_ns, l_returnflag = 'R' AS error, strftime(l_shipdate, '%Y-%m') AS version, CAST(l_quantity AS INTEGER) AS code
      FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INTEGER) AS span_id FROM lineitem)
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "exc": "SELECT event_id, ts, ms, user_id, k % 10 AS fp, CASE WHEN value > 100 THEN 'resolved' ELSE 'unresolved' END AS status, 'failure ' || k AS message FROM ev WHERE event_type = 'error'",
    "logs": "SELECT event_id, ts, ms, user_id % 7 AS trace, user_id AS service, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS severity, event_type || ' ' || props AS body FROM ev",
    "llm": f"""SELECT conv_id AS session, turn, role, text, CASE conv_id % 3 WHEN 0 THEN 'alpha-large-2024-05-13' WHEN 1 THEN 'beta-mini' ELSE 'gamma-001' END AS model, CASE WHEN conv_id % 2 = 0 THEN 'baseline' ELSE 'target' END AS variant,
      CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens, CAST(length(coalesce(text, '')) % 1000 AS BIGINT) AS latency_ms, (conv_id * 7 + turn * 3) % 11 = 0 AS failed, conv_id % 25 AS "user",
      {T0} + conv_id * 600000 + turn * 60000 AS ms FROM conversations""",
}
_NEEDS = {"gauge": ["ev"], "counter": ["ev"], "exc": ["ev"], "logs": ["ev"]}


def sql(body: str, *views: str, **ctes: str) -> str:
    """body after a WITH of the named views and of further common tables."""
    names: list[str] = []
    for v in views:
        names += [x for x in (*_NEEDS.get(v, []), v) if x not in names]
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in ctes.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
