"""Registered queries of sources, warehouse operators and table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import warehouse as W
from ..sources import files as S
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


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share; only a session on one machine may do without naming one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "/tmp/checkpoints/tellurion"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query("a01_scan_projection", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
def _(spark, sf):
    return V.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity").where("l_quantity > 49")


@query("a02_csv", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus IN ('P') THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_orderdate FROM orders")
def _(spark, sf):
    path = scratch(spark, "csv")
    V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate").write.option("header", True).option("sep", "|").csv(path)
    return S.read_csv(spark, path, "o_orderkey bigint, o_totalprice double, o_orderstatus string, o_orderdate timestamp", sep="|", nulls=("", "P", "NA"))


@query("a03_json_records", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    path = scratch(spark, "json")
    o = V.table(spark, sf, "orders")
    o.groupBy("o_custkey").agg(F.collect_list(F.struct("o_custkey", "o_orderkey", "o_totalprice")).alias("items")).select(F.struct("items").alias("data")).write.json(path)
    return S.read_json(spark, path, "data.items", "data struct<items:array<struct<o_custkey:bigint,o_orderkey:bigint,o_totalprice:double>>>")


def dated_orders(spark, sf) -> str:
    path = scratch(spark, "dated")
    o = V.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    o.repartition("year").write.partitionBy("year").parquet(path)
    return path


@query("a04_partition_discovery", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    df = S.partition_values(spark.read.parquet(dated_orders(spark, sf)), y=r"year=(\d+)")
    return df.where("path_bucket is null").groupBy("y", "year").agg(F.count("*").alias("n"))


@query("a05_transaction_log", "SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n FROM orders WHERE year(o_orderdate) <> 1996 GROUP BY ALL")
def _(spark, sf):
    path = dated_orders(spark, sf)
    files = spark.read.parquet(path).select(F.regexp_extract(F.input_file_name(), r"(year=\d+/[^/]*)$", 1).alias("path")).distinct()
    log = scratch(spark, "log")
    files.select(F.struct(F.col("path"), F.lit(1).cast("bigint").alias("size")).alias("add")).coalesce(1).write.json(f"{log}/00000.json")
    files.where("path like 'year=1996%'").select(F.struct("path").alias("remove")).coalesce(1).write.json(f"{log}/00001.json")
    return S.read_active(spark, path, f"{log}/*.json").groupBy("year").agg(F.count("*").alias("n"))


@query("a06_incremental_read", "SELECT count(*) AS n, max(o_orderkey) AS next_cursor FROM orders WHERE o_orderkey > 500")
def _(spark, sf):
    rows, cursor = S.read_incremental(V.table(spark, sf, "orders"), "o_orderkey", 500)
    return rows.agg(F.count("*").alias("n"), cursor.alias("next_cursor"))


@query("a06_bounded_read", "WITH edge AS (SELECT max(o_custkey) AS e FROM (SELECT o_custkey FROM orders WHERE o_custkey > 5 ORDER BY o_custkey LIMIT 40)) SELECT o_custkey, o_orderkey FROM orders, edge WHERE o_custkey > 5 AND o_custkey <= e")
def _(spark, sf):
    return S.read_incremental(V.table(spark, sf, "orders"), "o_custkey", 5, max_rows=40)[0].select("o_custkey", "o_orderkey")


@query("a07_read_strategies", "SELECT 'full' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'filter', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'incremental', count(*) FROM orders WHERE o_orderkey > 700 UNION ALL SELECT 'batch', least(100, count(*)) FROM orders UNION ALL SELECT 'query', count(DISTINCT o_custkey) FROM orders")
def _(spark, sf):
    path = f"{sf}/orders.parquet"
    V.table(spark, sf, "orders").createOrReplaceTempView("orders_source")
    kinds = [{"kind": "full"}, {"kind": "filter", "where": "o_orderstatus = 'F'"}, {"kind": "incremental", "cursor": "o_orderkey", "last": 700}, {"kind": "batch", "limit": 100}, {"kind": "query", "sql": "SELECT DISTINCT o_custkey FROM orders_source"}]
    out = None
    for k in kinds:
        part = S.read_source(spark, {"path": path, **k}).agg(F.count("*").alias("n")).select(F.lit(k["kind"]).alias("kind"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("a08_date_pruning", "SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'")
def _(spark, sf):
    path = scratch(spark, "events")
    W.write_dates(V.table(spark, sf, "events"), path, "ts")
    return S.in_dates(spark.read.parquet(path), "ts", "2024-01-10 06:00:00", "2024-01-12 18:00:00").select("event_id", "user_id")


@query("a09_chunked_sink", "SELECT l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    path = scratch(spark, "chunks")
    S.write_chunks(V.table(spark, sf, "lineitem"), path, 20_000, ("l_returnflag",))
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("a10_file_statistics", "SELECT year(o_orderdate)::INTEGER AS year, count(*) AS rows, min(o_orderkey) AS o_orderkey_min, max(o_orderkey) AS o_orderkey_max, min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, 0::BIGINT AS nulls FROM orders GROUP BY ALL")
def _(spark, sf):
    stats = S.file_statistics(spark, dated_orders(spark, sf), ["o_orderkey", "o_totalprice"])
    by = stats.groupBy(F.regexp_extract("file", r"year=(\d+)", 1).cast("int").alias("year"))
    return by.agg(F.sum("rows").alias("rows"), F.min("o_orderkey_min").alias("o_orderkey_min"), F.max("o_orderkey_max").alias("o_orderkey_max"), F.min("o_totalprice_min").alias("o_totalprice_min"), F.max("o_totalprice_max").alias("o_totalprice_max"), F.sum(F.col("o_orderkey_nulls") + F.col("o_totalprice_nulls")).alias("nulls"))


@query("a13_idempotent_sink", "SELECT 'a' AS run_id, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'b', count(*) FROM orders WHERE o_orderkey % 2 = 1")
def _(spark, sf):
    path = scratch(spark, "runs")
    o = V.table(spark, sf, "orders")
    for run, part in (("a", o.limit(10)), ("b", o.where("o_orderkey % 2 = 1")), ("a", o.where("o_orderkey % 2 = 0"))):
        S.write_run(part, path, run)
    return spark.read.parquet(path).groupBy("run_id").agg(F.count("*").alias("n"))


# --- joins and profiles --------------------------------------------------------------------------------------


#: Whole tables; the condition on both sides leaves rows without a partner for the outer joins.
for _how, _sql in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN"}.items():
    def _join(spark, sf, how=_how):
        c, o = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
        on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") == "F") & (F.col("c_acctbal") > 1000)
        return c.join(o, on, how).select("c_custkey", "c_mktsegment", "o_orderkey", "o_custkey")

    QUERIES[f"d01_{_how}_join"] = _join
    SQL[f"d01_{_how}_join"] = f"SELECT c_custkey, c_mktsegment, o_orderkey, o_custkey FROM customer {_sql} orders ON c_custkey = o_custkey AND o_orderstatus = 'F' AND c_acctbal > 1000"


@query("d02_cross_to_inner", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
def _(spark, sf):
    return V.table(spark, sf, "nation").crossJoin(V.table(spark, sf, "region")).where("n_regionkey = r_regionkey").select("n_name", "r_name")


@query("d03_reduced_join", "SELECT p_partkey, p_brand, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size < 10 AND p_type = 'ECONOMY' GROUP BY ALL")
def _(spark, sf):
    p = V.table(spark, sf, "part").where("p_size < 10 and p_type = 'ECONOMY'").select(F.col("p_partkey").alias("k"), "p_brand")
    j = p.join(V.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), "l_quantity"), "k")  # how it runs is Spark's matter
    return j.groupBy(F.col("k").alias("p_partkey"), "p_brand").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))


@query("d04_bloom_join", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000 GROUP BY ALL")
def _(spark, sf):
    c, o = V.table(spark, sf, "customer").where("c_acctbal > 5000").withColumnRenamed("c_custkey", "k"), V.table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    return o.join(c, "k").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("d05_union", "SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer")
def _(spark, sf):
    return V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).unionByName(V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))).distinct()


@query("d06_key_overlap", "SELECT count(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS common, count(*) FILTER (WHERE r IS NULL) AS left_only, count(*) FILTER (WHERE l IS NULL) AS right_only, CAST(coalesce(sum(l * r), 0) AS BIGINT) AS join_rows FROM (SELECT c_custkey AS k, count(*) AS l FROM customer GROUP BY ALL) FULL JOIN (SELECT o_custkey AS k, count(*) AS r FROM orders GROUP BY ALL) USING (k)")
def _(spark, sf):
    return W.key_overlap(V.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), V.table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("d07_missing_keys", "SELECT l_partkey AS missing_key, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY ALL")
def _(spark, sf):
    return W.missing_keys(V.table(spark, sf, "lineitem"), V.table(spark, sf, "part").where("p_size > 5"), "l_partkey", "p_partkey")


@query("d08_file_skipping", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderkey BETWEEN 100 AND 180 OR o_orderkey = 3) AND o_orderstatus IN ('F', 'O') AND o_totalprice > 1000")
def _(spark, sf):
    path = scratch(spark, "skip")
    o = V.table(spark, sf, "orders")
    o.repartitionByRange(32, "o_orderkey").write.parquet(path)
    stats = S.file_statistics(spark, path, ["o_orderkey", "o_totalprice"], ["o_orderstatus"])
    both = {"and": [{"or": [{"column": "o_orderkey", "op": "between", "value": [100, 180]}, {"column": "o_orderkey", "op": "=", "value": 3}]}, {"column": "o_orderstatus", "op": "value_in", "value": ["F", "O"]}, {"column": "o_totalprice", "op": ">", "value": 1000.0}]}
    return S.read_skipping(spark, stats, both, o.schema).select("o_orderkey", "o_orderstatus", "o_totalprice")


def year_files(spark, sf) -> tuple[str, DataFrame]:
    """Orders in folders by year, each in several files by price, and the statistics of the files."""
    path = scratch(spark, "years")
    V.table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")).repartitionByRange(16, "year", "o_totalprice").write.partitionBy("year").parquet(path)
    return path, S.file_statistics(spark, path, ["o_totalprice"])


@query("d08_partition_hint", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1995 AND o_totalprice > 200000")
def _(spark, sf):
    path, stats = year_files(spark, sf)
    return S.read_skipping(spark, stats, {"column": "o_totalprice", "op": ">", "value": 200000.0}, V.table(spark, sf, "orders").schema, year=1995).select("o_orderkey", "o_totalprice")


@query("d09_cardinality", "SELECT name, rows, distinct_values, round(distinct_values / rows, 6) AS selectivity, CASE WHEN distinct_values <= 100 THEN 'values' WHEN distinct_values / rows < 0.01 THEN 'bitmap' WHEN distinct_values / rows > 0.9 THEN 'bloom' ELSE 'sorted' END AS advice FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS rows, count(DISTINCT {c}) AS distinct_values FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")) + ")")
def _(spark, sf):
    return W.cardinality(V.table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], exact=True)


@query("d09_cardinality_sketch")
def _(spark, sf):
    sketches = W.distinct_sketch(V.table(spark, sf, "orders"), "o_custkey", "o_orderpriority")
    return W.merge_sketches(sketches)


@query("d10_statistics", "SELECT " + " UNION ALL SELECT ".join(f"count(*) AS rows, '{c}' AS name, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS null_share, count(DISTINCT {c}) AS distinct_values, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest FROM customer" for c in ("c_custkey", "c_nationkey", "c_mktsegment")))
def _(spark, sf):
    return W.statistics(V.table(spark, sf, "customer"), ["c_custkey", "c_nationkey", "c_mktsegment"], exact=True)


#: Estimates from a tenth of the rows; a test holds them against the table.
@query("d10_sampled_statistics")
def _(spark, sf):
    return W.statistics(V.table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], fraction=0.1)


def _words(c: str) -> str:
    return f"string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9_]+')"


@query("d13_search", f"SELECT 'part' AS source, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE list_contains({_words('p_name')}, 'red') AND list_contains({_words('p_name')}, 'widget') UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE (list_contains({_words('c_name')}, 'red') AND list_contains({_words('c_name')}, 'widget')) OR (list_contains({_words('c_mktsegment')}, 'red') AND list_contains({_words('c_mktsegment')}, 'widget'))")
def _(spark, sf):
    return W.search({"part": (V.table(spark, sf, "part"), "p_partkey", ["p_name"]), "customer": (V.table(spark, sf, "customer"), "c_custkey", ["c_name", "c_mktsegment"])}, "Red Widget")


@query("d14_freshness", "SELECT event_type AS name, CASE WHEN h < 1 THEN 'fresh' WHEN h < 6 THEN 'recent' WHEN h < 24 THEN 'stale' ELSE 'old' END AS level, CAST(last AS VARCHAR) AS last FROM (SELECT event_type, date_trunc('second', max(ts)) AS last, (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', max(ts)))) / 3600 AS h FROM events GROUP BY ALL)")
def _(spark, sf):
    latest = V.table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.date_trunc("second", F.max("ts")).alias("last"))
    return W.freshness(latest, "2024-01-31 00:00:00").withColumn("last", F.col("last").cast("string"))


@query("d14_freshness_summary", "SELECT CASE WHEN h < 1 THEN 'fresh' WHEN h < 6 THEN 'recent' WHEN h < 24 THEN 'stale' ELSE 'old' END AS level, count(*) AS tables FROM (SELECT user_id, (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', max(ts)))) / 3600 AS h FROM events GROUP BY ALL) GROUP BY ALL")
def _(spark, sf):
    last = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("name")).agg(F.date_trunc("second", F.max("ts")).alias("last"))
    return W.freshness_summary(W.freshness(last, "2024-01-31 00:00:00"))


@query("d15_daily_events", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def _(spark, sf):
    return W.daily_events(V.table(spark, sf, "events"))


STEPS = ["view", "click", "purchase"]
DAY3 = 3 * V.DAY
#: Progress as windows: a step counts when the step event right before it, of those that count, is its predecessor in time.
FUNNEL = {
    "s": "SELECT user_id, ms, event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS step FROM ev WHERE event_type IN ('view', 'click', 'purchase')",
    "o": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS i FROM s",
    "walk": f"""SELECT user_id, 0::BIGINT AS i, 0 AS cur, 0::BIGINT AS at, 0 AS top FROM (SELECT DISTINCT user_id FROM o)
      UNION ALL SELECT w.user_id, o.i, CASE WHEN o.step = 1 THEN 1 WHEN w.cur > 0 AND o.step = w.cur + 1 AND o.ms - w.at <= {DAY3} THEN o.step ELSE w.cur END,
      CASE WHEN o.step = 1 OR (w.cur > 0 AND o.step = w.cur + 1 AND o.ms - w.at <= {DAY3}) THEN o.ms ELSE w.at END,
      greatest(w.top, CASE WHEN o.step = 1 THEN 1 WHEN w.cur > 0 AND o.step = w.cur + 1 AND o.ms - w.at <= {DAY3} THEN o.step ELSE 0 END) FROM walk w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1""",
    "counts": "SELECT step, count(*) AS users FROM (SELECT user_id, max(top) AS top FROM walk GROUP BY user_id) JOIN (SELECT unnest([1, 2, 3]) AS step) ON top >= step GROUP BY step",
}


@query("d16_funnel", V.sql("SELECT step, ['view', 'click', 'purchase'][step] AS event_type, users, round(coalesce(users / lag(users) OVER (ORDER BY step), 1), 6) AS conversion, coalesce(lag(users) OVER (ORDER BY step) - users, 0) AS lost, round(users / first_value(users) OVER (ORDER BY step), 6) AS overall FROM counts", "ev", **FUNNEL).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    return W.funnel(W.funnel_reached(V.event_rows(spark, sf), STEPS, DAY3), STEPS)


def retention_sql(unit: str, gap: str) -> str:
    return f"SELECT cohort, off AS \"offset\", users, max(users) FILTER (WHERE off = 0) OVER (PARTITION BY cohort) AS size, round(users / max(users) FILTER (WHERE off = 0) OVER (PARTITION BY cohort), 6) AS share FROM (SELECT cohort, CAST({gap} AS INTEGER) AS off, count(*) AS users FROM (SELECT DISTINCT user_id, date_trunc('{unit}', ts)::TIMESTAMP AS period FROM ev) JOIN (SELECT user_id, date_trunc('{unit}', min(ts))::TIMESTAMP AS cohort FROM ev GROUP BY user_id) USING (user_id) GROUP BY ALL)"


@query("d17_retention_day", V.sql(retention_sql("day", "date_diff('day', cohort, period)"), "ev"))
def _(spark, sf):
    return W.retention(V.table(spark, sf, "events"), "day")


@query("d17_retention_week", V.sql(retention_sql("week", "date_diff('week', cohort, period)"), "ev"))
def _(spark, sf):
    return W.retention(V.table(spark, sf, "events"), "week")


@query("d17_retention_average", V.sql('SELECT "offset", round(avg(share), 6) AS share, count(*) AS cohorts FROM m GROUP BY ALL', "ev", m=retention_sql("day", "date_diff('day', cohort, period)")))
def _(spark, sf):
    return W.average_retention(W.retention(V.table(spark, sf, "events"), "day"))


CHANGES = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'delete' WHEN o_orderkey % 5 = 0 THEN 'update' ELSE 'insert' END AS op, o_orderkey AS seq, o_totalprice + 1 AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 11 = 0"


def changes(spark, sf) -> DataFrame:
    o = V.table(spark, sf, "orders").where("o_orderkey % 7 = 0 or o_orderkey % 5 = 0 or o_orderkey % 11 = 0")
    op = F.when(F.col("o_orderkey") % 7 == 0, "delete").when(F.col("o_orderkey") % 5 == 0, "update").otherwise("insert")
    return o.select(F.col("o_orderkey").alias("k"), op.alias("op"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") + 1).alias("price"), F.col("o_orderstatus").alias("status"))


def base_orders(spark, sf) -> DataFrame:
    """The stored table that the changes meet: orders that are not pending."""
    return V.table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


BASE = "SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'P'"


@query("d18_churn", "SELECT o_orderpriority, count(*) AS rows, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS changes, round(count(*) FILTER (WHERE o_orderkey % 5 = 0) / count(*), 6) AS churn FROM orders GROUP BY ALL")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    return W.churn(o.where("o_orderkey % 5 = 0"), o, "o_orderpriority")


@query("d19_usage", V.sql("SELECT event_type, count(*) AS queries, count(DISTINCT user_id) AS users, CAST(sum(cents) AS BIGINT) AS total_ms FROM ev GROUP BY ALL", "ev"))
def _(spark, sf):
    return W.usage(V.event_rows(spark, sf).withColumn("ms", F.col("cents")), "event_type")


@query("d20_date_formats", "SELECT 'iso' AS name, 1.0::DOUBLE AS rate, 'yyyy-MM-dd' AS format FROM (SELECT count(*) AS n FROM orders) WHERE n > 0 UNION ALL SELECT 'german', 1.0, 'dd.MM.yyyy' UNION ALL SELECT 'compact', 1.0, 'yyyyMMdd' UNION ALL SELECT 'none', 0.0, NULL")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("german"), F.date_format("o_orderdate", "yyyyMMdd").alias("compact"), F.col("o_orderpriority").alias("none"))
    return W.date_formats(o, ["iso", "german", "compact", "none"])


@query("d20_converted_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS german, o_orderpriority AS other FROM orders")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("german"), F.col("o_orderpriority").alias("other"))
    return W.convert_dates(o, ["iso", "german", "other"])


@query("d21_group_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10 ORDER BY n DESC, o_custkey LIMIT 50 OFFSET 5")
def _(spark, sf):
    return V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 10").orderBy(F.desc("n"), "o_custkey").offset(5).limit(50)


@query("d22_subqueries", "WITH big AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS total FROM orders GROUP BY o_custkey) SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM big WHERE total > (SELECT avg(total) FROM big)) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') EXCEPT SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def _(spark, sf):
    for t in ("orders", "customer"):
        V.table(spark, sf, t).createOrReplaceTempView(f"d22_{t}")
    return spark.sql(SQL["d22_subqueries"].replace("FROM orders", "FROM d22_orders").replace("FROM customer", "FROM d22_customer"))


@query("d23_window_share", "SELECT r, total, round(total * 100.0 / sum(total) OVER (), 6) AS share, rank() OVER (ORDER BY total DESC) AS place FROM (SELECT l_returnflag AS r, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY ALL)")
def _(spark, sf):
    from pyspark.sql import Window

    t = V.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("r")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("total"))
    return t.withColumn("share", F.round(F.col("total") * 100.0 / F.sum("total").over(Window.partitionBy()), 6)).withColumn("place", F.rank().over(Window.orderBy(F.desc("total"))))


@query("d24_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, sf):
    return V.table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("d24_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(spark, sf):
    return V.table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


# --- maintenance ---------------------------------------------------------------------------------------------


@query("f01_upsert", V.sql("SELECT k, price, status FROM base WHERE k NOT IN (SELECT k FROM ch) UNION ALL SELECT k, price, status FROM ch", base=BASE, ch=CHANGES))
def _(spark, sf):
    new = changes(spark, sf)
    twice = new.withColumn("price", F.lit(-1.0)).withColumn("seq", F.col("seq") - 1).unionByName(new).drop("op")
    return W.upsert(base_orders(spark, sf).withColumn("seq", F.lit(0).cast("bigint")), twice, ["k"], "seq").drop("seq")


@query("f02_apply_changes", V.sql("SELECT k, price, status FROM base WHERE k NOT IN (SELECT k FROM ch) UNION ALL SELECT k, price, status FROM ch WHERE op = 'insert' OR (op = 'update' AND k IN (SELECT k FROM base))", base=BASE, ch=CHANGES))
def _(spark, sf):
    return W.apply_changes(base_orders(spark, sf), changes(spark, sf), ["k"])


@query("f03_unify", "SELECT n_nationkey AS k, n_name AS name, NULL::INTEGER AS zone FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey FROM region")
def _(spark, sf):
    a, b = W.unify(V.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), V.table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), F.col("r_regionkey").alias("zone")))
    return a.unionByName(b)


@query("f04_derived_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def _(spark, sf):
    V.table(spark, sf, "orders").createOrReplaceTempView("f04_orders")
    return W.refresh(spark, scratch(spark, "derived"), "SELECT o_orderstatus, count(*) AS n FROM f04_orders GROUP BY ALL")


@query("f05_incremental_refresh", "SELECT o_orderkey, o_orderdate FROM orders")
def _(spark, sf):
    path = scratch(spark, "incremental")
    o = V.table(spark, sf, "orders")
    o.where("o_orderdate <= timestamp'1997-01-01'").createOrReplaceTempView("f05_orders")
    sql = "SELECT o_orderkey, o_orderdate FROM f05_orders WHERE o_orderdate > {{last_refresh}}"
    W.refresh(spark, path, sql)
    o.createOrReplaceTempView("f05_orders")
    return W.refresh(spark, path, sql, "1997-01-01 00:00:00")


@query("f06_compaction", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, sf):
    path = scratch(spark, "small")
    V.table(spark, sf, "orders").select("o_orderkey", "o_custkey").repartition(24).write.parquet(path)
    return W.compact(spark, path, scratch(spark, "compact"))


@query("f07_dated_merge", "SELECT event_id, CASE WHEN CAST(ts AS DATE) = DATE '2024-01-05' THEN value + 1 ELSE value END AS value FROM events")
def _(spark, sf):
    path = scratch(spark, "warm")
    e = V.table(spark, sf, "events").select("event_id", "ts", "value")
    W.write_dates(e, path, "ts")
    W.write_dates(e.where("to_date(ts) = date'2024-01-05'").withColumn("value", F.col("value") + 1), path, "ts")
    return spark.read.parquet(path).select("event_id", "value")


@query("f08_mutable_partitions", "SELECT CAST(ts AS DATE) AS dt, date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') < 7 AS mutable, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    m = V.table(spark, sf, "events").groupBy(F.to_date("ts").alias("dt")).agg(F.count("*").alias("n"), F.max("ts").alias("modified"))
    return W.mutable_partitions(m, "rolling", "2024-01-31").select("dt", "mutable", "n")


@query("f09_tail_resync", "SELECT o_orderkey AS k, CASE WHEN o_orderkey >= 77 THEN 'new' ELSE 'old' END || o_orderstatus AS h FROM orders WHERE o_orderkey >= 77 OR o_orderkey < 77")
def _(spark, sf):
    o = V.table(spark, sf, "orders")
    old = o.select(F.col("o_orderkey").alias("k"), F.concat(F.lit("old"), "o_orderstatus").alias("h"))
    new = o.select(F.col("o_orderkey").alias("k"), F.concat(F.when(F.col("o_orderkey") >= 77, "new").otherwise("old"), "o_orderstatus").alias("h"))
    return W.tail_resync(old, new, "k", "h")


@query("f10_materialise", "SELECT l_shipdate, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY ALL")
def _(spark, sf):
    path = scratch(spark, "view")
    S.write_chunks(V.table(spark, sf, "lineitem").where("l_discount > 0.05").groupBy("l_shipdate").agg(F.count("*").alias("n")), path)
    return spark.read.parquet(path)


@query("e14_retention", "SELECT event_id FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-31' - INTERVAL 10 DAY")
def _(spark, sf):
    return W.retain(V.table(spark, sf, "events"), "ts", "2024-01-31", 10).select("event_id")
