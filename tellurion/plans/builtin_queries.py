"""One query per group of functions that Spark has already, and the user-function surface."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import pipeline as P
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


def expressions(name: str, table: str, key: str, spark_exprs: dict[str, str], duck: dict[str, str]) -> None:
    """The same expressions over a whole table, in Spark's spelling and in DuckDB's."""
    @query(name, f"SELECT {key}, {', '.join(f'{e} AS {n}' for n, e in duck.items())} FROM {table}")
    def _(spark, sf):
        return V.table(spark, sf, table).select(key, *(F.expr(e).alias(n) for n, e in spark_exprs.items()))


UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
expressions("h01_date_trunc", "events", "event_id", {f"t_{u}": f"date_trunc('{u}', ts)" for u in UNITS}, {f"t_{u}": f"CAST(date_trunc('{u}', ts) AS TIMESTAMP)" for u in UNITS})
expressions(
    "h02_extract", "events", "event_id",
    {"yr": "extract(year from ts)", "mon": "extract(month from ts)", "dy": "extract(day from ts)", "hr": "extract(hour from ts)", "mi": "extract(minute from ts)", "doy": "dayofyear(ts)", "wk": "weekofyear(ts)", "dow": "dayofweek(ts) - 1", "epoch_s": "unix_timestamp(ts)"},
    {"yr": "year(ts)", "mon": "month(ts)", "dy": "day(ts)", "hr": "hour(ts)", "mi": "minute(ts)", "doy": "dayofyear(ts)", "wk": "week(ts)", "dow": "dayofweek(ts)", "epoch_s": "CAST(floor(epoch(ts)) AS BIGINT)"},
)
expressions("h03_to_char", "events", "event_id", {"a": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "b": "date_format(ts, 'dd/MM/yyyy')", "c": "date_format(ts, 'MMM')"}, {"a": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "b": "strftime(ts, '%d/%m/%Y')", "c": "strftime(ts, '%b')"})


@query("h04_string_agg", "SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, list_sort(list(o_orderkey)) AS keys, bool_or(o_orderstatus = 'F') AS some_f, bool_and(o_totalprice > 1000) AS all_large FROM orders GROUP BY o_custkey")
def _(spark, sf):
    return V.table(spark, sf, "orders").groupBy("o_custkey").agg(F.expr("listagg(o_orderstatus, ',') WITHIN GROUP (ORDER BY o_orderstatus)").alias("statuses"), F.array_sort(F.collect_list("o_orderkey")).alias("keys"), F.bool_or(F.col("o_orderstatus") == "F").alias("some_f"), F.bool_and(F.col("o_totalprice") > 1000).alias("all_large"))


expressions("h05_strings", "part", "p_partkey", {"a": "regexp_replace(p_name, '[aeiou]', '_')", "b": "left(p_name, 3)", "c": "right(p_name, 3)", "d": "char_length(p_name)"}, {"a": "regexp_replace(p_name, '[aeiou]', '_', 'g')", "b": "left(p_name, 3)", "c": "right(p_name, 3)", "d": "length(p_name)"})


@query("h06_clock", "SELECT event_id, true AS past, true AS same_day FROM events")
def _(spark, sf):
    return V.table(spark, sf, "events").select("event_id", (F.col("ts") < F.current_timestamp()).alias("past"), (F.to_date(F.current_timestamp()) == F.current_date()).alias("same_day"))


expressions("h07_casts", "orders", "o_orderkey", {"a": "cast(o_orderkey as string)", "b": "cast(o_totalprice as decimal(18,1))", "c": "try_cast(o_orderpriority as int)", "d": "cast(o_orderdate as date)"}, {"a": "CAST(o_orderkey AS VARCHAR)", "b": "CAST(o_totalprice AS DECIMAL(18,1))", "c": "TRY_CAST(o_orderpriority AS INTEGER)", "d": "CAST(o_orderdate AS DATE)"})
expressions("h08_intervals", "orders", "o_orderkey", {"a": "o_orderdate + INTERVAL 7 DAYS", "b": "add_months(cast(o_orderdate as date), 1)", "c": "o_orderdate - INTERVAL 2 WEEKS", "d": "datediff(o_orderdate, date'1990-01-01')"}, {"a": "o_orderdate + INTERVAL 7 DAY", "b": "CAST(o_orderdate + INTERVAL 1 MONTH AS DATE)", "c": "o_orderdate - INTERVAL 14 DAY", "d": "date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE))"})


@query("h09_predicates", "SELECT p_partkey FROM part WHERE (p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#2', 'Brand#17', 'Brand#5') AND p_name LIKE '%ring%') OR (NOT p_retailprice >= 901 AND contains(p_name, 'red') AND p_type IS NOT NULL)")
def _(spark, sf):
    return V.table(spark, sf, "part").where("(p_size between 5 and 20 and p_brand in ('Brand#2', 'Brand#17', 'Brand#5') and p_name like '%ring%') or (not p_retailprice >= 901 and contains(p_name, 'red') and p_type is not null)").select("p_partkey")


expressions("h10_json", "events", "event_id", {"k": "cast(get_json_object(props, '$.k') as int)", "none": "get_json_object(props, '$.zz')"}, {"k": "CAST(json_extract_string(props, '$.k') AS INTEGER)", "none": "json_extract_string(props, '$.zz')"})
expressions(
    "h11_arrays", "part", "p_partkey",
    {"n": "size(split(p_name, ' '))", "has": "array_contains(split(p_name, ' '), 'red')", "some": "arrays_overlap(split(p_name, ' '), array('ring', 'widget'))", "part": "array_join(slice(split(p_name, ' '), 1, 1), '-')", "keys": "array_join(map_keys(map_filter(map('a', p_size, 'b', p_partkey), (k, v) -> v > 25)), ',')"},
    {"n": "len(string_split(p_name, ' '))", "has": "list_contains(string_split(p_name, ' '), 'red')", "some": "list_has_any(string_split(p_name, ' '), ['ring', 'widget'])", "part": "array_to_string(string_split(p_name, ' ')[1:1], '-')", "keys": "concat_ws(',', CASE WHEN p_size > 25 THEN 'a' END, CASE WHEN p_partkey > 25 THEN 'b' END)"},
)


@query("h12_aggregates", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS n_large, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_tax > 0.02) AS BIGINT) AS taxed, max(l_extendedprice) FILTER (WHERE l_linestatus = 'O') AS max_open, max_by(l_orderkey, (l_extendedprice, l_orderkey)) AS dearest, count(DISTINCT l_partkey) AS parts, round(quantile_cont(l_quantity, 0.9), 6) AS p90, list_sort(list(DISTINCT l_linestatus)) AS statuses FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    c = F.col
    return V.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(c("l_quantity") > 25).alias("n_large"), F.sum(F.when(c("l_tax") > 0.02, c("l_quantity").cast("bigint"))).alias("taxed"), F.max(F.when(c("l_linestatus") == "O", c("l_extendedprice"))).alias("max_open"),
        F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("dearest"), F.countDistinct("l_partkey").alias("parts"), F.round(F.percentile("l_quantity", F.lit(0.9)), 6).alias("p90"), F.array_sort(F.collect_set("l_linestatus")).alias("statuses"),
    )


@query("h12_approximate")
def _(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.expr("approx_top_k(l_suppkey, 3)").alias("top"), F.histogram_numeric("l_quantity", F.lit(5)).alias("histogram"), F.percentile_approx("l_quantity", 0.5).alias("median"))


expressions("h13_units", "orders", "o_orderkey", {"cents": "cast(round(o_totalprice * 100) as bigint)", "dollars": "cast(round(o_totalprice * 100) as bigint) / 100.0D"}, {"cents": "CAST(round(o_totalprice * 100) AS BIGINT)", "dollars": "CAST(round(o_totalprice * 100) AS BIGINT) / 100.0::DOUBLE"})


@query("i01_user_transform", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 10")
def _(spark, sf):
    def net(b: pd.DataFrame) -> pd.DataFrame:
        b = b[b["l_quantity"] > 10]
        return b.assign(net=(b["l_extendedprice"] * (1 - b["l_discount"])).round(4))[["l_orderkey", "l_linenumber", "net"]]

    rows = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return P.map_batches(rows, net, "l_orderkey bigint, l_linenumber int, net double").withColumn("net", F.round("net", 4))


@query("i02_user_function", "SELECT o_orderkey, upper(o_orderpriority) || '!' AS shout FROM orders")
def _(spark, sf):
    def shout(s: pd.Series) -> pd.Series:
        return s.str.upper() + "!"

    V.table(spark, sf, "orders").createOrReplaceTempView("i02_orders")
    spark.udf.register("tellurion_shout", F.pandas_udf(shout, "string"))
    return spark.sql("SELECT o_orderkey, tellurion_shout(o_orderpriority) AS shout FROM i02_orders")


@query("i03_user_aggregate", "SELECT o_orderstatus, round(exp(avg(ln(o_totalprice))), 4) AS mean FROM orders GROUP BY o_orderstatus")
def _(spark, sf):
    def add(g: pd.DataFrame) -> dict:
        return {"logs": float(np.log(g["o_totalprice"]).sum()), "n": len(g)}

    def merge(states: pd.DataFrame) -> dict:
        return {"mean": float(np.exp(states["logs"].sum() / states["n"].sum()))}

    rows = V.table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    return P.aggregate_batches(rows, ["o_orderstatus"], add, "logs double, n bigint", merge, "mean double").withColumn("mean", F.round("mean", 4))


@query("i04_pipeline", "SELECT c_mktsegment, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment")
def _(spark, sf):
    steps = {
        "orders": (lambda: V.table(spark, sf, "orders"), ()),
        "customers": (lambda: V.table(spark, sf, "customer"), ()),
        "settled": (lambda o: o.where("o_orderstatus <> 'P'"), ("orders",)),
        "joined": (lambda o, c: c.join(o, F.col("c_custkey") == F.col("o_custkey")), ("settled", "customers")),
        "report": (lambda j: j.groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents")), ("joined",)),
    }
    return P.build(steps, "report")


@query("i05_saved_view", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def _(spark, sf):
    V.table(spark, sf, "orders").where("o_totalprice > 100000").createOrReplaceTempView("i05_large_orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n FROM i05_large_orders GROUP BY o_orderstatus")
