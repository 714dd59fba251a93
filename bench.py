"""Times headline queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tellurion.plans import registry
from tellurion.plans.warehouse_queries import year_files
from tellurion.sources import files as S

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: The file-skipping read stands against the reference's published index figures, the others cover each family.
HEADLINE = (
    "b06_rate_sum_by_type", "b06_rate_long_windows", "b09_deriv_long_windows", "b15_stddev_long_windows", "b02_instant_vector", "b28_histogram_quantile", "c01_trace_summary", "c04_topology", "c09_faulty_deployments", "c13_exception_groups", "c41_red_metrics",
    "d03_reduced_join", "d16_funnel", "d17_retention_day", "e02_rollup_5m", "e03_stream_cascade", "f02_apply_changes", "g02_cost", "g21_nearest",
)


def median(f, runs: int = 3) -> float:
    """Median seconds of some runs after one that is not counted, in which code is compiled and files come into memory."""
    times = []
    for _ in range(runs + 1):
        began = time.time()
        f().write.format("noop").mode("overwrite").save()
        times.append(time.time() - began)
    return round(sorted(times[1:])[runs // 2], 3)


def skipping(spark: SparkSession) -> dict[str, float]:
    """The file-skipping read by itself, over files laid out and summed up before: median of three reads with and without
    the statistics. The numbers of files read go to stderr."""
    path, stats = year_files(spark, SF_DIR)
    stats = spark.createDataFrame(stats.collect(), stats.schema).cache()
    schema = spark.read.parquet(path).schema
    predicate = {"column": "o_totalprice", "op": ">", "value": 200000.0}
    read = {
        "d08_read_skipping": lambda: S.read_skipping(spark, stats, predicate, schema, year=1995),
        "d08_read_all": lambda: spark.read.parquet(path).where(S.row_match(predicate)).where("year(o_orderdate) = 1995"),
    }
    out = {}
    for name, f in read.items():
        out[name] = median(lambda f=f: f().select("o_orderkey", "o_totalprice"))
    files = stats.where(S.may_match(predicate)).where("file like '%/year=1995/%'").count()
    print(f"files read: {files} of {stats.count()}", file=sys.stderr)
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{SF_DIR}/orders.parquet").count()  # start-up is not measured
    took = {}
    for name in HEADLINE:
        took[name] = median(lambda f=queries[name]: f(spark, SF_DIR), 1)
    took |= skipping(spark)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
