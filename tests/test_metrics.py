"""Hand-made series: staleness, resets, duplicate times, single samples, missing buckets, and identities."""

from __future__ import annotations

import math
import random
import statistics
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tellurion.functions.grid import Grid
from tellurion.operators import metrics as M

SCHEMA = "metric string, labels map<string,string>, unix_milli bigint, value double"


def samples(spark, *rows):
    return spark.createDataFrame([("m", labels, ts, v) for labels, ts, v in rows], SCHEMA)


def values(v):
    return {(tuple(sorted((r.labels or {}).items())), r.eval_ts): r.value for r in v.collect()}


A = {"job": "a"}
KEY = (("job", "a"),)


def test_instant_takes_newest_and_nan_ends_the_series(spark):
    s = samples(spark, (A, 0, 1.0), (A, 60_000, 2.0), (A, 120_000, float("nan")))
    got = values(M.instant(s, Grid(0, 180_000, 60_000)))
    assert got == {(KEY, 0): 1.0, (KEY, 60_000): 2.0}


def test_window_is_closed_at_both_ends(spark):
    s = samples(spark, (A, 0, 1.0), (A, 60_000, 2.0))
    got = values(M.over_time(s, Grid(60_000, 60_000, 60_000), 60_000, "count"))
    assert got == {(KEY, 60_000): 2.0}


@pytest.mark.parametrize("chunk", [86_400_000, 30_000])
def test_rate_survives_a_reset_and_any_chunk(spark, monkeypatch, chunk):
    monkeypatch.setattr(M.with_previous, "__defaults__", (chunk,))
    rows = [(A, 15_000 * k, float(k * 15 if k < 10 else (k - 10) * 15)) for k in range(21)]
    got = values(M.increase(samples(spark, *rows), Grid(300_000, 300_000, 60_000), 300_000))
    # 0..135, then 0..150: the drop loses the step at which the counter began anew
    assert math.isclose(got[KEY, 300_000], 285.0)


def test_rate_needs_two_times_and_is_never_negative(spark):
    s = samples(spark, (A, 0, 5.0), (A, 0, 7.0))
    assert values(M.rate(s, Grid(60_000, 60_000, 60_000), 60_000)) == {}


def test_increase_is_rate_times_range(spark):
    rows = [(A, 15_000 * k, float(k * k)) for k in range(20)]
    g = Grid(120_000, 240_000, 60_000)
    r, i = values(M.rate(samples(spark, *rows), g, 120_000)), values(M.increase(samples(spark, *rows), g, 120_000))
    assert r.keys() == i.keys() and all(math.isclose(r[k] * 120, i[k]) for k in r)


def test_irate_after_a_reset_uses_the_last_value(spark):
    s = samples(spark, (A, 0, 100.0), (A, 10_000, 5.0))
    assert values(M.last_two(s, Grid(10_000, 10_000, 10_000), 60_000, True)) == {(KEY, 10_000): 0.5}
    assert values(M.last_two(s, Grid(10_000, 10_000, 10_000), 60_000, False)) == {(KEY, 10_000): -95.0}


def test_deriv_of_constants(spark):
    flat = samples(spark, (A, 0, 3.0), (A, 10_000, 3.0))
    assert values(M.regression(flat, Grid(10_000, 10_000, 10_000), 60_000)) == {(KEY, 10_000): 0.0}
    endless = samples(spark, (A, 0, float("inf")), (A, 10_000, float("inf")))
    assert values(M.regression(endless, Grid(10_000, 10_000, 10_000), 60_000)) == {}


def test_changes_ignore_nan_after_nan(spark):
    s = samples(spark, *[(A, 1000 * k, v) for k, v in enumerate([1.0, 1.0, 2.0, float("nan"), float("nan"), 1.0])])
    assert values(M.steps_between(s, Grid(5000, 5000, 1000), 60_000, False)) == {(KEY, 5000): 3.0}


def buckets(spark, *rows):
    return spark.createDataFrame([({"le": le}, 0, float(c)) for le, c in rows], "labels map<string,string>, eval_ts bigint, value double")


@pytest.mark.parametrize(
    ("rows", "q", "want"),
    [
        ([("1", 10), ("2", 20), ("+Inf", 20)], 0.75, 1.5),
        ([("1", 10), ("+Inf", 20)], 0.9, 1.0),
        ([("1", 10), ("2", 20)], 0.5, None),
        ([("1", 0), ("+Inf", 0)], 0.5, math.nan),
        ([("1", 10), ("+Inf", 20)], 1.5, math.nan),
    ],
)
def test_histogram_quantile(spark, rows, q, want):
    got = [r.value for r in M.histogram_quantile(buckets(spark, *rows), q).collect()]
    assert (got == []) if want is None else (math.isnan(got[0]) if math.isnan(want) else got == [want])


def test_empty_label_is_no_label(spark):
    v = spark.createDataFrame([({"a": "", "b": "x"}, 0, 1.0), ({"b": "x"}, 0, 2.0)], "labels map<string,string>, eval_ts bigint, value double")
    assert values(M.aggregate(v, "sum", by=["a", "b"])) == {((("b", "x"),), 0): 3.0}


def test_nan_ranks_last_and_compares_false(spark):
    v = spark.createDataFrame([({"a": str(k)}, 0, x) for k, x in enumerate([1.0, float("nan"), 3.0])], "labels map<string,string>, eval_ts bigint, value double")
    assert [r.value for r in M.top(v, 1).collect()] == [3.0]
    assert [r.value for r in M.with_scalar(v, ">", 2).collect()] == [3.0]


def test_strict_matching_raises(spark):
    v = spark.createDataFrame([({"a": "1", "b": "1"}, 0, 1.0), ({"a": "1", "b": "2"}, 0, 2.0)], "labels map<string,string>, eval_ts bigint, value double")
    with pytest.raises(Exception, match="several series"):
        M.binary(v, v, "+", on=["a"], strict=True).collect()
    assert len(M.binary(v, v, "+", on=["a"]).collect()) == 1


def test_top_of_a_single_series_is_that_series(spark):
    s = samples(spark, *[(A, 60_000 * k, float(k)) for k in range(5)])
    v = M.instant(s, Grid(0, 240_000, 60_000))
    assert values(M.top(v, 1)) == values(v) == values(M.aggregate(v, "sum", without=[]))


def test_rollup_agrees_with_raw(spark):
    s = samples(spark, *[({"job": j}, 7_000 * k, float(k % 13)) for k in range(2000) for j in "ab"])
    rolled = M.rollup_again(M.rollup(s, 300_000), 1_800_000)
    for a in ("sum", "avg", "min", "max", "count", "last"):
        raw = {r.bucket: r.value for r in M.time_space(s, 3_600_000, a, "sum").collect()}
        up = {r.bucket: r.value for r in M.from_rollup(rolled, 3_600_000, a).collect()}
        assert raw.keys() == up.keys() and all(math.isclose(raw[k], up[k]) for k in raw), a
    assert M.pick_table(10 * 86_400_000, "p99") == "raw" and M.pick_table(10 * 86_400_000, "sum") == "30m" and M.pick_table(7_200_000, "avg") == "5m"


def test_empty_input(spark):
    s = samples(spark).where(F.lit(False)) if False else spark.createDataFrame([], SCHEMA)
    g = Grid(0, 60_000, 60_000)
    assert M.rate(s, g, 60_000).count() == 0
    assert M.absent(M.instant(s, g), g).count() == 2


def windows_of(rows, grid, span):
    for labels in {tuple(sorted(r[0].items())) for r in rows}:
        own = sorted((ts, v) for r, ts, v in rows if tuple(sorted(r.items())) == labels)
        for k in range(grid.size):
            at = grid.start + k * grid.step
            if held := [(ts, v) for ts, v in own if at - span <= ts <= at]:
                yield (labels, at), held


@pytest.mark.parametrize("span", [60_000, 600_000, 1_234_567, 900_000])
def test_long_windows_equal_their_samples(spark, span):
    """Windows of one to many steps, on and between steps, with gaps, far times and large values that nearly cancel."""
    rng, start = random.Random(span), 1_704_067_200_000
    rows = [({"job": j}, start + rng.choice([60_000 * k, 60_000 * k + rng.randrange(60_000)]), 1e9 + rng.randrange(100)) for j in "ab" for k in range(-20, 90) if rng.random() < 0.4]
    rows += [({"job": "c"}, start + 60_000 * k, 7.0) for k in (0, 40)]
    grid = Grid(start, start + 60 * 60_000, 60_000)
    want = dict(windows_of(rows, grid, span))
    s = samples(spark, *rows).repartition(3)
    assert values(M.over_time(s, grid, span, "count")) == {k: float(len(h)) for k, h in want.items()}
    assert values(M.over_time(s, grid, span, "max")) == {k: max(v for _, v in h) for k, h in want.items()}
    got = values(M.over_time(s, grid, span, "stdvar"))
    assert got.keys() == want.keys()
    for k, h in want.items():
        assert math.isclose(got[k], statistics.pvariance([Fraction(v) for _, v in h]), rel_tol=1e-6, abs_tol=1e-4)
    got = values(M.regression(s, grid, span))
    for k, h in want.items():
        if len({t for t, _ in h}) > 1:
            slope = statistics.linear_regression([(t - start) / 1000 for t, _ in h], [v - 1e9 for _, v in h]).slope
            assert math.isclose(got[k], slope, rel_tol=1e-5, abs_tol=1e-7)


def test_infinities_stay_in_their_windows(spark):
    rows = [(A, 60_000 * k, float("inf") if k == 3 else float("nan") if k == 30 else float(k)) for k in range(60)]
    grid = Grid(0, 59 * 60_000, 60_000)
    got = values(M.over_time(samples(spark, *rows), grid, 600_000, "stdvar"))
    for (key, at), held in windows_of(rows, grid, 600_000):
        finite = all(math.isfinite(v) for _, v in held)
        assert math.isfinite(got[key, at]) == finite or len(held) == 1
        if finite:
            assert math.isclose(got[key, at], statistics.pvariance([v for _, v in held]), abs_tol=1e-9)


def test_a_window_merges_a_few_states_however_long(spark):
    s = spark.range(20_000).select(F.lit("m").alias("metric"), F.create_map(F.lit("job"), F.lit("a")).alias("labels"), (F.col("id") * 7_000).alias("unix_milli"), F.col("id").cast("double").alias("value"))
    grid = Grid(0, 1_440 * 60_000, 60_000)
    base = grid.bases(M.keyed(s), 1_440 * 60_000).groupBy("key", "_k", "_d").agg(F.count("*").alias("n"))
    rows = M.in_windows(base, grid, 1_440 * 60_000, lambda run: {"n": F.sum("n").over(run)}, ["n"]).groupBy("key", "eval_ts").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    most, least = rows.agg(F.max("rows"), F.min("n")).first()
    assert most <= 4 and least >= 1


def test_sketched_quantiles_and_deviations_of_long_windows_are_near_the_exact_ones(spark):
    """Rank errors of windows of many samples and steps; windows of few samples give one of them."""
    import numpy as np

    step, w = 60_000, 40 * 60_000
    data = spark.range(20_000).selectExpr("'m' AS metric", "map('s', cast(id % 2 AS string)) AS labels", "id * 500 AS unix_milli", "pow(abs(hash(id)) % 10007, 1.5) * (1 - 2 * (id % 2)) AS value")
    grid = Grid(0, 10_000_000, step)
    held: dict = {}
    for r in data.collect():
        held.setdefault(r.labels["s"], []).append((r.unix_milli, r.value))
    series = {s: np.array(sorted(x)) for s, x in held.items()}
    rank = lambda v, x: ((v < x).mean(), (v <= x).mean())
    found = 0
    for q in (0.0, 0.5, 0.9, 1.0):
        for r in M.quantile_over_time(data, grid, w, q).collect():
            t, v = series[r.labels["s"]].T
            low, high = rank(v[(t >= r.eval_ts - w) & (t <= r.eval_ts)], r.value)
            assert low - 0.03 <= q <= high + 0.03
            found += 1
    assert found == 4 * 2 * grid.size - 4  # the second series begins after the first step
    for r in M.mad_over_time(data, grid, w).collect():
        t, v = series[r.labels["s"]].T
        v = v[(t >= r.eval_ts - w) & (t <= r.eval_ts)]
        if len(v) > 100:
            low, high = rank(np.abs(v - np.median(v)), r.value)
            assert low - 0.06 <= 0.5 <= high + 0.06


def test_sketched_quantiles_pass_over_nan_and_null(spark):
    rows = [("m", {"s": "a"}, 1000 * i, v) for i, v in enumerate([1.0, float("nan"), None, 3.0, 2.0])] + [("m", {"s": "b"}, 1000, float("nan"))]
    s = spark.createDataFrame(rows, "metric string, labels map<string,string>, unix_milli bigint, value double")
    got = M.quantile_over_time(s, Grid(5000, 5000, 1000), 10_000, 1.0).collect()
    assert [(r.labels["s"], r.value) for r in got] == [("a", 3.0)]
    assert M.quantile_over_time(s, Grid(5000, 5000, 1000), 10_000, 2.0).where("labels['s'] = 'a'").first().value == float("inf")


def test_increases_halfway_between_two_roundings_are_as_in_sql(spark, tmp_path):
    """Seventeen samples of whole cents in a window: their mean distance makes halves of the sixth digit."""
    import duckdb

    from tellurion.plans import metric_queries as Q

    rng = random.Random(17)
    rows = [(k, f"2024-01-{d:02d} {h:02d}:{10 + m * 40 // 17:02d}:00", u, "view", rng.randrange(1, 40_000) / 100, '{"k": 1}') for k, (d, h, m, u) in enumerate((d, h, m, u) for u in range(300) for d in (3, 4) for h in (1,) for m in range(17))]
    spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(Q.SQL["b06_increase"]).fetchall()
    got = [(r.uid, r.type, r.eval_ts, r.value) for r in Q.QUERIES["b06_increase"](spark, str(tmp_path)).collect()]
    assert len(want) > 500 and sorted(got) == sorted(want)
