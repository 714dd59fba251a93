"""Work that must grow with the input, on small tables with crowded keys."""

from __future__ import annotations

from tellurion.operators import telemetry as T

from .measures import shuffled


def test_nearest_rows_of_a_crowded_bucket_are_not_paired(spark):
    logs = spark.range(20_000).selectExpr("id", "id DIV 10 AS ms")
    targets = logs.where("id % 20 = 0").selectExpr("id AS target_id", "ms AS target_ms")
    assert shuffled(spark, T.nearest_in_time(targets, logs, 5, 1_000_000)) < 2_000_000


def test_nearest_rows_by_key_pass_over_copies_of_the_target(spark):
    logs = spark.createDataFrame([(1, 100, "a"), (1, 100, "a"), (1, 100, "a"), (2, 100, "a"), (3, 100, "b"), (4, 99, "a"), (5, 101, "a"), (6, 98, None), (7, None, "a")], "id bigint, ms bigint, host string")
    found = T.nearest_in_time(logs.where("id = 1 and host = 'a'").selectExpr("id AS target_id", "ms AS target_ms", "host").distinct(), logs, 2, 10, "host")
    assert sorted((r.id, r.offset_ms, r.place) for r in found.collect()) == [(2, 0, 1), (4, -1, -1), (5, 1, 2)]


def test_context_rows_are_not_shuffled(spark):
    logs = spark.range(20_000).selectExpr("id AS event_id", "id DIV 10 AS ms", "id % 40 AS trace")
    targets = logs.where("event_id % 20 = 0").selectExpr("event_id AS target_id", "ms AS target_ms", "trace")
    assert shuffled(spark, T.log_context(targets, logs, 100)) < 2_000_000


def test_context_rows_without_a_trace_and_repeated(spark):
    logs = spark.createDataFrame([(1, 100, "a"), (2, 101, None), (3, 5_000, "a"), (3, 5_000, "a"), (4, 102, "a"), (5, 5_000, "b")], "event_id bigint, ms bigint, trace string")
    targets = spark.createDataFrame([(1, 100, "a"), (2, 101, None)], "target_id bigint, target_ms bigint, trace string")
    found = T.log_context(targets, logs, 10)
    assert sorted(map(tuple, found.collect())) == [(1, 1), (1, 2), (1, 3), (1, 3), (1, 4), (2, 1), (2, 2), (2, 4)]


def test_redaction_is_computed_once_a_text(spark):
    from tellurion.operators import usage as U

    docs = spark.createDataFrame([("call 212-555-0100 or a@b.co",)], "text string")
    kinds = docs.select(U.pii_kinds("text").alias("kinds"))
    plan = kinds._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") <= 6
    assert kinds.first().kinds == ["email", "phone"]


def test_nearest_holds_bounded_matrices(spark):
    from tellurion.operators import usage as U

    assert [(p.start, p.stop) for p in U._parts(5, U.MATRIX // 2)] == [(0, 2), (2, 4), (4, 6)]
    assert [p.start for p in U._parts(2, 10 * U.MATRIX)] == [0, 1] and list(U._parts(0, 7)) == []


def test_posting_lists_do_not_carry_parities(spark):
    from tellurion.llm import minhash

    sets = spark.range(200).selectExpr("id AS set", "10 AS size", "array(id, id DIV 2) AS bytes", "array_repeat(id, 16) AS parity")
    lists = minhash.posting_lists(sets)
    assert set(lists.columns) == {"t", "key", "set", "size", "n", "centres"}
    assert sorted({(r.t, r.n) for r in lists.collect()}) == [(1, 2)]


def test_long_windows_of_sparse_series_shuffle_samples_not_steps(spark):
    from tellurion.functions.grid import Grid
    from tellurion.operators import metrics as M

    series = spark.range(4_000).selectExpr("'m' AS metric", "map('uid', cast(id % 400 AS string)) AS labels", "(id * 7919 % 1000) * 60000 AS unix_milli", "cast(id % 13 AS double) AS value")
    grid = Grid(0, 60_000_000, 60_000)
    # a window holds 200 steps: a row a step and series would be half a million
    for v in (M.rate(series, grid, 12_000_000), M.over_time(series, grid, 12_000_000, "stddev"), M.regression(series, grid, 12_000_000), M.over_time(series, grid, 12_000_000, "avg")):
        assert shuffled(spark, v) < 1_000_000


def test_long_windows_over_stretches_gaps_and_edges_are_those_of_brute_force(spark):
    """Windows of about six steps that are no whole number of them, samples before and after the grid and on its steps, dense and sparse series."""
    import math
    import random
    import statistics

    from tellurion.functions.grid import Grid
    from tellurion.operators import metrics as M

    rng, grid = random.Random(5), Grid(1_000, 401_000, 1_000)
    rows = [("m", {"s": s}, t, float(rng.randrange(-50, 50))) for s, n in (("dense", 900), ("sparse", 25), ("one", 1)) for t in sorted(rng.sample(range(-9_000, 420_000, 250), n))]
    series = spark.createDataFrame(rows, "metric string, labels map<string,string>, unix_milli bigint, value double")
    for span in (6_000, 6_300, 5_900):
        held = {}
        for _, labels, t, v in rows:
            for at in range(grid.start, grid.end + 1, grid.step):
                if at - span <= t <= at:
                    held.setdefault((labels["s"], at), []).append((t, v))
        want = {
            "sum": lambda h: sum(v for _, v in h), "count": len, "min": lambda h: min(v for _, v in h), "last": lambda h: max(h)[1], "stdvar": lambda h: statistics.pvariance([v for _, v in h]),
        }
        for name, f in want.items():
            got = M.over_time(series, grid, span, name).collect()
            assert len(got) == len(held)
            assert all(math.isclose(r.value, f(held[r.labels["s"], r.eval_ts]), abs_tol=1e-9) for r in got)
        top = {r.eval_ts: r.value for r in M.aggregate(M.over_time(series, grid, span, "sum", by=[]), "max").collect()}
        assert top == {at: max(sum(v for _, v in h) for (_, a), h in held.items() if a == at) for at in {a for _, a in held}}


def test_percentiles_of_versions_hold_no_table_of_values(spark):
    rows = [("a", 5, 1_000_000 * v) for v in (1, 1, 2, 10)] + [("b", 6, 3_000_000), ("c", 7, None), (None, 8, 4_000_000), (None, 8, 5_000_000)]
    spans = spark.createDataFrame(rows, "version string, at int, duration_ns bigint").selectExpr("version", "timestamp_seconds(at) AS ts", "duration_ns", "at = 5 AS error")
    found = T.versions(spans, exact=True)
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r.version: (r.requests, r.errors, r.p50_ms, r.p90_ms, r.p99_ms) for r in found.collect()}
    assert got == {"a": (4, 4, 1.5, 7.6, 9.76), "b": (1, 0, 3.0, 3.0, 3.0), "c": (1, 0, None, None, None), None: (2, 0, 4.5, 4.9, 4.99)}
