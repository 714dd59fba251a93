"""Operators on labelled metric series.

Samples have the columns metric, labels (map), unix_milli and value. Vectors have labels, eval_ts and value. Range
functions aggregate the samples between two steps to a state first. For windows of a few steps the states fan out to the
steps that hold them and merge by (series, step). For longer ones the steps of a series are cut into blocks as long as a
window: a window is the end of one block and the beginning of the next, and states run up to each step from the
beginning and down to it from the end of its block, so that a window merges four states at most, however many steps it
holds. Such windows stay ranges of steps with equal samples until their values are known, so that what is sorted and
shuffled grows with the samples, not with the steps that hold them. Deviations and regressions have such states as well (numbers, means and moments about them, merged by Chan's
formulas), and quantiles have sketches; only exact quantiles fan out samples. Functions of neighbouring samples compute the neighbour once per series before
that, in time chunks, so that one very long series does not have to be sorted by one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions.grid import Grid

LOOKBACK = 300_000
CHUNK = 86_400_000
#: Windows of more steps go by blocks.
FEW_STEPS = 4
#: Steps of a series, in lengths of a window, that are one group; its samples within a window's length before go there too.
STRETCH = 16
NAN = float("nan")
INF = float("inf")


# --- selection -----------------------------------------------------------------------------------------------


def select_series(samples: DataFrame, metric: str | None = None, *matchers: tuple[str, str, str]) -> DataFrame:
    """matchers: (label, one of = != =~ !~, value). Patterns match whole values; `__name__` is the metric."""
    if metric is not None:
        samples = samples.where(F.col("metric") == metric)
    for name, op, value in matchers:
        field = F.col("metric") if name == "__name__" else L.get("labels", name)
        if op in ("=~", "!~"):
            if value == ".*":
                hit = F.lit(True)
            elif value == ".+":
                hit = field != ""
            else:
                hit = field.rlike(f"^(?:{value})$")
        else:
            hit = field == value
        samples = samples.where(hit if op in ("=", "=~") else ~hit)
    return samples


def offset(samples: DataFrame, millis: int) -> DataFrame:
    return samples.withColumn("unix_milli", F.col("unix_milli") + millis).where(~F.isnan("value"))


def keyed(samples: DataFrame) -> DataFrame:
    """Samples with the series as one string, `key`."""
    return samples.withColumn("key", L.key("labels")).drop("labels")


def one_per_time(series: DataFrame, counter: bool) -> DataFrame:
    """One sample per series and time: the greatest for counters, the last to arrive for gauges."""
    arrival = "seq" if "seq" in series.columns else "value"
    value = F.max("value") if counter else F.max_by("value", arrival)
    return series.groupBy("metric", "key", "unix_milli").agg(value.alias("value"))


def with_previous(series: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds prev_ts and prev_value of the sample before in its series, by chunks of time and their last samples."""
    part = series.withColumn("_c", F.floor(F.col("unix_milli") / chunk))
    w = Window.partitionBy("metric", "key", "_c").orderBy("unix_milli")
    now = F.struct(F.col("unix_milli").alias("t"), F.col("value").alias("v"))
    part = part.withColumn("_p", F.lag(now).over(w))
    tails = part.groupBy("metric", "key", "_c").agg(F.max_by(now, "unix_milli").alias("_tail"))
    before = tails.withColumn("_before", F.lag("_tail").over(Window.partitionBy("metric", "key").orderBy("_c"))).drop("_tail")
    joined = part.join(before, ["metric", "key", "_c"])
    p = F.coalesce("_p", "_before")
    return joined.withColumn("prev_ts", p["t"]).withColumn("prev_value", p["v"]).drop("_c", "_p", "_before")


# --- instant and range vectors -------------------------------------------------------------------------------


def vector(grouped: DataFrame, grid: Grid | None = None, by: list[str] | None = None) -> DataFrame:
    """(key, eval_ts, value) as a vector; steps without a value go. With _from and _to of the grid instead of eval_ts, a row
    stands for these steps. by: as series_of()."""
    rows = grouped.where(F.col("value").isNotNull())
    name, series = series_of(by)
    return stepped(rows.select(series, *steps_of(rows), "value"), grid).select(name, "eval_ts", "value")


def series_of(by: list[str] | None = None) -> tuple[str, Column]:
    """The column of a vector that tells its series, from their keys: labels, or `key` of some of them. Such a vector is for
    aggregate() by these labels: the key is made before ranges become steps."""
    return ("labels", L.from_key("key").alias("labels")) if by is None else ("key", L.key(L.only(L.from_key("key"), by)).alias("key"))


def stepped(rows: DataFrame, grid: Grid) -> DataFrame:
    """Rows of ranges of steps as rows of a step each; others as they are."""
    return grid.spread(rows) if "_from" in rows.columns else rows


def steps_of(rows: DataFrame) -> list[str]:
    return [c for c in ("eval_ts", "_from", "_to") if c in rows.columns]


def instant(samples: DataFrame, grid: Grid, lookback: int = LOOKBACK) -> DataFrame:
    """The newest sample within the look-back; a newest sample that is NaN or null ends the series there."""
    newest = merged(keyed(samples), grid, lookback, {"s": (F.max(F.struct("unix_milli", "value")), F.max)})
    return vector(newest.select("key", *steps_of(newest), F.when(~F.isnan("s.value"), F.col("s.value")).alias("value")), grid)


def _sum(*parts: Column) -> Column:
    return F.when(F.coalesce(*parts).isNotNull(), reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0)) for p in parts)))


def _sketch(*parts: Column) -> Column:
    return reduce(lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.kll_sketch_merge_double(a, b)), parts)


#: What merges states of a group, and of a row.
OF_ROW = {F.sum: _sum, F.min: F.least, F.max: F.greatest, F.kll_merge_agg_double: _sketch}


def merged(series: DataFrame, grid: Grid, span: int, states: dict[str, tuple[Column, Callable]]) -> DataFrame:
    """(key, eval_ts), or (key, _from, _to) for all steps between, and the states over each window. states: name -> (aggregate
    of samples, aggregate function of such states)."""
    base = grid.bases(series, span).groupBy("key", "_k", "_d").agg(*(first.alias(n) for n, (first, _) in states.items()))
    running = lambda run: {n: again(n).over(run) for n, (_, again) in states.items()}
    if few(grid, span):
        return in_windows(base, grid, span, running, list(states)).groupBy("key", "eval_ts").agg(*(again(n).alias(n) for n, (_, again) in states.items()))
    same = same_windows(base, grid, span, running, list(states))
    return same.select("key", "_from", "_to", *(OF_ROW[again](*(F.col(p)[n] for p in PARTS)).alias(n) for n, (_, again) in states.items()))


def few(grid: Grid, span: int) -> bool:
    return span // grid.step < FEW_STEPS


def in_windows(base: DataFrame, grid: Grid, span: int, running: Callable, names: list[str], about: Callable | None = None) -> DataFrame:
    """States (key, _k, _d, names) as (key, eval_ts, names): each window's samples are those of its rows, each once.

    running: of a window that runs over a block's states, the merged states by name; about: of a window of the whole block,
    columns that running may use.
    """
    if few(grid, span):
        spread = base.withColumn("_from", F.col("_k")).withColumn("_to", F.col("_k") + F.col("_d"))
        return grid.spread(spread).select("key", "eval_ts", *names)
    return grid.spread(ranges(base, running, names, about)).select("key", "eval_ts", *names)


def ranges(base: DataFrame, running: Callable, names: list[str], about: Callable | None = None, *by: str) -> DataFrame:
    """States as for in_windows() as (key, by, _d, _tail, _from, _to, names): of each _d and _tail no two of a series hold the
    same step."""
    # a window of length w ends in a block (its steps up to there) and begins in the one before (from there to its end);
    # only a window that is a whole block has no such part
    width = F.col("_d") + 1
    base = base.withColumn("_b", F.floor(F.col("_k") / width))
    block = Window.partitionBy("key", *by, "_d", "_b")
    up, down = block.orderBy("_k"), block.orderBy(F.desc("_k"))
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = base.withColumns(about(whole)) if about else base
    begin, k = F.col("_b") * width, F.col("_k")
    head = F.struct(F.lit(False).alias("_tail"), k.alias("_from"), (F.coalesce(F.lead("_k").over(up), begin + width) - 1).alias("_to"), *(c.alias(n) for n, c in running(up).items()))
    tail = F.struct(F.lit(True).alias("_tail"), (F.coalesce(F.lag("_k").over(up), begin) + 1 + F.col("_d")).alias("_from"), (k + F.col("_d")).alias("_to"), *(c.alias(n) for n, c in running(down).items()))
    both = base.select("key", *by, "_d", head.alias("_head"), tail.alias("_last"))
    return both.select("key", *by, "_d", F.explode(F.array("_head", "_last")).alias("_x")).select("key", *by, "_d", "_x.*")


#: The states that make up a window, null where there is none: one of each _d and side.
PARTS = ("_p0", "_p1", "_p2", "_p3")


def same_windows(base: DataFrame, grid: Grid, span: int, running: Callable, names: list[str], about: Callable | None = None) -> DataFrame:
    """States as for in_windows() as (key, _from, _to, PARTS): the windows of all steps between hold the same samples, those
    of PARTS. Two or three rows for a state, however many windows hold it; a group is a stretch of steps of a series."""
    most, stretch = span // grid.step, STRETCH * (span // grid.step + 1)
    first, last = F.floor(F.col("_k") / stretch), F.floor((F.col("_k") + most) / stretch)
    groups = base.withColumn("_g", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last)))).repartition("key", "_g")
    low = F.greatest(F.col("_from"), F.col("_g") * stretch, F.lit(0))
    high = F.least(F.col("_to"), F.col("_g") * stretch + stretch - 1, F.lit(grid.size - 1))
    part = (most - F.col("_d")) * 2 + F.col("_tail").cast("int")
    cut = ranges(groups, running, names, about, "_g").select("key", "_g", part.alias("_part"), low.alias("_from"), high.alias("_to"), F.struct(*names).alias("_state")).where("_from <= _to")
    # a state comes and goes; between two such points nothing changes
    come = F.struct(F.col("_from").alias("_at"), F.lit(True).alias("_come"), "_state")
    go = F.struct((F.col("_to") + 1).alias("_at"), F.lit(False).alias("_come"), F.lit(None).alias("_state"))
    points = cut.select("key", "_g", "_part", F.explode(F.array(come, go)).alias("_x")).select("key", "_g", "_part", "_x.*")
    w = Window.partitionBy("key", "_g").orderBy("_at", "_come")
    newest = {p: F.last(F.when(F.col("_part") == i, F.struct("_state")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))["_state"] for i, p in enumerate(PARTS)}
    known = points.select("key", F.col("_at").alias("_from"), (F.lead("_at").over(w) - 1).alias("_to"), *(c.alias(p) for p, c in newest.items()))
    return known.where((F.col("_from") <= F.col("_to")) & F.coalesce(*PARTS).isNotNull())


def moments(series: DataFrame, grid: Grid, span: int) -> DataFrame:
    """(key, eval_ts), or (key, _from, _to) as merged(), n, mx, my, sxx, syy, sxy: number, means, and sums of squares and
    products about them, of time in seconds since the grid's start and value over each window; low, high (values) and last
    (time). Null values do not count."""
    t = (F.col("unix_milli") - (F.lit(grid.start) + F.col("_k") * grid.step)) / 1000.0  # small, whatever the time
    own = grid.bases(series.where(F.col("value").isNotNull()), span).withColumn("_t", t).groupBy("key", "_k", "_d").agg(
        F.count("*").alias("n"), (F.first("_k") * grid.step / 1000.0 + F.avg("_t")).alias("mx"), F.avg("value").alias("my"), F.var_pop("_t").alias("sxx"), F.var_pop("value").alias("syy"), F.covar_pop("_t", "value").alias("sxy"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.max("unix_milli").alias("last"),
    )
    own = own.withColumns({c: F.col(c) * F.col("n") for c in ("sxx", "syy", "sxy")})
    names = ["n", "mx", "my", "sxx", "syy", "sxy", "low", "high", "last"]

    def about(whole) -> dict[str, Column]:
        # the mean of a state of the same block, so that no large squares are subtracted
        finite = F.first(F.when(F.abs("my") < INF, F.col("my")), ignorenulls=True).over(whole)
        return {"_cx": F.first("mx").over(whole), "_cy": F.coalesce(finite, F.lit(0.0))}

    def running(run) -> dict[str, Column]:
        n, dx, dy = F.sum("n").over(run), F.col("mx") - F.col("_cx"), F.col("my") - F.col("_cy")
        x, y = F.sum(F.col("n") * dx).over(run), F.sum(F.col("n") * dy).over(run)
        square = lambda own, a, b, total: F.sum(F.col(own) + F.col("n") * a * b).over(run) - total / n
        return {
            "n": n, "mx": F.col("_cx") + x / n, "my": F.col("_cy") + y / n, "sxx": square("sxx", dx, dx, x * x), "syy": square("syy", dy, dy, y * y), "sxy": square("sxy", dx, dy, x * y),
            "low": F.min("low").over(run), "high": F.max("high").over(run), "last": F.max("last").over(run),
        }

    if few(grid, span):
        state = F.struct("n", "mx", "my", "sxx", "syy", "sxy")
        grouped = in_windows(own, grid, span, running, names, about).groupBy("key", "eval_ts").agg(F.collect_list(state).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("last").alias("last"))
    else:
        states = F.filter(F.array(*(F.when(F.col(p).isNotNull(), F.struct(*(F.col(p)[n].alias(n) for n in names[:6]))) for p in PARTS)), lambda s: s.isNotNull())
        bound = lambda n, of: of(*(F.col(p)[n] for p in PARTS)).alias(n)
        grouped = same_windows(own, grid, span, running, names, about).select("key", "_from", "_to", states.alias("s"), bound("low", F.least), bound("high", F.greatest), bound("last", F.greatest))
    # a few states a window, merged two at a time
    whole = F.aggregate(F.slice("s", 2, F.size("s")), F.get("s", F.lit(0)), _both)
    steps = steps_of(grouped)
    return grouped.select("key", *steps, whole.alias("m"), "low", "high", "last").select("key", *steps, "m.*", "low", "high", "last")


def _both(a: Column, b: Column) -> Column:
    """Moments of two sets of samples together."""
    n, dx, dy = a["n"] + b["n"], b["mx"] - a["mx"], b["my"] - a["my"]
    share, joint = b["n"] / n, a["n"] * b["n"] / n
    return F.struct(
        n.alias("n"), (a["mx"] + dx * share).alias("mx"), (a["my"] + dy * share).alias("my"), (a["sxx"] + b["sxx"] + dx * dx * joint).alias("sxx"), (a["syy"] + b["syy"] + dy * dy * joint).alias("syy"),
        (a["sxy"] + b["sxy"] + dx * dy * joint).alias("sxy"),
    )


def extrapolated(samples: DataFrame, grid: Grid, span: int, counter: bool = True, per_second: bool = True, by: list[str] | None = None) -> DataFrame:
    """rate (counter, per second), increase (counter), delta (neither): change within the window, stretched to its edges.
    by: as series_of()."""
    name, labels = series_of(by)
    series = one_per_time(keyed(samples), counter)
    if counter:
        series = with_previous(series).withColumn("drop", F.when(F.col("value") < F.col("prev_value"), F.col("prev_value")).otherwise(0.0))
    else:
        series = series.withColumn("drop", F.lit(0.0))
    w = merged(series, grid, span, {
        "n": (F.count("*"), F.sum), "first": (F.min(F.struct("unix_milli", "value", "drop")), F.min), "last": (F.max(F.struct("unix_milli", "value")), F.max), "drops": (F.sum("drop"), F.sum),
    })
    w = w.where("n >= 2").select(labels, *steps_of(w), "n", F.col("first.unix_milli").alias("t0"), F.col("last.unix_milli").alias("t1"), F.col("first.value").alias("v0"), F.col("last.value").alias("v1"), (F.col("drops") - F.col("first.drop")).alias("resets"))
    change = F.col("v1") - F.col("v0") + F.col("resets")
    w = w.withColumn("change", change).withColumn("len", (F.col("t1") - F.col("t0")).cast("double")).withColumn("mean", F.col("len") / (F.col("n") - 1))
    w = stepped(w, grid)
    head = (F.col("t0") - F.col("eval_ts") + span).cast("double")
    if counter:
        head = F.when((F.col("change") > 0) & (F.col("v0") >= 0), F.least(head, F.try_divide(F.col("len") * F.col("v0"), "change"))).otherwise(head)
    tail = (F.col("eval_ts") - F.col("t1")).cast("double")
    edge = lambda d: F.when(d < F.col("mean") * 1.1, d).otherwise(F.col("mean") / 2)
    # products before quotients: a rounded quotient would push values that lie halfway between two roundings to either side
    value = F.col("change") * (F.col("len") + edge(head) + edge(tail)) / F.col("len") / (span / 1000 if per_second else 1.0)
    return w.select(name, "eval_ts", value.alias("value")).where(F.col("value").isNotNull())


def rate(samples: DataFrame, grid: Grid, span: int, by: list[str] | None = None) -> DataFrame:
    return extrapolated(samples, grid, span, by=by)


def increase(samples: DataFrame, grid: Grid, span: int) -> DataFrame:
    return extrapolated(samples, grid, span, per_second=False)


def delta(samples: DataFrame, grid: Grid, span: int) -> DataFrame:
    return extrapolated(samples, grid, span, counter=False, per_second=False)


def last_two(samples: DataFrame, grid: Grid, span: int, per_second: bool) -> DataFrame:
    """irate (per second, a drop counts as a restart) or idelta."""
    series = with_previous(one_per_time(keyed(samples), counter=per_second))
    last = merged(series, grid, span, {"s": (F.max(F.struct("unix_milli", "value", "prev_ts", "prev_value")), F.max)})
    diff = F.col("s.value") - F.col("s.prev_value")
    if per_second:
        diff = F.when(F.col("s.value") < F.col("s.prev_value"), F.col("s.value")).otherwise(diff) / ((F.col("s.unix_milli") - F.col("s.prev_ts")) / 1000.0)
    last = stepped(last.select(L.from_key("key").alias("labels"), *steps_of(last), F.col("s.prev_ts").alias("before"), diff.alias("value")), grid)
    return last.where(F.col("value").isNotNull() & (F.col("before") >= F.col("eval_ts") - span)).select("labels", "eval_ts", "value")


def regression(samples: DataFrame, grid: Grid, span: int, ahead: float | None = None) -> DataFrame:
    """deriv, or with `ahead` seconds predict_linear from the last sample's time."""
    w = moments(keyed(samples), grid, span).where("n >= 2")
    flat = F.col("low") == F.col("high")
    finite = ~F.isnan("low") & (F.abs("low") < INF)
    slope = F.try_divide("sxy", "sxx")
    if ahead is None:
        value = F.when(flat, F.when(finite, 0.0)).otherwise(slope)
    else:
        at_last = F.col("my") + slope * ((F.col("last") - grid.start) / 1000.0 - F.col("mx"))
        value = F.when(flat, F.when(finite, F.col("low"))).otherwise(slope * ahead + at_last)
    return vector(w.select("key", *steps_of(w), value.alias("value")), grid)


def steps_between(samples: DataFrame, grid: Grid, span: int, drops: bool) -> DataFrame:
    """changes, or with `drops` resets (greatest value per time first)."""
    series = with_previous(one_per_time(keyed(samples), counter=drops))
    v, p = F.col("value"), F.col("prev_value")
    hit = (v < p) if drops else ((v != p) & ~(F.isnan(v) & F.isnan(p)))
    series = series.withColumn("hit", F.when(p.isNotNull() & hit, 1).otherwise(0))
    w = merged(series, grid, span, {"hits": (F.sum("hit"), F.sum), "first": (F.min(F.struct("unix_milli", "hit")), F.min)})
    return vector(w.select("key", *steps_of(w), (F.col("hits") - F.col("first.hit")).cast("double").alias("value")), grid)


#: States over a window, as for merged(), and the value of the last of them.
OVER_TIME = {
    "avg": ({"total": (F.sum, "value", F.sum), "n": (F.count, "value", F.sum)}, lambda: F.try_divide("total", "n")),
    "min": ({"x": (F.min, "value", F.min)}, lambda: F.col("x")),
    "max": ({"x": (F.max, "value", F.max)}, lambda: F.col("x")),
    "sum": ({"x": (F.sum, "value", F.sum)}, lambda: F.col("x")),
    "count": ({"x": (F.count, "value", F.sum)}, lambda: F.col("x").cast("double")),
    "last": ({"x": (lambda _: F.max(F.struct("unix_milli", "value")), "", F.max)}, lambda: F.col("x.value")),
    "present": ({"x": (F.count, "*", F.sum)}, lambda: F.lit(1.0)),
}
DEVIATIONS = {"stdvar": lambda: F.greatest(F.col("syy"), F.lit(0.0)) / F.col("n"), "stddev": lambda: F.sqrt(F.greatest(F.col("syy"), F.lit(0.0)) / F.col("n"))}


def over_time(samples: DataFrame, grid: Grid, span: int, function: str, by: list[str] | None = None) -> DataFrame:
    """by: as series_of()."""
    if function in DEVIATIONS:
        w = moments(keyed(samples), grid, span)
        return vector(w.select("key", *steps_of(w), DEVIATIONS[function]().alias("value")), grid, by)
    states, value = OVER_TIME[function]
    w = merged(keyed(samples), grid, span, {n: (first(column), again) for n, (first, column, again) in states.items()})
    return vector(w.select("key", *steps_of(w), value().alias("value")), grid, by)


def quantile_column(q: float, value: str = "value") -> Column:
    if q != q:
        return F.lit(NAN)
    if not 0 <= q <= 1:
        return F.lit(-INF if q < 0 else INF)
    return F.percentile(value, F.lit(q))


def quantile_over_time(samples: DataFrame, grid: Grid, span: int, q: float, exact: bool = False) -> DataFrame:
    """Exact and interpolated, from a copy of each sample for every window that holds it, or a value of about that rank (some
    1.3 percent of ranks off) from sketches by step that merge over the window. Sketches pass over NaN."""
    if exact or not 0 <= q <= 1:
        return vector(grid.fan_out(keyed(samples), span).groupBy("key", "eval_ts").agg(F.count("*").alias("n"), quantile_column(q).alias("value")).drop("n"))
    w = sketched(samples, grid, span)
    return vector(w.select("key", *steps_of(w), F.kll_sketch_get_quantile_double("s", F.lit(float(q))).alias("value")), grid)


def sketched(samples: DataFrame, grid: Grid, span: int) -> DataFrame:
    """(key, eval_ts, s), or ranges as merged(): a quantile sketch of the values of each window that has any; its size is bounded."""
    states = merged(keyed(samples.where("value is not null and not isnan(value)")), grid, span, {"s": (F.kll_sketch_agg_double("value"), F.kll_merge_agg_double)})
    return states.where(F.kll_sketch_get_n_double("s") > 0)


#: Values, evenly spread over the ranks, that stand for a window where a median deviation comes from its sketch.
RANKS = 200


def mad_over_time(samples: DataFrame, grid: Grid, span: int, exact: bool = False) -> DataFrame:
    """Median absolute deviation: from the sorted values of each window, or from RANKS values of its sketch, evenly spread
    over the ranks."""
    if exact:
        w = grid.fan_out(keyed(samples), span).groupBy("key", "eval_ts").agg(F.array_sort(F.collect_list("value")).alias("v"))
    else:
        ranks = F.array(*(F.lit((i + 0.5) / RANKS) for i in range(RANKS)))
        w = sketched(samples, grid, span)
        w = w.select("key", *steps_of(w), F.kll_sketch_get_quantile_double("s", ranks).alias("v"))
    middle = lambda a: (F.element_at(a, ((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, (F.size(a) / 2).cast("int") + 1)) / 2
    w = w.where(F.size("v") > 0).withColumn("m", middle(F.col("v")))
    return vector(w.select("key", *steps_of(w), middle(F.array_sort(F.transform("v", lambda x: F.abs(x - F.col("m"))))).alias("value")), grid)


def absent_over_time(samples: DataFrame, grid: Grid, span: int) -> DataFrame:
    return _absent(samples.sparkSession, grid, grid.fan_out(samples, span))


def absent(v: DataFrame, grid: Grid) -> DataFrame:
    return _absent(v.sparkSession, grid, v)


def _absent(spark: SparkSession, grid: Grid, present: DataFrame) -> DataFrame:
    steps = grid.frame(spark).join(present.select("eval_ts").distinct(), "eval_ts", "left_anti")
    return steps.select(F.create_map().cast("map<string,string>").alias("labels"), "eval_ts", F.lit(1.0).alias("value"))


def subquery(inner: DataFrame) -> DataFrame:
    """A vector as samples again, for a range function over it. Its grid must begin a range before the outer one."""
    return inner.select(F.lit("").alias("metric"), "labels", F.col("eval_ts").alias("unix_milli"), "value")


# --- aggregation ---------------------------------------------------------------------------------------------


def grouped_labels(by: list[str] | None = None, without: list[str] | None = None) -> Column:
    return L.without("labels", without) if without is not None else L.only("labels", by or [])


AGGREGATES = {
    "sum": lambda: F.sum("value"),
    "avg": lambda: F.avg("value"),
    "min": lambda: F.min("value"),
    "max": lambda: F.max("value"),
    "count": lambda: F.count("*").cast("double"),
    "stddev": lambda: F.stddev_pop("value"),
    "stdvar": lambda: F.var_pop("value"),
    "group": lambda: F.lit(1.0),
}


def aggregate(v: DataFrame, op: str, by: list[str] | None = None, without: list[str] | None = None, q: float | None = None) -> DataFrame:
    """Of vectors that were made by some labels: by these."""
    value = quantile_column(q) if op == "quantile" else AGGREGATES[op]()
    if "key" in v.columns and (by or without):
        raise ValueError("the vector has its own labels to aggregate by")
    key = F.col("key") if "key" in v.columns else L.key(grouped_labels(by, without)).alias("key")
    groups = v.select(key, "eval_ts", "value").groupBy("key", "eval_ts")
    return vector(groups.agg(F.count("*").alias("_n"), value.alias("value")))


def top(v: DataFrame, k: int, largest: bool = True, by: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """topk / bottomk per step and group, original labels kept; NaN ranks last, ties go by label set."""
    v = v.withColumn("_g", L.key(grouped_labels(by, without))).withColumn("_key", L.key("labels"))
    order = [F.isnan("value").asc(), F.desc("value") if largest else F.asc("value"), F.asc("_key")]
    ranked = v.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "eval_ts").orderBy(*order)))
    return ranked.where(F.col("_r") <= k).select("labels", "eval_ts", "value")


def count_values(v: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    shown = F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(F.col("value").cast("string"))
    marked = v.select(L.key(L.put(grouped_labels(by), label, shown)).alias("key"), "eval_ts")
    return vector(marked.groupBy("key", "eval_ts").agg(F.count("*").cast("double").alias("value")))


# --- arithmetic and matching ---------------------------------------------------------------------------------


def _divide(a: Column, b: Column) -> Column:
    """IEEE: x/0 is signed infinity, 0/0 is NaN."""
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), F.lit(NAN)).otherwise(F.signum(a) * F.lit(INF))).otherwise(F.try_divide(a, b))


ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": _divide,
    "%": lambda a, b: F.when(b == 0, F.lit(NAN)).otherwise(F.try_mod(a, b)),
    "^": lambda a, b: F.pow(a, b),
    "atan2": lambda a, b: F.atan2(a, b),
}
#: NaN equals nothing and is not less or greater.
_ORDERED = lambda a, b, c: ~F.isnan(a) & ~F.isnan(b) & c
COMPARE = {
    "==": lambda a, b: _ORDERED(a, b, a == b),
    "!=": lambda a, b: F.isnan(a) | F.isnan(b) | (a != b),
    "<": lambda a, b: _ORDERED(a, b, a < b),
    ">": lambda a, b: _ORDERED(a, b, a > b),
    "<=": lambda a, b: _ORDERED(a, b, a <= b),
    ">=": lambda a, b: _ORDERED(a, b, a >= b),
}


def _combine(rows: DataFrame, a: Column, b: Column, op: str, as_bool: bool) -> DataFrame:
    if op in ARITHMETIC:
        return rows.withColumn("value", ARITHMETIC[op](a, b))
    hit = COMPARE[op](a, b)
    return rows.withColumn("value", F.when(hit, 1.0).otherwise(0.0)) if as_bool else rows.where(hit)


def with_scalar(v: DataFrame, op: str, scalar: float, as_bool: bool = False, scalar_first: bool = False) -> DataFrame:
    a, b = F.col("value"), F.lit(float(scalar))
    return _combine(v, *((b, a) if scalar_first else (a, b)), op, as_bool)


def _match_key(on: list[str] | None, ignoring: list[str] | None) -> Column:
    return L.key(L.only("labels", on) if on is not None else L.without("labels", ignoring or []))


def one_per_key(v: DataFrame, strict: bool = False) -> DataFrame:
    """One row per step and match key (`_m`): the least label set; strict raises where there are more."""
    found = v.groupBy("_m", "eval_ts").agg(F.min_by(F.struct("labels", "value"), L.key("labels")).alias("s"), F.count("*").alias("n"))
    if strict:
        found = found.withColumn("s", F.when(F.col("n") > 1, F.raise_error(F.lit("several series for one match key"))).otherwise(F.col("s")))
    return found.select("_m", "eval_ts", "s.labels", "s.value")


def binary(left: DataFrame, right: DataFrame, op: str, on: list[str] | None = None, ignoring: list[str] | None = None, as_bool: bool = False, strict: bool = False) -> DataFrame:
    """One-to-one matching; the result has the labels matched on, comparisons that filter keep the left ones."""
    m = _match_key(on, ignoring)
    a = one_per_key(left.withColumn("_m", m), strict).withColumnRenamed("value", "_a")
    b = one_per_key(right.withColumn("_m", m), strict).select("_m", "eval_ts", F.col("value").alias("_b"))
    rows = _combine(a.join(b, ["_m", "eval_ts"]).withColumn("value", F.col("_a")), F.col("_a"), F.col("_b"), op, as_bool)
    keep = "labels" if op in COMPARE and not as_bool else None
    return rows.select(F.col(keep) if keep else L.from_key("_m").alias("labels"), "eval_ts", "value")


def group_left(many: DataFrame, one: DataFrame, op: str, on: list[str] | None = None, ignoring: list[str] | None = None, extra: list[str] = (), swapped: bool = False) -> DataFrame:
    """Many-to-one: labels of the many side and `extra` labels of the one side. swapped: the one side is the left operand."""
    m = _match_key(on, ignoring)
    b = one_per_key(one.withColumn("_m", m), strict=True).select("_m", "eval_ts", F.col("value").alias("_b"), L.only("labels", list(extra)).alias("_x"))
    rows = many.withColumn("_m", m).join(b, ["_m", "eval_ts"])
    a, c = F.col("value"), F.col("_b")
    out = _combine(rows, *((c, a) if swapped else (a, c)), op, False)
    return out.select(F.map_concat(L.without("labels", list(extra)), "_x").alias("labels"), "eval_ts", "value")


def set_and(left: DataFrame, right: DataFrame, on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    return _half(left, right, on, ignoring, "left_semi")


def set_unless(left: DataFrame, right: DataFrame, on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    return _half(left, right, on, ignoring, "left_anti")


def set_or(left: DataFrame, right: DataFrame, on: list[str] | None = None, ignoring: list[str] | None = None) -> DataFrame:
    return left.unionByName(_half(right, left, on, ignoring, "left_anti"))


def _half(left: DataFrame, right: DataFrame, on: list[str] | None, ignoring: list[str] | None, how: str) -> DataFrame:
    m = _match_key(on, ignoring)
    return left.withColumn("_m", m).join(right.select(m.alias("_m"), "eval_ts").distinct(), ["_m", "eval_ts"], how).drop("_m")


# --- functions of a vector -----------------------------------------------------------------------------------


def histogram_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """Linear interpolation in cumulative `le` buckets. No +Inf bucket: nothing. No observation: NaN. One shuffle."""
    le = F.when(L.get("labels", "le") == "+Inf", F.lit(INF)).otherwise(L.get("labels", "le").try_cast("double"))
    rows = buckets.select(L.key(L.without("labels", ["le"])).alias("key"), "eval_ts", le.alias("le"), "value")
    w = Window.partitionBy("key", "eval_ts").orderBy("le")
    total = F.max(F.when(F.col("le") == INF, F.col("value"))).over(Window.partitionBy("key", "eval_ts"))
    rows = rows.withColumn("below", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("count0", F.coalesce(F.lag("value").over(w), F.lit(0.0))).withColumn("total", total)
    rank = F.lit(q) * F.col("total")
    inner = F.col("below") + F.try_divide(rank - F.col("count0"), F.col("value") - F.col("count0")) * (F.col("le") - F.col("below"))
    point = F.when((F.col("le") == F.col("below")) | (F.col("le") == INF), F.col("below")).otherwise(inner)
    hit = rows.where(F.col("total").isNotNull()).withColumn("x", F.when(F.col("value") >= rank, point))
    found = hit.groupBy("key", "eval_ts").agg(F.min_by("x", F.when(F.col("x").isNotNull(), F.col("le"))).alias("x"), F.max("total").alias("total"))
    value = F.lit(NAN) if not 0 <= q <= 1 else F.when(F.col("total") == 0, F.lit(NAN)).otherwise(F.col("x"))
    return vector(found.select("key", "eval_ts", value.alias("value")))


def explode_histogram(points: DataFrame) -> DataFrame:
    """Rows with bounds, counts, sum and count to cumulative `_bucket`, `_count` and `_sum` samples."""
    cumulative = F.transform("counts", lambda _, i: F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    les = F.concat(F.transform("bounds", lambda b: b.cast("string")), F.array(F.lit("+Inf")))
    pairs = F.arrays_zip(les.alias("le"), cumulative.alias("n"))
    part = points.select("metric", "labels", "unix_milli", F.explode(pairs).alias("p"))
    buckets = part.select(F.concat("metric", F.lit("_bucket")).alias("metric"), L.put("labels", "le", F.col("p.le")).alias("labels"), "unix_milli", F.col("p.n").cast("double").alias("value"))
    single = lambda tail, c: points.select(F.concat("metric", F.lit(tail)).alias("metric"), "labels", "unix_milli", F.col(c).cast("double").alias("value"))
    return buckets.unionByName(single("_count", "count")).unionByName(single("_sum", "sum"))


def label_replace(v: DataFrame, dst: str, replacement: str, src: str, pattern: str) -> DataFrame:
    """Whole-value match of src writes dst; otherwise dst stays."""
    field = L.get("labels", src)
    whole = f"^(?:{pattern})$"
    new = F.when(field.rlike(whole), F.regexp_replace(field, whole, replacement)).otherwise(L.get("labels", dst))
    return v.withColumn("labels", L.without(L.put("labels", dst, new), []))


def label_join(v: DataFrame, dst: str, separator: str, *src: str) -> DataFrame:
    return v.withColumn("labels", L.without(L.put("labels", dst, F.concat_ws(separator, *(L.get("labels", s) for s in src))), []))


MATH = {
    **{n: getattr(F, n) for n in ("abs", "ceil", "floor", "exp", "log2", "log10", "sqrt", "cbrt", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh")},
    "ln": F.log, "sgn": F.signum, "deg": F.degrees, "rad": F.radians,
}
_LOGS = {"ln", "log2", "log10"}


def math(v: DataFrame, function: str) -> DataFrame:
    """Outside of its domain a function is NaN; the logarithm of zero is -Inf."""
    x = F.col("value")
    y = MATH[function](x).cast("double")
    if function in _LOGS:
        y = F.when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).otherwise(y)
    return v.withColumn("value", y)


def clamp(v: DataFrame, low: float = -INF, high: float = INF) -> DataFrame:
    if low > high:
        return v.where(F.lit(False))
    x = F.col("value")
    return v.withColumn("value", F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high))))


def round_to(v: DataFrame, nearest: float = 1.0) -> DataFrame:
    """Half away from zero; to 0 is to whole numbers."""
    n = nearest or 1.0
    x = F.col("value") / n
    return v.withColumn("value", F.signum(x) * F.floor(F.abs(x) + 0.5) * n)


def negate(v: DataFrame) -> DataFrame:
    return v.withColumn("value", -F.col("value"))


def constant(spark: SparkSession, grid: Grid, value: float) -> DataFrame:
    return grid.frame(spark).select(F.create_map().cast("map<string,string>").alias("labels"), "eval_ts", F.lit(float(value)).alias("value"))


def time_vector(spark: SparkSession, grid: Grid) -> DataFrame:
    return constant(spark, grid, 0).withColumn("value", F.col("eval_ts") / 1000.0)


def scalar(v: DataFrame, grid: Grid) -> DataFrame:
    """The value of a step's only series, NaN at steps with none or several."""
    single = v.groupBy("eval_ts").agg(F.when(F.count("*") == 1, F.first("value")).otherwise(F.lit(NAN)).alias("value"))
    joined = grid.frame(v.sparkSession).join(single, "eval_ts", "left")
    return joined.select(F.create_map().cast("map<string,string>").alias("labels"), "eval_ts", F.coalesce("value", F.lit(NAN)).alias("value"))


def sort(v: DataFrame, descending: bool = False, by_labels: list[str] | None = None) -> DataFrame:
    keys = [L.get("labels", n) for n in by_labels] if by_labels else [F.col("value")]
    return v.orderBy(*((k.desc() if descending else k.asc()) for k in keys), L.key("labels"))


# --- catalogue and rollups -----------------------------------------------------------------------------------


def catalogue(samples: DataFrame) -> DataFrame:
    """Distinct series of each metric with first and last time and number of samples."""
    rows = keyed(samples).groupBy("metric", "key").agg(F.min("unix_milli").alias("first_ts"), F.max("unix_milli").alias("last_ts"), F.count("*").alias("samples"))
    return rows.withColumn("labels", L.from_key("key"))


def label_values(samples: DataFrame) -> DataFrame:
    rows = samples.select("metric", F.explode("labels").alias("label", "label_value")).where("label_value <> ''")
    return rows.groupBy("metric", "label", "label_value").agg(F.count("*").alias("samples"))


def fingerprint(metric: Column | str, labels: Column | str) -> Column:
    return F.xxhash64(metric, L.key(labels))


def rollup(samples: DataFrame, millis: int) -> DataFrame:
    """sum, count, min, max and last per series and bucket; rows with bit 0 of `flags` set are left out."""
    if "flags" in samples.columns:
        samples = samples.where((F.col("flags").bitwiseAND(1)) == 0)
    rows = keyed(samples).withColumn("bucket", F.col("unix_milli") - F.pmod(F.col("unix_milli"), F.lit(millis)))
    return rows.groupBy("metric", "key", "bucket").agg(
        F.sum("value").alias("value_sum"), F.count("*").alias("value_count"), F.min("value").alias("value_min"), F.max("value").alias("value_max"), F.max(F.struct("unix_milli", "value")).alias("last"),
    )


def rollup_again(rolled: DataFrame, millis: int) -> DataFrame:
    """A coarser rollup from a finer one."""
    rows = rolled.withColumn("bucket", F.col("bucket") - F.pmod(F.col("bucket"), F.lit(millis)))
    return rows.groupBy("metric", "key", "bucket").agg(
        F.sum("value_sum").alias("value_sum"), F.sum("value_count").alias("value_count"), F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"), F.max("last").alias("last"),
    )


REAGGREGATE = {
    "sum": lambda: F.sum("value_sum"),
    "avg": lambda: F.sum("value_sum") / F.sum("value_count"),
    "count": lambda: F.sum("value_count").cast("double"),
    "min": lambda: F.min("value_min"),
    "max": lambda: F.max("value_max"),
    "last": lambda: F.max("last")["value"],
}


def pick_table(range_ms: int, aggregation: str) -> str:
    """raw up to an hour and for what does not merge, 5m up to a day, 30m beyond."""
    if aggregation not in REAGGREGATE or range_ms <= 3_600_000:
        return "raw"
    return "5m" if range_ms <= 86_400_000 else "30m"


TIME_AGGREGATES = {
    "sum": lambda s: F.sum("value"),
    "avg": lambda s: F.avg("value"),
    "min": lambda s: F.min("value"),
    "max": lambda s: F.max("value"),
    "count": lambda s: F.count("value").cast("double"),
    "count_distinct": lambda s: F.countDistinct("value").cast("double"),
    "rate": lambda s: (F.max("value") - F.min("value")) / (s / 1000),
    "increase": lambda s: F.max("value") - F.min("value"),
    "last": lambda s: F.max_by("value", F.struct("unix_milli", "value")),
    **{f"p{str(q)[2:].ljust(2, '0')}": (lambda q: lambda s: F.percentile("value", F.lit(q)))(q) for q in (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)},  # exact: a series and step hold few samples
}
SPACE_AGGREGATES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}


def time_space(samples: DataFrame, step: int, time: str, space: str, by: list[str] = ()) -> DataFrame:
    """Aggregated per series and step, then over the series of each label group."""
    rows = keyed(samples).withColumn("bucket", F.col("unix_milli") - F.pmod(F.col("unix_milli"), F.lit(step)))
    series = rows.groupBy("metric", "key", "bucket").agg(TIME_AGGREGATES[time](step).alias("value"))
    groups = series.withColumn("labels", L.from_key("key")).select("bucket", *(L.get("labels", b).alias(b) for b in by), "value")
    return groups.groupBy("bucket", *by).agg(SPACE_AGGREGATES[space]("value").cast("double").alias("value"))


def from_rollup(rolled: DataFrame, step: int, aggregation: str, by: list[str] = (), space: str = "sum") -> DataFrame:
    rows = rolled.withColumn("bucket", F.col("bucket") - F.pmod(F.col("bucket"), F.lit(step)))
    series = rows.groupBy("metric", "key", "bucket").agg(REAGGREGATE[aggregation]().alias("value")).withColumn("labels", L.from_key("key"))
    groups = series.select("bucket", *(L.get("labels", b).alias(b) for b in by), "value")
    return groups.groupBy("bucket", *by).agg(SPACE_AGGREGATES[space]("value").cast("double").alias("value"))
