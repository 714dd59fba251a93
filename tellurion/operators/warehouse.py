"""Warehouse operators: key profiles, funnels, retention, search, and table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- joins ---------------------------------------------------------------------------------------------------


def key_overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys on both sides and on one only, and how many rows an inner join would have."""
    count = lambda df, n: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n))
    both = count(left, "l").join(count(right, "r"), key, "full_outer")
    return both.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"),
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("join_rows"),
    )


def missing_keys(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Foreign keys without a parent, with the number of rows. Children are counted before the join."""
    counts = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("missing_key")).agg(F.count("*").alias("n"))
    return counts.join(parent.select(F.col(parent_key).alias("missing_key")), "missing_key", "left_anti")


# --- profiles ------------------------------------------------------------------------------------------------


def cardinality(df: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """Per column: rows, distinct values (HyperLogLog unless exact), selectivity and index advice. One pass."""
    count = F.countDistinct if exact else F.approx_count_distinct
    wide = df.agg(F.count("*").alias("rows"), *(count(c).alias(c) for c in columns))
    long = wide.select("rows", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("distinct_values")) for c in columns))).alias("x")).select("rows", "x.*")
    share = F.try_divide("distinct_values", "rows")
    advice = F.when(F.col("distinct_values") <= 100, "values").when(share < 0.01, "bitmap").when(share > 0.9, "bloom").otherwise("sorted")
    return long.withColumn("selectivity", F.round(share, 6)).withColumn("advice", advice)


def distinct_sketch(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Mergeable distinct counts, one sketch a group."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(column).alias("sketch"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"))


def statistics(df: DataFrame, columns: list[str], fraction: float | None = None, exact: bool = False) -> DataFrame:
    """Rows, null share, distinct values (HyperLogLog unless exact), least and greatest of each column. Exact counts of
    several columns multiply the rows by their number. With a fraction they are estimates for the table from a sample, see
    sampled_statistics()."""
    if fraction:
        return sampled_statistics(df, columns, fraction)
    distinct = F.countDistinct if exact else F.approx_count_distinct
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}|n"), distinct(c).alias(f"{c}|d"), F.min(c).cast("string").alias(f"{c}|a"), F.max(c).cast("string").alias(f"{c}|z")]
    wide = df.agg(*aggs)
    each = F.array(*(F.struct(F.lit(c).alias("name"), F.round(F.try_divide(F.col(f"`{c}|n`"), F.col("rows")), 6).alias("null_share"), F.col(f"`{c}|d`").alias("distinct_values"), F.col(f"`{c}|a`").alias("least"), F.col(f"`{c}|z`").alias("greatest")) for c in columns))
    return wide.select("rows", F.explode(each).alias("x")).select("rows", "x.*")


def sampled_statistics(df: DataFrame, columns: list[str], fraction: float, seed: int = 1) -> DataFrame:
    """statistics() of a table, estimated from a Bernoulli sample of its rows, and bounds for the distinct values.

    Rows and nulls are scaled. The distinct values come from how often values occur in the sample: with f1 seen once and d
    seen at all, sqrt(1 / fraction) * f1 + (d - f1), which is within that root of the truth for any distribution, cut by
    what is sure: at least d, at most d and f1 / fraction. least and greatest are those of the sample. Values are counted
    by (column, value) with partial sums, so a hot value is not one task's matter.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))
    sample = df.select(*columns).sample(fraction, seed=seed)
    counts = sample.select(F.explode(cells).alias("x")).select("x.*").groupBy("name", "value").agg(F.count("*").alias("n"))
    seen = counts.groupBy("name").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("d"), F.count_if(F.col("value").isNotNull() & (F.col("n") == 1)).alias("f1"),
    )
    bounds = sample.agg(*(f(c).cast("string").alias(f"{c}|{k}") for c in columns for k, f in (("a", F.min), ("z", F.max))))
    ends = bounds.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}|a`").alias("least"), F.col(f"`{c}|z`").alias("greatest")) for c in columns))).alias("x")).select("x.*")
    low, high = F.col("d"), (F.col("d") - F.col("f1")) + F.col("f1") / fraction
    middle = F.greatest(low, F.least(high, F.sqrt(F.lit(1 / fraction)) * F.col("f1") + F.col("d") - F.col("f1")))
    return seen.join(ends, "name").select(
        F.round(F.col("rows") / fraction).cast("bigint").alias("rows"), "name", F.round(F.col("nulls") / F.col("rows"), 6).alias("null_share"), F.round(middle).cast("bigint").alias("distinct_values"),
        F.col("d").alias("distinct_low"), F.round(high).cast("bigint").alias("distinct_high"), "least", "greatest",
    )


#: Date formats that are tried, the earlier wins a tie.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyyMMdd", "dd.MM.yyyy")


def date_formats(df: DataFrame, columns: list[str], formats: tuple[str, ...] = DATE_FORMATS, least: float = 0.9) -> DataFrame:
    """Per text column the format that reads most values, null below `least`. One pass."""
    rate = lambda c, f: F.round(F.avg(F.when(F.col(c).isNotNull(), F.when(F.try_to_timestamp(F.col(c), F.lit(f)).isNotNull(), 1.0).otherwise(0.0))), 6)
    wide = df.agg(*(rate(c, f).alias(f"{c}|{k}") for c in columns for k, f in enumerate(formats)))
    each = F.array(*(F.struct(F.lit(c).alias("name"), F.array_max(F.array(*(F.struct(F.col(f"`{c}|{k}`").alias("rate"), F.lit(-k).alias("place"), F.lit(f).alias("format")) for k, f in enumerate(formats)))).alias("best")) for c in columns))
    rows = wide.select(F.explode(each).alias("x")).select("x.name", "x.best.rate", "x.best.format")
    return rows.withColumn("format", F.when(F.col("rate") >= least, F.col("format")))


def convert_dates(df: DataFrame, columns: list[str], formats: tuple[str, ...] = DATE_FORMATS, least: float = 0.9) -> DataFrame:
    """df with each text column for which date_formats() finds a format as dates; values that do not fit become null."""
    found = {r["name"]: r["format"] for r in date_formats(df, columns, formats, least).collect()}  # a row a column
    return df.withColumns({c: F.to_date(F.try_to_timestamp(F.col(c), F.lit(f))) for c, f in found.items() if f})


def freshness_summary(levels: DataFrame) -> DataFrame:
    """How many tables are at each level of freshness()."""
    return levels.groupBy("level").agg(F.count("*").alias("tables"))


def freshness(latest: DataFrame, now: str) -> DataFrame:
    """latest: name, last (timestamp). Level by age; unknown where there is no time."""
    hours = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last")) / 3600
    return latest.withColumn("level", F.when(F.col("last").isNull(), "unknown").when(hours < 1, "fresh").when(hours < 6, "recent").when(hours < 24, "stale").otherwise("old"))


def churn(changes: DataFrame, base: DataFrame, by: str) -> DataFrame:
    """Share of a partition's rows that changed. changes, base: the partition column `by`."""
    c = changes.groupBy(by).agg(F.count("*").alias("changes"))
    b = base.groupBy(by).agg(F.count("*").alias("rows"))
    return b.join(c, by, "left").fillna(0, ["changes"]).withColumn("churn", F.round(F.col("changes") / F.col("rows"), 6))


def usage(log: DataFrame, *by: str) -> DataFrame:
    """log: user_id, ms (duration) and `by`."""
    return log.groupBy(*by).agg(F.count("*").alias("queries"), F.countDistinct("user_id").alias("users"), F.sum("ms").alias("total_ms"))


# --- search --------------------------------------------------------------------------------------------------


def search(tables: dict[str, tuple[DataFrame, str, list[str]]], text: str, limit: int | None = None) -> DataFrame:
    """tables: name -> (frame, id column, text columns). A row is a hit where one of its columns has all tokens."""
    tokens = [t for t in text.lower().split() if t]
    out = None
    for name, (df, id_, columns) in tables.items():
        words = lambda c: F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"\W+")
        in_column = [reduce(lambda a, b: a & b, (F.array_contains(words(c), t) for t in tokens)) for c in columns]
        hits = df.where(reduce(lambda a, b: a | b, in_column)).select(F.lit(name).alias("source"), F.col(id_).cast("string").alias("id"))
        hits = hits.orderBy("id").limit(limit) if limit else hits
        out = hits if out is None else out.unionByName(hits)
    return out


# --- funnels and retention -----------------------------------------------------------------------------------


def daily_events(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))


def funnel_reached(events: DataFrame, steps: list[str], window_ms: int) -> DataFrame:
    """(user_id, step) of users who completed the steps up to `step` (from 1). Mergeable: distinct union.

    Only steps' events are kept, as (ms, id, step) structs per user in order; a fold walks each user's list once. Step
    one starts anew, a later step counts directly after the one before and within the window since it.
    """
    step = F.coalesce(*(F.when(F.col("event_type") == s, k + 1) for k, s in enumerate(steps)))
    part = events.withColumn("step", step).where("step is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ms", "event_id", "step"))).alias("e"))
    fold = F.expr(f"""aggregate(e, named_struct('cur', 0, 'at', 0L, 'top', 0), (a, x) -> CASE
      WHEN x.step = 1 THEN named_struct('cur', 1, 'at', x.ms, 'top', greatest(a.top, 1))
      WHEN a.cur > 0 AND x.step = a.cur + 1 AND x.ms - a.at <= {window_ms}L THEN named_struct('cur', x.step, 'at', x.ms, 'top', greatest(a.top, x.step)) ELSE a END, a -> a.top)""")
    return part.select("user_id", fold.alias("top")).where("top > 0").select("user_id", F.explode(F.sequence(F.lit(1), "top")).alias("step"))


def funnel(reached: DataFrame, steps: list[str]) -> DataFrame:
    """Users per step, conversion from the step before and from the first, users lost."""
    counts = reached.groupBy("step").agg(F.countDistinct("user_id").alias("users"))
    w = Window.orderBy("step")  # a row a step
    out = counts.withColumn("before", F.lag("users").over(w)).withColumn("first", F.first("users").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(
        "step", F.element_at(F.array(*map(F.lit, steps)), F.col("step")).alias("event_type"), "users", F.round(F.coalesce(F.col("users") / F.col("before"), F.lit(1.0)), 6).alias("conversion"),
        F.coalesce(F.col("before") - F.col("users"), F.lit(0)).alias("lost"), F.round(F.col("users") / F.col("first"), 6).alias("overall"),
    )


def retention(events: DataFrame, unit: str = "day", max_offset: int = 255) -> DataFrame:
    """Cohorts by first activity (day, week, month): users active at each offset, and their share of the cohort."""
    seen = events.select("user_id", F.date_trunc(unit, "ts").alias("period")).distinct()
    first = seen.groupBy("user_id").agg(F.min("period").alias("cohort"))
    gap = F.months_between("period", "cohort") if unit == "month" else F.datediff("period", "cohort") / (7 if unit == "week" else 1)
    rows = seen.join(first, "user_id").withColumn("offset", F.round(gap).cast("int")).where(F.col("offset") <= max_offset)
    active = rows.groupBy("cohort", "offset").agg(F.count("*").alias("users"))
    size = F.max(F.when(F.col("offset") == 0, F.col("users"))).over(Window.partitionBy("cohort"))
    return active.withColumn("size", size).withColumn("share", F.round(F.col("users") / F.col("size"), 6))


def average_retention(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("offset").agg(F.round(F.avg("share"), 6).alias("share"), F.count("*").alias("cohorts"))


# --- maintenance ---------------------------------------------------------------------------------------------


def unify(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with the union of their columns, missing ones null. One name with two types is an error."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    if bad := sorted(c for c in a.keys() & b.keys() if a[c] != b[c]):
        raise ValueError("types differ: " + ", ".join(f"{c} is {a[c]} and {b[c]}" for c in bad))
    names = list(a) + [c for c in b if c not in a]
    full = lambda df, own: df.select(*(F.col(f"`{c}`") if c in own else F.lit(None).cast((b if c in b else a)[c]).alias(c) for c in names))
    return full(old, a), full(new, b)


def latest(rows: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key, as one aggregate over structs: nothing is sorted."""
    rest = [c for c in rows.columns if c not in key]
    s = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s"))
    return s.select(*key, "_s.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """New rows replace old ones of their key; of several new rows of a key the last in `order` counts. No key: append."""
    old, new = unify(old, new)
    if not key:
        return old.unionByName(new)
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(latest(new, key, *order).select(*old.columns))


def fold_changes(changes: DataFrame, key: list[str], values: list[str], order: Column | str = "seq") -> DataFrame:
    """One row a key of what its changes come to: _c (op and values of the last), _at, _in and _out (places in `order` of the
    last change, insert and delete). Folded rows fold again by fold_again(), so that changes can be folded in any parts."""
    at = F.col(order) if isinstance(order, str) else order
    return changes.groupBy(*key).agg(
        F.max_by(F.struct("op", *values), at).alias("_c"), F.max(at).alias("_at"), F.max(F.when(F.col("op") == "insert", at)).alias("_in"), F.max(F.when(F.col("op") == "delete", at)).alias("_out"),
    )


def fold_again(folded: DataFrame, key: list[str]) -> DataFrame:
    return folded.groupBy(*key).agg(F.max_by("_c", "_at").alias("_c"), F.max("_at").alias("_at"), F.max("_in").alias("_in"), F.max("_out").alias("_out"))


#: An insert after the last delete makes later updates valid.
MADE = "(_in IS NOT NULL AND (_out IS NULL OR _in > _out))"


def apply_changes(old: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """changes: op (insert, update, delete), seq and the table's columns. Per key the last change decides; an update of
    a key that the table lacks and that was not inserted in the same batch does nothing."""
    values = [c for c in old.columns if c not in key]
    folded = fold_changes(changes, key, values)
    joined = old.withColumn("_had", F.lit(True)).join(folded, key, "full_outer")
    op = F.col("_c.op")
    joined = joined.where(op.isNull() | (op == "insert") | ((op == "update") & (F.expr(MADE) | (F.col("_had") & F.col("_out").isNull()))))
    return joined.select(*key, *(F.when(op.isNull(), F.col(v)).otherwise(F.col(f"_c.{v}")).alias(v) for v in values))


def apply_folded(old: DataFrame, folded: DataFrame, key: list[str]) -> DataFrame:
    """apply_changes() for folded changes that are few against the table: while they fit a broadcast, the table is scanned
    (a second time for its keys) but not shuffled."""
    values = [c for c in old.columns if c not in key]
    op = F.col("_c.op")
    kept = old.join(folded, key, "left").where(op.isNull() | (op == "insert") | ((op == "update") & (F.col("_out").isNull() | F.expr(MADE))))
    kept = kept.select(*key, *(F.when(op.isNull(), F.col(v)).otherwise(F.col(f"_c.{v}")).alias(v) for v in values))
    had = old.select(*key).join(folded.select(*key), key, "left_semi")
    made = folded.where((op == "insert") | ((op == "update") & F.expr(MADE))).join(had, key, "left_anti")
    return kept.unionByName(made.select(*key, *(F.col(f"_c.{v}").alias(v) for v in values)))


def tail_resync(ours: DataFrame, theirs: DataFrame, key: str, hash_: str) -> DataFrame:
    """From the first key at which the hashes differ on, their rows replace ours."""
    both = ours.select(key, F.col(hash_).alias("_a")).join(theirs.select(key, F.col(hash_).alias("_b")), key, "full_outer")
    fork = both.where(~F.col("_a").eqNullSafe(F.col("_b"))).agg(F.min(key).alias("_fork"))  # one row
    mark = lambda df: df.crossJoin(F.broadcast(fork))
    same = mark(ours).where(F.col("_fork").isNull() | (F.col(key) < F.col("_fork"))).drop("_fork")
    return same.unionByName(mark(theirs).where(F.col(key) >= F.col("_fork")).drop("_fork"))


def mutable_partitions(manifest: DataFrame, strategy: str, today: str, days: int = 7) -> DataFrame:
    """manifest: dt, modified. Which partitions may change: all, none, rolling (by date) or age (of the file)."""
    day = F.lit(today).cast("date")
    rule = {"all": F.lit(True), "none": F.lit(False), "rolling": F.datediff(day, "dt") < days, "age": F.datediff(day, F.to_date("modified")) < days}[strategy]
    return manifest.withColumn("mutable", rule)


def refresh_sql(sql: str, last: str | None) -> str:
    """The text with {{last_refresh}} as a timestamp literal; the epoch where nothing was refreshed yet."""
    return sql.replace("{{last_refresh}}", f"TIMESTAMP '{last or '1970-01-01 00:00:00'}'")


def refresh(spark, path: str, sql: str, last: str | None = None) -> DataFrame:
    """Full refresh, or with `last` an append of what is new; columns must fit the table's."""
    new = spark.sql(refresh_sql(sql, last))
    if last is None:
        new.write.mode("overwrite").parquet(path)
    else:
        have = spark.read.parquet(path).dtypes
        if have != new.dtypes:
            raise ValueError(f"columns {new.dtypes} do not fit the table's {have}")
        new.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def compact(spark, path: str, out: str, target_bytes: int = 128 << 20, size: int | None = None) -> DataFrame:
    """The table at `path` in fewer, larger files at `out`, for the caller to swap in. Sizes come from the scan's own statistics."""
    df = spark.read.parquet(path)
    size = size or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    df.repartition(max(1, -(-size // target_bytes))).write.parquet(out)
    return spark.read.parquet(out)


def write_dates(df: DataFrame, path: str, ts: str) -> None:
    """Partitions by date of `ts`; a batch replaces just the dates that it holds."""
    df.withColumn("dt", F.to_date(ts)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)


def split_by_age(df: DataFrame, ts: str, now: str, hot_days: int) -> tuple[DataFrame, DataFrame]:
    age = F.datediff(F.lit(now).cast("date"), F.to_date(ts))
    return df.where(age < hot_days), df.where(age >= hot_days)


def retain(df: DataFrame, ts: str, now: str, days: int) -> DataFrame:
    return df.where(F.to_date(ts) > F.date_sub(F.lit(now).cast("date"), days))
