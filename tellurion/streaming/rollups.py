"""Streams: ingest, rollups with watermarks, cascades, sessions, deduplication and alert states.

Each has a batch twin that gives the same numbers for closed windows; late rows beyond the watermark are dropped, so
the default watermark is generous. Checkpoints are the saved cursors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "1 hour"


def file_stream(spark: SparkSession, path: str, schema=None, files_per_batch: int = 100) -> DataFrame:
    """Parquet files below a path as they come. Zoneless timestamps become timestamps, which watermarks need."""
    schema = schema or spark.read.parquet(path).schema
    # a table can be one file, which streams take by a pattern only; the name is taken literally but for its last character
    path = path.rstrip("/")
    plain = re.sub(r"([\\\[\]{}*?])", r"\\\1", path[:-1])
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{plain}[{path[-1]}]" if path[-1].isalnum() else f"{plain}?")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def run_available(stream: DataFrame, out: str, mode: str = "append") -> None:
    """All that is there now, in as many batches as the source makes, into parquet at `out`."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{out}_checkpoint").option("path", out).trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def rollup(events: DataFrame, width: str, keys: list[str], value: str = "value", watermark: str = WATERMARK) -> DataFrame:
    """sum, count, min, max and last per key and tumbling window; emitted when the watermark has passed the window."""
    last = F.max(F.struct("ts", F.col(value).alias("value")))
    g = events.withWatermark("ts", watermark).groupBy(F.window("ts", width), *keys)
    return g.agg(F.sum(value).alias("value_sum"), F.count("*").alias("value_count"), F.min(value).alias("value_min"), F.max(value).alias("value_max"), last.alias("last"))


def cascade(rolled: DataFrame, width: str, keys: list[str]) -> DataFrame:
    """A coarser rollup chained to a finer one in the same query, append mode."""
    g = rolled.groupBy(F.window(F.window_time("window"), width), *keys)
    return g.agg(F.sum("value_sum").alias("value_sum"), F.sum("value_count").alias("value_count"), F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max"), F.max("last").alias("last"))


def sessions(events: DataFrame, gap: str, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """Sessions that ended: no event for `gap`. Each is emitted once."""
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), *keys).agg(F.count("*").alias("events"), F.max("ts").alias("last_ts"))


def deduplicate(events: DataFrame, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """The first of rows with equal keys within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


COMPARISONS = {
    "above": lambda v, t: v > t, "below": lambda v, t: v < t, "above_or_equal": lambda v, t: v >= t, "below_or_equal": lambda v, t: v <= t, "equal": lambda v, t: v == t,
}


def alert_states(values: DataFrame, comparison: str, threshold: float) -> DataFrame:
    """Transitions of each rule between OK and ALERT. values: rule, eval_ms, value, in batches that come in order of time.

    The keyed state is one string a rule, so it stays small however long the stream runs.
    """
    test = COMPARISONS[comparison]

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "OK"
        out = []
        for row in pd.concat(list(rows)).sort_values("eval_ms").itertuples():
            if row.value is None or pd.isna(row.value):
                continue
            new = "ALERT" if test(row.value, threshold) else "OK"
            if new != now:
                out.append((key[0], row.eval_ms, new))
                now = new
        state.update((now,))
        yield pd.DataFrame(out, columns=["rule", "eval_ms", "state"])

    return values.groupBy("rule").applyInPandasWithState(step, "rule bigint, eval_ms bigint, state string", "now string", "append", GroupStateTimeout.NoTimeout)


def alert_notifications(values: DataFrame, comparison: str, threshold: float, every_ms: int, absent_ms: int, reset_ms: int, watermark: str = "0 seconds") -> DataFrame:
    """The notifications (rule, eval_ms, state) of telemetry.fired_alerts() as a stream, with those that no row brings about:
    a rule without data for absent_ms is ALERT, and an alert that goes on longer than reset_ms fires again.

    values: rule, eval_ms (multiples of every_ms apart), value, ts (their time); a row without a value makes a rule known.
    The state of a rule is its alert state and four times. Its timer is the next evaluation without data that would notify;
    it goes off as the watermark passes, so evaluations in between cost nothing. Rows behind the watermark are dropped.
    """
    test = COMPARISONS[comparison]

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, since, fired, at = state.get if state.exists else ("OK", -1, -1, -1)
        out: list[tuple] = []

        def due() -> int:
            """The next evaluation that notifies if no data comes."""
            first = since + absent_ms if now != "ALERT" else fired + reset_ms + 1
            return at + max(0, -(-(first - at) // every_ms)) * every_ms

        def notify(ms: int, new: str) -> None:
            nonlocal now, fired
            if new != now or (new == "ALERT" and ms - fired > reset_ms):
                out.append((key[0], ms, new))
                fired = ms
            now = new

        def pass_to(ms: int) -> None:
            """All evaluations before ms, without data."""
            nonlocal at
            while (k := due()) < ms:
                notify(k, "ALERT")
                at = k + every_ms
            at += max(0, -(-(ms - at) // every_ms)) * every_ms

        passed = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for row in pd.concat(list(rows)).sort_values(["eval_ms", "value"], na_position="first").itertuples():
                if at < 0:
                    since, at = row.eval_ms, row.eval_ms
                if row.value is None or pd.isna(row.value) or row.eval_ms < passed:
                    continue
                pass_to(row.eval_ms)
                since = row.eval_ms
                notify(row.eval_ms, "ALERT" if test(row.value, threshold) else "OK")
                at = row.eval_ms + every_ms
        pass_to(passed)
        state.update((now, since, fired, at))
        state.setTimeoutTimestamp(max(due(), passed + 1))
        yield pd.DataFrame(out, columns=["rule", "eval_ms", "state"])

    rows = values.withWatermark("ts", watermark)
    return rows.groupBy("rule").applyInPandasWithState(step, "rule bigint, eval_ms bigint, state string", "now string, since bigint, fired bigint, at bigint", "append", GroupStateTimeout.EventTimeTimeout)


def merge_partials(spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: partial aggregates of a batch are kept by batch id; `merged` combines them."""

    def each(df: DataFrame, batch: int) -> None:
        merge(df).write.mode("overwrite").parquet(f"{root}/batch={batch}")

    return each


def merged(spark: SparkSession, root: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return merge(spark.read.option("basePath", root).parquet(f"{root}/batch=*").drop("batch"))
