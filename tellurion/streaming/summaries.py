"""Summaries that are refreshed by what is new: partial states by source batch, merged when they are read.

states: name -> (aggregate of rows, aggregate of such states), such as

    {"n": (F.count("*"), F.sum("n")), "users": (F.hll_sketch_agg("user_id"), F.hll_union_agg("users")),
     "ms": (F.kll_sketch_agg_bigint("ms"), F.kll_merge_agg_bigint("ms"))}

Counts that must be exact and distinct take the counted column as a key of the states, and are counted from those.

    root/batch/version=<batch>/     states of one batch of the source
    root/folded/version=<batch>/    states of all batches up to that one

Every `fold`-th batch is folded, so a reader merges one folded file set and fewer than `fold` batches. A batch that is
repeated after a failure overwrites its files; what it may need again is kept until the fold after next.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession

from .rollups import run_batches

FOLD = 16
States = dict[str, tuple[Column, Column]]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, folder: str) -> list[int]:
    pattern, fs = _fs(spark, f"{folder}/version=*/_SUCCESS")
    return sorted(int(re.search(r"version=(\d+)", f.getPath().toString())[1]) for f in fs.globStatus(pattern))


def _merged(spark: SparkSession, root: str, by: list[str], states: States, until: int | None = None) -> DataFrame:
    """States of all batches up to `until`: of the newest fold before it and of the batches since."""
    last = lambda v: until is None or v <= until
    folds = [v for v in _versions(spark, f"{root}/folded") if v != until and last(v)]
    since = folds[-1] if folds else -1
    paths = [f"{root}/folded/version={v}" for v in folds[-1:]] + [f"{root}/batch/version={v}" for v in _versions(spark, f"{root}/batch") if v > since and last(v)]
    # all of one shape: no schema is inferred from more than a footer
    return spark.read.parquet(*paths).groupBy(*by).agg(*(again.alias(n) for n, (_, again) in states.items()))


def refresh(spark: SparkSession, source: DataFrame, root: str, by: list[str], states: States, fold: int = FOLD) -> DataFrame:
    """Takes in what the stream `source` has that is new and returns (by, states) of everything so far."""

    def each(df: DataFrame, batch: int) -> None:
        s = df.sparkSession
        df.groupBy(*by).agg(*(first.alias(n) for n, (first, _) in states.items())).write.mode("overwrite").parquet(f"{root}/batch/version={batch}")
        if (batch + 1) % fold == 0:
            _merged(s, root, by, states, batch).write.mode("overwrite").parquet(f"{root}/folded/version={batch}")
            for kind in ("batch", "folded"):
                for v in _versions(s, f"{root}/{kind}"):
                    if v <= batch - fold - (kind == "folded"):  # the fold before stays, with no batch that it holds
                        path, fs = _fs(s, f"{root}/{kind}/version={v}")
                        fs.delete(path, True)

    run_batches(source, f"{root}/checkpoint", each)
    return _merged(spark, root, by, states)
