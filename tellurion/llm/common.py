"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Used only by a session on one machine that names no shared folder (tests, local runs).
LOCAL_SHARED = "/tmp/checkpoints/tellurion"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names, which driver and executors all see."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = LOCAL_SHARED
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more: all that is made of them has been stored itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def binary_text(name: str = "text") -> Column:
    """The column as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(f"`{name}`").cast("binary"), F.lit(b"").cast("binary"))


def others(columns: Sequence[str], own: Sequence[str]) -> list[str]:
    """The columns whose names are not among `own`; names are alike in any case of letters, as Spark takes them."""
    taken = {c.lower() for c in own}
    return [c for c in columns if c.lower() not in taken]


def packed(columns: Sequence[str]) -> Column:
    """The caller's columns as one struct, `keep`, so that no name among them can clash with a working column."""
    return (F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(0).alias("none"))).alias("keep")


def unpacked(df: DataFrame, columns: Sequence[str], *own: str | Column) -> DataFrame:
    """The columns out of `keep`, then the operator's own; a column of the caller with the name of one of these gives way."""
    return df.select(*(F.col(f"keep.`{c}`").alias(c) for c in columns), *own)


def mapped(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], own: str) -> DataFrame:
    """mapInArrow over rows whose first column is `keep`, which run() passes on in front of the columns that `own` declares."""
    return rows.mapInArrow(run, StructType([StructField("keep", rows.schema[0].dataType), *StructType.fromDDL(own).fields]))


def slices(b: pa.RecordBatch, text: int = -1, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of about `most` bytes in the column `text` at a time; a longer text is a slice of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(text % b.num_columns)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < b.num_rows:
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, "right")))
        yield b.slice(start, stop - start)
        start = stop


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


def answer(b: pa.RecordBatch, **own: pa.Array | list) -> pa.RecordBatch:
    """The first column of b and the operator's own."""
    return pa.RecordBatch.from_arrays([b.column(0), *(x if isinstance(x, pa.Array) else pa.array(x) for x in own.values())], names=["keep", *own])
