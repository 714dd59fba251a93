"""File sources and sinks: CSV, JSON, partitioned paths, transaction logs, incremental reads, chunked writes with statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True, quote: str = '"', nulls: tuple[str, ...] = ("",)) -> DataFrame:
    """All columns as text, strings in `nulls` as null, then cast to the schema; without one the types are sampled."""
    raw = spark.read.option("sep", sep).option("header", header).option("quote", quote)
    if schema is None:
        return _nulled(raw.option("inferSchema", True).option("samplingRatio", 0.1).csv(path), nulls)
    fields = spark.createDataFrame([], schema).schema
    text = _nulled(raw.schema(", ".join(f"`{f.name}` string" for f in fields)).csv(path), nulls)
    return text.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields))


def _nulled(df: DataFrame, nulls: tuple[str, ...]) -> DataFrame:
    return df.select(*(F.when(F.col(f"`{c}`").isin(*nulls), None).otherwise(F.col(f"`{c}`")).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes))


def read_json(spark: SparkSession, path: str, records_path: str | None = None, schema: str | None = None, multi_line: bool = False, sampling: float = 1.0) -> DataFrame:
    """NDJSON, or with records_path the items of a nested array."""
    reader = spark.read.option("multiLine", multi_line).option("samplingRatio", sampling)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.select(F.explode(records_path).alias("_r")).select("_r.*") if records_path else df


def partition_values(df: DataFrame, **patterns: str) -> DataFrame:
    """Columns from the files' paths, by patterns with one group; files without a match fall into hash buckets of their path."""
    path = F.input_file_name()
    out = df.withColumns({name: F.regexp_extract(path, p, 1) for name, p in patterns.items()})
    none = reduce(lambda a, b: a & b, (F.col(n) == "" for n in patterns))
    return out.withColumn("path_bucket", F.when(none, F.pmod(F.xxhash64(path), F.lit(16))))


def active_files(spark: SparkSession, log: str) -> DataFrame:
    """(path, size) of a table's live files: the last action on each path of a log of JSON add and remove actions."""
    schema = "add struct<path:string,size:bigint>, remove struct<path:string>"
    actions = spark.read.schema(schema).json(log).where("add is not null or remove is not null")
    version = F.regexp_extract(F.input_file_name(), r"(\d+)\.json", 1).cast("bigint")
    rows = actions.select(F.coalesce("add.path", "remove.path").alias("path"), version.alias("v"), F.col("add.size").alias("size"), F.col("add").isNotNull().alias("live"))
    return rows.groupBy("path").agg(F.max_by(F.struct("live", "size"), F.struct("v", "live")).alias("s")).where("s.live").select("path", "s.size")


def read_active(spark: SparkSession, root: str, log: str | None = None) -> DataFrame:
    """The live files below root; columns of partition folders included. The list of files is the scan's own."""
    files = [f"{root}/{r.path}" for r in active_files(spark, log or f"{root}/_log").toLocalIterator()]
    return spark.read.option("basePath", root).parquet(*files)


def read_incremental(df: DataFrame, cursor: str, last: object = None, max_rows: int | None = None) -> tuple[DataFrame, Column]:
    """Rows beyond the cursor, and the aggregate that gives the next one. With max_rows the earliest rows come first, and
    all that share the last one's cursor with it, so that the next read misses none."""
    rows = df if last is None else df.where(F.col(cursor) > F.lit(last))
    if max_rows:
        edge = rows.select(F.col(cursor).alias("_edge")).orderBy("_edge").limit(max_rows).agg(F.max("_edge").alias("_edge"))  # one row
        rows = rows.join(F.broadcast(edge), F.col(cursor) <= F.col("_edge"), "left_semi")
    return rows, F.max(cursor)


def read_source(spark: SparkSession, strategy: dict) -> DataFrame:
    """strategy kinds: full, incremental (cursor, last), query (sql), batch (limit), filter (where), stream (schema)."""
    kind, path = strategy["kind"], strategy.get("path")
    if kind == "query":
        return spark.sql(strategy["sql"])
    if kind == "stream":
        return spark.readStream.schema(strategy["schema"]).option("maxFilesPerTrigger", strategy.get("max_files", 100)).parquet(path)
    df = spark.read.parquet(path)
    if kind == "incremental":
        return read_incremental(df, strategy["cursor"], strategy.get("last"), strategy.get("max_rows"))[0]
    if kind == "batch":
        return df.limit(strategy["limit"])
    return df.where(strategy["where"]) if kind == "filter" else df


def in_dates(df: DataFrame, ts: str, start: str, end: str, partition: str = "dt") -> DataFrame:
    """ts within [start, end], and the partition column within the dates of it, so that whole partitions are skipped."""
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return df.where(F.col(partition).between(low.cast("date"), high.cast("date")) & F.col(ts).between(low, high))


def write_chunks(df: DataFrame, path: str, rows_per_file: int = 1_000_000, partition_by: tuple[str, ...] = (), compression: str = "zstd", mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", compression).partitionBy(*partition_by).parquet(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """Rows of a run replace those that an earlier try of it left; other runs stay."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def file_statistics(spark: SparkSession, path: str, columns: list[str], low_cardinality: list[str] = (), footers: bool = True) -> DataFrame:
    """Per file: rows, and for each column least, greatest and nulls; distinct values of columns with few of them.

    Rows, bounds and nulls come from the Parquet footers, which tasks read for a share of the files each; data is read only
    for files whose footers lack a bound, for distinct values, and where footers=False (stores that Arrow does not open).
    """
    df = spark.read.parquet(path)
    if not footers:
        return _scanned(df, columns, low_cardinality)
    # the content column is not asked for, so this lists files and opens none
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select(_plain("path").alias("path"))
    schema = StructType([StructField("file", StringType()), StructField("rows", LongType()), StructField("known", BooleanType())])
    for c in columns:
        schema.add(f"{c}_min", df.schema[c].dataType).add(f"{c}_max", df.schema[c].dataType).add(f"{c}_nulls", LongType())
    found = paths.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_footers(columns, to_arrow_schema(schema)), schema)
    unknown = [r.file for r in found.where("not known").select("file").collect()]
    known = found.where("known").drop("known")
    if unknown:
        known = known.unionByName(_scanned(spark.read.schema(df.schema).parquet(*unknown), columns))
    if low_cardinality:
        values = df.groupBy(_file().alias("file")).agg(*(F.array_sort(F.collect_set(c)).alias(f"{c}_values") for c in low_cardinality))
        known = known.join(values, "file")
    return known


def _scanned(df: DataFrame, columns: list[str], low_cardinality: list[str] = ()) -> DataFrame:
    out = [F.count("*").alias("rows")]
    for c in columns:
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls")]
    out += [F.array_sort(F.collect_set(c)).alias(f"{c}_values") for c in low_cardinality]
    return df.groupBy(_file().alias("file")).agg(*out)


def _file() -> Column:
    """The path of a row's file as a reader takes it: Spark's function encodes it as a URI."""
    return _plain(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))))


def _plain(path: Column | str) -> Column:
    """A path with one slash behind file: or three as the same text."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def _footers(columns: list[str], schema: pa.Schema):
    """Reads the footers of files: rows, whether all bounds are known, and per column least, greatest and nulls."""

    def read(uri: str) -> list:
        store, inner = fs.FileSystem.from_uri(quote(uri, safe="/:@"))
        with store.open_input_file(inner) as f:
            meta = pq.read_metadata(f)
        place = {meta.schema.column(k).path: k for k in range(meta.num_columns)}
        groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
        known, out = True, []
        for c in columns:
            least = greatest = None
            nulls = 0
            for g in groups:
                s = g.column(place[c]).statistics if c in place else None
                if s is None or s.null_count is None:
                    known = False
                    continue
                nulls += s.null_count
                if s.has_min_max:
                    least = s.min if least is None else min(least, s.min)
                    greatest = s.max if greatest is None else max(greatest, s.max)
                elif s.null_count < g.num_rows:
                    known = False
            out += [least, greatest, nulls]
        return [uri, meta.num_rows, known, *(out if known else [None] * len(out))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read(u) for u in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run


def may_match(predicate: dict) -> Column:
    """Whether a file of file_statistics can hold rows: {and: [..]}, {or: [..]}, or {column, op, value}.

    op: = in < <= > >= between prefix on least and greatest; value_in and contains on distinct values.
    """
    if "and" in predicate or "or" in predicate:
        parts = [may_match(p) for p in predicate.get("and", predicate.get("or"))]
        return reduce((lambda a, b: a & b) if "and" in predicate else (lambda a, b: a | b), parts)
    c, op, v = predicate["column"], predicate["op"], predicate["value"]
    low, high = F.col(f"{c}_min"), F.col(f"{c}_max")
    if op in ("=", "in"):
        return reduce(lambda a, b: a | b, ((low <= x) & (high >= x) for x in (v if op == "in" else [v])))
    if op == "between":
        return (low <= v[1]) & (high >= v[0])
    if op == "prefix":
        return (F.substring(low, 1, len(v)) <= v) & (F.substring(high, 1, len(v)) >= v)
    if op == "value_in":
        return F.arrays_overlap(f"{c}_values", F.array(*map(F.lit, v)))
    if op == "contains":
        return F.exists(f"{c}_values", lambda x: x.contains(v))
    return {"<": low < v, "<=": low <= v, ">": high > v, ">=": high >= v}[op]


def row_match(predicate: dict) -> Column:
    if "and" in predicate or "or" in predicate:
        parts = [row_match(p) for p in predicate.get("and", predicate.get("or"))]
        return reduce((lambda a, b: a & b) if "and" in predicate else (lambda a, b: a | b), parts)
    c, op, v = F.col(predicate["column"]), predicate["op"], predicate["value"]
    if op in ("in", "value_in"):
        return c.isin(*v)
    return {"=": lambda: c == v, "between": lambda: c.between(*v), "prefix": lambda: c.startswith(v), "contains": lambda: c.contains(v), "<": lambda: c < v, "<=": lambda: c <= v, ">": lambda: c > v, ">=": lambda: c >= v}[op]()


def read_skipping(spark: SparkSession, statistics: DataFrame, predicate: dict, schema=None, **partitions: object) -> DataFrame:
    """The rows that match, from the files that can hold some. The list of files is the scan's own, as for any read.

    partitions: a hint, name=value of partition folders; files of other folders are passed over before their statistics
    are looked at, and the rows are those of these folders.
    """
    for name, value in partitions.items():
        statistics = statistics.where(F.col("file").contains(f"/{name}={value}/"))
    files = [r.file for r in statistics.where(may_match(predicate)).select("file").collect()]  # a row a file
    if not files:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*files).where(row_match(predicate))
