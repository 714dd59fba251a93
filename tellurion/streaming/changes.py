"""Tables kept up to date from a stream of changes: base files, deltas by batch, and a manifest that names the live ones.

Keys are dealt into a fixed number of parts by hash. A batch of changes is folded to a row a key and appended as a delta, one
file for each part that it touches; nothing else is written. Reading merges a part's base with its live deltas. A part whose
deltas have grown large against its base, or many, is folded into a new base; the other parts stay as they are.

    root/base/version=<batch>/_part=<p>/    rows of part p as of that batch (-1: the table at the beginning)
    root/delta/batch=<batch>/_part=<p>/     folded changes of that batch
    root/manifest/version=<batch>/          a row a part: version, rows, deltas (live batches), delta_rows

A batch counts from when its manifest is finished. A batch that is repeated after a failure starts from the manifest before it
and overwrites what it had written. Keys must not be null.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import warehouse as W

#: Parts of a new table. A part should be some hundred MB; the manifest has a row a part, which the driver reads.
PARTS = 64
#: A part is folded when its deltas have this share of its rows, or when there are this many.
FOLD_SHARE, FOLD_DELTAS = 0.25, 16

MANIFEST = "part int, version bigint, rows bigint, deltas array<bigint>, delta_rows bigint"


def _found(spark: SparkSession, pattern: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [f.getPath().toString() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)]


def versions(spark: SparkSession, root: str) -> list[int]:
    """Finished versions below root, in order."""
    return sorted(int(re.search(r"version=(-?\d+)", p)[1]) for p in _found(spark, f"{root}/manifest/version=*/_SUCCESS"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[int, dict]:
    """By part, of the newest version or the one asked for."""
    version = versions(spark, root)[-1] if version is None else version
    return {r["part"]: r.asDict() for r in spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={version}").collect()}


class ChangingTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: list[str], fold_share: float = FOLD_SHARE, fold_deltas: int = FOLD_DELTAS):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        # files hold nullable columns whatever the table's own say
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
        self.fold_share, self.fold_deltas = fold_share, fold_deltas

    def create(self, base: DataFrame, parts: int = PARTS) -> None:
        rows = self._write_base(base, -1, parts)
        self._commit([{"part": p, "version": -1, "rows": rows.get(p, 0), "deltas": [], "delta_rows": 0} for p in range(parts)], -1)

    def exists(self) -> bool:
        return bool(versions(self.spark, self.root))

    def add(self, changes: DataFrame, batch: int) -> None:
        """One batch of changes: op (insert, update, delete), seq and the table's columns. Later batches come after earlier
        ones whatever their seq; beside that the rules are those of warehouse.apply_changes()."""
        live = manifest(self.spark, self.root, max(v for v in versions(self.spark, self.root) if v < batch))
        values = [f.name for f in self.schema if f.name not in self.key]
        typed = changes.select("op", "seq", *(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema))
        order = F.struct(F.lit(batch).cast("bigint").alias("batch"), F.col("seq").cast("bigint").alias("seq"))
        # folded before it is dealt into parts, so that a key with many changes is one row
        folded = W.fold_changes(typed, self.key, values, order)
        path = f"{self.root}/delta/batch={batch}"
        self._parted(folded, len(live)).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(path)
        for p, n in self._counts(path, self._delta_schema()).items():
            live[p]["deltas"] = [*live[p]["deltas"], batch]
            live[p]["delta_rows"] += n
        if due := [r for r in live.values() if r["deltas"] and (r["delta_rows"] > self.fold_share * r["rows"] or len(r["deltas"]) >= self.fold_deltas)]:
            rows = self._write_base(self._merged(due), batch, len(live))
            for r in due:
                r.update(version=batch, rows=rows.get(r["part"], 0), deltas=[], delta_rows=0)
        self._commit(list(live.values()), batch)

    def read(self, version: int | None = None) -> DataFrame:
        """The table, as of now or of an earlier version that is still kept."""
        return self._merged(list(manifest(self.spark, self.root, version).values()))

    def vacuum(self, keep: int = 1) -> None:
        """Removes manifests but the newest `keep`, then the files that none of those names."""
        every = versions(self.spark, self.root)
        kept = [r for v in every[-keep:] for r in manifest(self.spark, self.root, v).values()]
        for v in every[:-keep]:
            self._remove(f"{self.root}/manifest/version={v}")
        named = {("version", r["version"], r["part"]) for r in kept} | {("batch", b, r["part"]) for r in kept for b in r["deltas"]}
        for p in _found(self.spark, f"{self.root}/base/version=*/_part=*") + _found(self.spark, f"{self.root}/delta/batch=*/_part=*"):
            kind, number, part = re.search(r"(version|batch)=(-?\d+)/_part=(\d+)$", p).groups()
            # what is newer than the newest manifest belongs to a batch that is being written
            if (kind, int(number), int(part)) not in named and int(number) <= every[-1]:
                self._remove(p)

    def _delta_schema(self) -> T.StructType:
        values = [f for f in self.schema if f.name not in self.key]
        at = T.StructType([T.StructField("batch", T.LongType()), T.StructField("seq", T.LongType())])
        return T.StructType([*(f for f in self.schema if f.name in self.key), T.StructField("_c", T.StructType([T.StructField("op", T.StringType()), *values])), *(T.StructField(c, at) for c in ("_at", "_in", "_out"))])

    def _parted(self, df: DataFrame, parts: int) -> DataFrame:
        return df.withColumn("_part", F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.key)), F.lit(parts)).cast("int"))

    def _write_base(self, rows: DataFrame, version: int, parts: int) -> dict[int, int]:
        path = f"{self.root}/base/version={version}"
        typed = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema))
        self._parted(typed, parts).repartition(parts, "_part").write.mode("overwrite").partitionBy("_part").parquet(path)
        return self._counts(path, self.schema)

    def _counts(self, path: str, schema: T.StructType) -> dict[int, int]:
        """Rows by part of files just written: a scan of no column, at most a row a part."""
        df = self.spark.read.schema(T.StructType([*schema, T.StructField("_part", T.IntegerType())])).parquet(path)
        return {r[0]: r[1] for r in df.groupBy("_part").count().collect()}

    def _merged(self, rows: list[dict]) -> DataFrame:
        # folders of parts are given one by one, so that what was replaced is not even listed
        files = lambda schema, paths: self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        base = files(self.schema, [f"{self.root}/base/version={r['version']}/_part={r['part']}" for r in rows if r["rows"]])
        deltas = [f"{self.root}/delta/batch={b}/_part={r['part']}" for r in rows for b in r["deltas"]]
        if not deltas:
            return base
        folded = W.fold_again(files(self._delta_schema(), deltas), self.key)
        return W.apply_folded(base, folded, self.key).select(*(f"`{c}`" for c in self.schema.names))

    def _commit(self, rows: list[dict], version: int) -> None:
        names = T._parse_datatype_string(MANIFEST).names
        self.spark.createDataFrame([tuple(r[c] for c in names) for r in rows], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")

    def _remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def apply_stream(spark: SparkSession, changes: DataFrame, base: DataFrame, root: str, key: list[str], parts: int = PARTS) -> DataFrame:
    """All change batches there are now onto the table at root, which after a restart goes on from its newest version; base
    counts only where there is none yet."""
    table = ChangingTable(spark, root, base.schema, key)
    if not table.exists():
        table.create(base, parts)
    changes.writeStream.foreachBatch(lambda df, batch: ChangingTable(df.sparkSession, root, base.schema, key).add(df, batch)).option("checkpointLocation", f"{root}_checkpoint").trigger(availableNow=True).start().awaitTermination()
    return table.read()
