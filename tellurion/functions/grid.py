"""Evaluation grids: steps start, start + step ... up to end, in milliseconds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    start: int
    end: int
    step: int

    @property
    def size(self) -> int:
        return (self.end - self.start) // self.step + 1

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.size).select((F.lit(self.start) + F.col("id") * self.step).alias("eval_ts"))

    def windows(self, samples: DataFrame, span: int, ts: str = "unix_milli") -> DataFrame:
        """Samples with _low and _high, the first and last step whose closed window [step - span, step] holds them. Samples
        between two steps share both, or fall into two such groups, however many windows overlap."""
        low = F.greatest(F.lit(0), F.ceil((F.col(ts) - self.start) / self.step))
        high = F.least(F.lit(self.size - 1), F.floor((F.col(ts) + span - self.start) / self.step))
        near = samples.where(F.col(ts).between(self.start - span, self.end))  # reaches the scan where ts is a column of it
        return near.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")

    def bases(self, samples: DataFrame, span: int, ts: str = "unix_milli") -> DataFrame:
        """Samples with _k, the first step whose window holds them, and _d, how many further steps hold them too; neither is
        cut at the ends of the grid. A window of step j holds the samples of _d whose _k is in [j - _d, j]; of _d there are
        two values at most."""
        low, high = F.ceil((F.col(ts) - self.start) / self.step), F.floor((F.col(ts) + span - self.start) / self.step)
        near = samples.where(F.col(ts).between(self.start - span, self.end))
        return near.withColumn("_k", low).withColumn("_d", high - low).where("_d >= 0")

    def spread(self, ranged: DataFrame) -> DataFrame:
        """A row per row and step of those from _from to _to that are in the grid."""
        low, high = F.greatest(F.lit(0), F.col("_from")), F.least(F.lit(self.size - 1), F.col("_to"))
        rows = ranged.withColumn("_from", low).withColumn("_to", high).where("_from <= _to")
        return rows.withColumn("_j", F.explode(F.sequence("_from", "_to"))).withColumn("eval_ts", F.lit(self.start) + F.col("_j") * self.step).drop("_from", "_to", "_j")

    def at_steps(self, windowed: DataFrame) -> DataFrame:
        """A row per row of windows(), or aggregate of them, and step: an equi-group later, no range join."""
        return windowed.withColumn("_k", F.explode(F.sequence("_low", "_high"))).withColumn("eval_ts", F.lit(self.start) + F.col("_k") * self.step).drop("_low", "_high", "_k")

    def fan_out(self, samples: DataFrame, span: int, ts: str = "unix_milli") -> DataFrame:
        """A row per sample and step, for functions whose states do not merge."""
        return self.at_steps(self.windows(samples, span, ts))
