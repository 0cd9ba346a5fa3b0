"""Time grid, neighbours in a series, and samples spread over the steps that see them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein import labels as lab

#: Length of the time blocks that bound a window partition, however long or hot a series is.
BLOCK_MS = 6 * 3_600_000


@dataclass(frozen=True)
class Grid:
    """Steps start, start + step, ... up to end, in milliseconds."""

    start: int
    end: int
    step: int

    @property
    def count(self) -> int:
        return (self.end - self.start) // self.step + 1 if self.step and self.end >= self.start else 1

    @property
    def last(self) -> int:
        return self.start + (self.count - 1) * max(self.step, 1)

    def steps(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.count).select((F.lit(self.start) + F.col("id") * F.lit(max(self.step, 1))).alias("step"))


def neighbours(df: DataFrame, keys: list[str], time: str, carry: dict[str, str], reach: int, forward: bool = False, block: int = BLOCK_MS) -> DataFrame:
    """Adds columns of the row before (or after) in time with the same keys, if it is at most ``reach`` away.

    ``carry``: column -> new name. Windows are partitioned by a 128-bit hash of the keys and by time block, so a series
    with a third of all samples is sorted in many tasks. Rows within reach of a block's border are also sent to the
    neighbouring block, where they serve as neighbours only: one shuffle, no join.
    """
    block = max(block, 4 * reach)
    home = F.floor(F.col(time) / F.lit(block)).cast("bigint")
    into = F.col(time) - home * F.lit(block)
    guest = F.when(into < reach, home - 1) if forward else F.when(into >= block - reach, home + 1)
    copies = F.filter(F.array(home, guest), lambda x: x.isNotNull())
    one, two = lab.key(*[F.col(k) for k in keys])
    rows = df.withColumns({"_k1": one, "_k2": two, "_home": home, "_block": F.explode(copies)})
    w = Window.partitionBy("_k1", "_k2", "_block").orderBy(F.col(time))
    step = F.lead if forward else F.lag
    near = rows.withColumns({n: step(c).over(w) for c, n in carry.items()}).filter(F.col("_block") == F.col("_home"))
    return near.select(*df.columns, *carry.values())


def visible(grid: Grid, effective_shift: int, low: Column, high: Column) -> Column:
    """The steps whose effective time e = step - shift satisfies low <= e < high, as an array (empty if none)."""
    step, start = F.lit(max(grid.step, 1)), F.lit(grid.start - effective_shift)
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((low - start) / step).cast("bigint"))
    last = F.least(F.lit(grid.count - 1).cast("bigint"), (F.ceil((high - start) / step) - 1).cast("bigint"))
    steps = F.transform(F.sequence(first, last), lambda i: F.lit(grid.start) + i * step)
    return F.when(first <= last, steps).otherwise(F.array().cast("array<bigint>"))
