"""Irregular readings onto a regular grid (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein import labels as lab
from skein.runtime import join_checked

DAY_MS = 86_400_000
#: Periods that one generated row stands for before the second explode; bounds the arrays.
CHUNK = 4096


def counted_samples(samples: DataFrame, series: DataFrame) -> DataFrame:
    """Samples that count (value neither null nor NaN, not stale) with their series_id and interval_ms.

    Labels are compared as sets with empty values left out. The catalogue is broadcast only after its rows are
    counted; otherwise both sides are shuffled by the label key. Samples of unknown series, or of a series whose
    interval is null or not positive, are left out.
    """
    catalogue = series.filter(F.col("interval_ms") > 0).select(
        F.col("namespace").alias("_ns"), lab.canonical(F.col("labels")).alias("_ls"), "series_id", "interval_ms"
    )
    good = F.col("value").isNotNull() & ~F.isnan("value") & ~F.coalesce(F.col("stale"), F.lit(False)) & F.col("timestamp_ms").isNotNull()
    rows = samples.filter(good).select(F.col("namespace").alias("_ns"), lab.canonical(F.col("labels")).alias("_ls"), "timestamp_ms", "value")
    return join_checked(rows, catalogue, ["_ns", "_ls"]).select("series_id", "interval_ms", "timestamp_ms", "value")


def regular_grid(readings: DataFrame, max_gap_ms: int, within_days: bool = False) -> DataFrame:
    """One row per series and period between its first and last reading; ``within_days``: of each UTC day instead.

    ``readings``: series_id, interval_ms, timestamp_ms, value. Result: series_id, period_start_ms, interval_ms,
    n (readings), value, observed (n > 0), filled. ``value`` is the newest reading of the period (ties: the
    larger value); an empty period takes the last reading before it if that period began at most ``max_gap_ms``
    earlier (filled), else it is marked by a null value.

    Readings are first aggregated to buckets with map-side partials, so a hot series shrinks to one row per period
    before it meets the grid, and the grid join hashes (series, period): no key is hot. The carry-forward window is
    partitioned by series and chunk of CHUNK periods; what a chunk inherits comes from a window over one row per
    chunk. With ``within_days`` days take the place of chunks and inherit nothing. Null keys or times take no part.
    """
    start = F.col("timestamp_ms") - F.pmod(F.col("timestamp_ms"), F.col("interval_ms"))
    step = F.col("interval_ms") * F.lit(CHUNK)
    part = F.floor(F.col("period_start_ms") / F.lit(DAY_MS)) if within_days else F.col("period_start_ms") - F.pmod(F.col("period_start_ms"), step)
    series = ["series_id", "interval_ms"]
    buckets = (
        readings.filter(F.col("series_id").isNotNull() & F.col("timestamp_ms").isNotNull() & (F.col("interval_ms") > 0))
        .withColumn("period_start_ms", start)
        .groupBy(*series, "period_start_ms")
        .agg(F.count("*").alias("n"), F.max(F.struct("timestamp_ms", "value")).alias("newest"))
        .select(*series, "period_start_ms", "n", F.col("newest.value").alias("value"))
    )
    ends = buckets.groupBy(*series, part.alias("part")).agg(
        F.min("period_start_ms").alias("lo"), F.max("period_start_ms").alias("hi"), F.max(F.struct("period_start_ms", "value")).alias("end")
    )
    if within_days:
        chunks = ends.select(*series, "part", "lo", "hi", F.lit(None).cast(ends.schema["end"].dataType).alias("_carry"))
    else:
        spans = ends.groupBy(*series).agg(F.min("part").alias("from"), F.max("part").alias("to"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        every = spans.select(*series, "lo", "hi", F.explode(F.sequence("from", "to", step)).alias("part"))
        earlier = Window.partitionBy(*series).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        chunks = every.join(ends.select(*series, "part", "end"), [*series, "part"], "left").select(
            *series, "part", F.greatest("lo", "part").alias("lo"), F.least("hi", F.col("part") + step - F.col("interval_ms")).alias("hi"),
            F.last("end", ignorenulls=True).over(earlier).alias("_carry"),
        )
    grid = (
        chunks.select(*series, "part", "hi", "_carry", F.explode(F.sequence("lo", "hi", step)).alias("at"))
        .select(
            *series, "part", "_carry",
            F.explode(F.sequence("at", F.least("hi", F.col("at") + step - F.col("interval_ms")), F.col("interval_ms"))).alias("period_start_ms"),
        )
    )
    joined = grid.join(buckets, [*series, "period_start_ms"], "left")
    before = Window.partitionBy(*series, "part").orderBy("period_start_ms").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.last(F.when(F.col("n") > 0, F.struct("period_start_ms", "value")), ignorenulls=True).over(before), F.col("_carry"))
    near = F.col("period_start_ms") - F.col("_last.period_start_ms") <= F.lit(max_gap_ms)
    observed = F.coalesce(F.col("n"), F.lit(0)) > 0
    return joined.withColumn("_last", last).select(
        "series_id", "period_start_ms", "interval_ms",
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        F.when(observed, F.col("value")).when(near, F.col("_last.value")).alias("value"),
        observed.alias("observed"), (~observed & near).alias("filled"),
    )


def missing_periods(grid: DataFrame, within_days: bool = False) -> DataFrame:
    """Empty periods with readings both before and after within the same UTC day; ``within_days`` as the grid was made."""
    if not within_days:
        day = Window.partitionBy("series_id", F.floor(F.col("period_start_ms") / F.lit(DAY_MS)))
        seen = F.when(F.col("observed"), F.col("period_start_ms"))
        grid = grid.withColumns({"_lo": F.min(seen).over(day), "_hi": F.max(seen).over(day)}).filter(F.col("period_start_ms").between(F.col("_lo"), F.col("_hi")))
    return grid.filter(~F.col("observed")).select("series_id", "period_start_ms")
