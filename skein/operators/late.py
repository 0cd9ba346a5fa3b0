"""Per-period aggregates that late records correct up to a cut-off (problem 4).

State is a multiset per (key, period): how often each value occurred, split by how late it arrived. Late records
only adjust counts, so two states merge by addition, in any order, and medians, distinct counts and extremes are
exact at every moment: they are read from cumulative counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.runtime import cut

STATE = ["on_time", "late", "dropped"]


def first_arrivals(df: DataFrame, record_id: list[str], arrived: str, carry: list[str]) -> DataFrame:
    """One row per record, as of its earliest arrival. Records that have no arrival time at all are left out."""
    seen = df.filter(F.col(arrived).isNotNull())
    return (
        seen.groupBy(*record_id)
        .agg(F.min_by(F.struct(*carry, arrived), F.struct(arrived, *carry)).alias("_first"))
        .select(*record_id, "_first.*")
    )


def multiset(df: DataFrame, keys: list[str], event_ms: Column, arrived_ms: Column, value: Column, period_ms: int, cutoff_ms: int) -> DataFrame:
    """State rows: keys, period_start_ms, value, on_time, late, dropped.

    on_time counts records that arrived before the period's end (also ahead of their time), late those before the
    end plus ``cutoff_ms``, dropped the rest. Partial aggregation absorbs hot periods. A null value is a value of
    its own; rows without event or arrival time are left out.
    """
    start = event_ms - F.pmod(event_ms, F.lit(period_ms))
    end = F.col("period_start_ms") + F.lit(period_ms)
    rows = df.withColumns({"period_start_ms": start, "_at": arrived_ms, "value": value})
    rows = rows.filter(F.col("period_start_ms").isNotNull() & F.col("_at").isNotNull())
    n = lambda when: F.sum(F.when(when, 1).otherwise(0))
    return rows.groupBy(*keys, "period_start_ms", "value").agg(
        n(F.col("_at") < end).alias("on_time"),
        n((F.col("_at") >= end) & (F.col("_at") < end + cutoff_ms)).alias("late"),
        n(F.col("_at") >= end + cutoff_ms).alias("dropped"),
    )


def merge(*states: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of states, e.g. yesterday's and that of a new batch of late records."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    return both.groupBy(*keys, "period_start_ms", "value").agg(*[F.sum(c).alias(c) for c in STATE])


def counts(state: DataFrame, keys: list[str]) -> DataFrame:
    """Per period: first_count, final_count, dropped_count, late_arrivals."""
    return state.groupBy(*keys, "period_start_ms").agg(
        F.sum("on_time").alias("first_count"),
        F.sum(F.col("on_time") + F.col("late")).alias("final_count"),
        F.sum("dropped").alias("dropped_count"),
        F.sum(F.col("late") + F.col("dropped")).alias("late_arrivals"),
    )


def statistics(state: DataFrame, keys: list[str], corrected: bool = True) -> DataFrame:
    """Exact n, distinct, minimum, maximum and lower median per period, of the corrected or the first state.

    The state is cut into ranges by (keys, period, value), so a period with a third of all values spreads over tasks, and
    written once. Each range gives a period's counts and extremes; a window over these few rows (one per range and
    period) tells how many values lie below each range, and only the range that holds the middle is ranked value by
    value. Null and NaN values don't count here.
    """
    n = F.col("on_time") + F.col("late") if corrected else F.col("on_time")
    rows = state.select(*keys, "period_start_ms", "value", n.alias("_n")).filter((F.col("_n") > 0) & F.col("value").isNotNull())
    if dict(state.dtypes)["value"] in ("double", "float"):
        rows = rows.filter(~F.isnan("value"))
    period = [*keys, "period_start_ms"]
    ranges = cut(rows.repartitionByRange(*period, "value").withColumn("_range", F.spark_partition_id()))
    parts = ranges.groupBy(*period, "_range").agg(F.sum("_n").alias("_m"), F.count("*").alias("_d"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    by = Window.partitionBy(*period)
    below = by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns({"_all": F.sum("_m").over(by), "_below": F.coalesce(F.sum("_m").over(below), F.lit(0))})
    middle = F.floor((F.col("_all") + 1) / 2)
    whole = placed.groupBy(*period).agg(
        F.sum("_m").alias("n"), F.sum("_d").alias("distinct_values"), F.min("_lo").alias("minimum"), F.max("_hi").alias("maximum"),
        F.max(F.when((F.col("_below") < middle) & (middle <= F.col("_below") + F.col("_m")), F.struct("_range", (middle - F.col("_below")).alias("_rank")))).alias("_at"),
    )
    key = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in period]
    held = whole.select(*period, "n", "distinct_values", "minimum", "maximum", F.col("_at._range").alias("_range"), F.col("_at._rank").alias("_rank"), F.xxhash64(*key).alias("_key"))
    inside = ranges.withColumn("_key", F.xxhash64(*key)).join(held.select("_key", "_range", "_rank", *[F.col(k).alias(f"_{k}") for k in period]), ["_key", "_range"])
    for k in period:  # null keys are equal here
        inside = inside.filter(F.col(k).eqNullSafe(F.col(f"_{k}")))
    upto = Window.partitionBy(*period, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.withColumn("_upto", F.sum("_n").over(upto)).filter(F.col("_upto") >= F.col("_rank"))
    median = ranked.groupBy("_key", *period).agg(F.min("value").alias("median")).select("_key", *[F.col(k).alias(f"_{k}") for k in period], "median")
    same = F.col("held._key") == F.col("m._key")
    for k in period:
        same = same & F.col(f"held.{k}").eqNullSafe(F.col(f"m._{k}"))
    return held.alias("held").join(median.alias("m"), same).select(*[F.col(f"held.{k}") for k in period], "n", "distinct_values", "minimum", "maximum", "median")
