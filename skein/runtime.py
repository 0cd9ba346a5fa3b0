"""Helpers that tie plans to the session: reading tables, cutting lineage, size-checked joins."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if a bounded count finds at most this many rows.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``directory`` (one file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only where unset, and only in local mode, one of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="skein-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right`` only if its counted size allows it; otherwise a shuffled join, whose skew AQE splits."""
    return left.join(F.broadcast(right) if is_small(right, rows) else right, on, how)


def utc_micros(column: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone that means UTC, whatever the session's zone."""
    zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z"):
        column = F.convert_timezone(F.lit("UTC"), F.lit(zone), column)
    return F.unix_micros(column.cast("timestamp"))
