"""Model views over tables: metric samples, log entries, spans, vectors, files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import labels as lab
from skein.functions.histograms import HISTOGRAM
from skein.runtime import table, utc_micros


def metric_samples(spark: SparkSession, d: str, namespace: str | None = None, as_metric: str | None = None) -> DataFrame:
    """labels, ts_ms, value, stale, hist from samples. Of rows of one series and time the last written one counts
    (highest sample_id; a redelivered row is the same row). Rows without a value that are not stale are left out.
    Without ``namespace`` the namespace becomes a label of that name. ``as_metric`` renames all series to that metric
    and keeps their name as the label ``metric``. The column ``namespace`` repeats the label: compilers filter on it, and it
    is part of the grouping, so filters on it and on the time reach the scan."""
    rows = table(spark, d, "samples").filter((F.col("value").isNotNull() | F.coalesce("stale", F.lit(False))) & F.col("timestamp_ms").isNotNull())
    if namespace is not None:
        rows = rows.filter(F.col("namespace") == namespace)
    extra = {} if namespace is not None else {"namespace": F.col("namespace")}
    if as_metric:
        extra |= {"metric": lab.get(F.col("labels"), "__name__"), "__name__": F.lit(as_metric)}
    labels = lab.canonical(F.col("labels"), extra)
    rows = rows.select(labels.alias("labels"), F.col("timestamp_ms").alias("ts_ms"), F.coalesce("value", F.lit(float("nan"))).alias("value"), F.coalesce("stale", F.lit(False)).alias("stale"), "sample_id", "namespace")
    last = rows.groupBy("labels", "ts_ms", "namespace").agg(F.max_by("value", "sample_id").alias("value"), F.max_by("stale", "sample_id").alias("stale"))
    out = last.withColumn("hist", F.lit(None).cast(HISTOGRAM))
    return out if namespace is None else out.drop("namespace")


def native_histograms(spark: SparkSession, d: str) -> DataFrame:
    """The same columns from histograms."""
    pairs = lambda s: F.expr(f"transform({s}_indexes, (x, i) -> named_struct('index', x, 'count', {s}_counts[i]))")
    rows = table(spark, d, "histograms").filter(F.col("hist_count").isNotNull() & F.col("timestamp_ms").isNotNull())
    hist = F.struct(
        F.col("hist_schema").alias("schema"), "zero_threshold", "zero_count", F.col("hist_count").alias("count"), F.col("hist_sum").alias("sum"),
        pairs("positive").alias("positive"), pairs("negative").alias("negative"), "custom_values", F.col("counter_reset_hint").alias("hint"),
    ).cast(HISTOGRAM)
    labels = lab.canonical(F.col("labels"), {"namespace": F.col("namespace")})
    rows = rows.select(labels.alias("labels"), F.col("timestamp_ms").alias("ts_ms"), hist.alias("hist"), "hist_id")
    last = rows.groupBy("labels", "ts_ms").agg(F.max_by("hist", "hist_id").alias("hist"))
    return last.select("labels", "ts_ms", F.lit(None).cast("double").alias("value"), F.lit(False).alias("stale"), "hist")


def log_entries(spark: SparkSession, d: str) -> DataFrame:
    """labels, ts_ns, line, metadata, entry_id, namespace from log_entries; null lines are left out. The namespace is a
    label, repeated as a column.

    A redelivered row is a copy of the whole row, so rows are grouped by all they hold: filters on any of it run before
    the deduplication, and those on time, namespace and line reach the scan. Should copies of an entry_id ever
    differ, each different one stays."""
    rows = table(spark, d, "log_entries").filter(F.col("line").isNotNull() & F.col("timestamp_ns").isNotNull())
    labels = lab.canonical(F.col("labels"), {"namespace": F.col("namespace")})
    pairs = F.to_json("structured_metadata")
    own = rows.select("entry_id", labels.alias("labels"), F.col("timestamp_ns").alias("ts_ns"), "line", pairs.alias("meta"), "namespace")
    once = own.groupBy(*own.columns).agg(F.lit(1).alias("_x"))
    return once.select("labels", "ts_ns", "line", F.coalesce(F.from_json("meta", "map<string,string>"), F.expr("cast(map() as map<string,string>)")).alias("metadata"), "entry_id", "namespace")


ATTRIBUTE = "struct<s:string,b:boolean,i:bigint,d:double>"


def spans(spark: SparkSession, d: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame:
    """Span rows of the trace model from spans, each (trace_id, span_id) once (the copy delivered first).

    Spans that start in [start_ns, end_ns): copies of a span start at one time, so these bounds reach the scan. What
    else a query asks of a span holds for the copy that stays and can't come before.
    """
    rows = table(spark, d, "spans").filter(F.col("trace_id").isNotNull() & F.col("span_id").isNotNull() & F.col("start_time").isNotNull())
    for bound, inside in ((start_ns, lambda t: F.col("start_time") >= t), (end_ns, lambda t: F.col("start_time") < t)):
        if bound is not None:
            at = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=-(-bound // 1000))  # UTC without a zone, as the column
            rows = rows.filter(inside(F.lit(at.isoformat(" ", "microseconds")).cast("timestamp_ntz")))
    own = F.filter(F.col("refs"), lambda r: (r["ref_type"] == "CHILD_OF") & (F.lower(r["trace_id"]) == F.lower(F.col("trace_id"))))
    value = lambda v: F.struct(v.alias("s"), F.lit(None).cast("boolean").alias("b"), F.expr("try_cast(null as bigint)").alias("i"), F.lit(None).cast("double").alias("d"))
    start = utc_micros(F.col("start_time")) * 1000
    body = F.struct(
        F.lower(F.get(own, F.lit(0))["span_id"]).alias("parent_span_id"), F.col("operation_name").alias("name"), F.lower("span_kind").alias("kind"), F.lower("status_code").alias("status"),
        start.alias("start_ns"), (start + F.coalesce("duration", F.lit(0))).alias("end_ns"), F.to_json("tags").alias("tags"), "service_name",
    )
    rows = rows.select(F.lower("trace_id").alias("_t"), F.lower("span_id").alias("_s"), body.alias("_b"), "ingested_at")
    first = F.min_by("_b", F.struct(F.col("ingested_at").isNull(), "ingested_at", "_b")).alias("b")
    one = rows.groupBy(F.col("_t").alias("trace_id"), F.col("_s").alias("span_id")).agg(first)
    attrs = F.transform_values(F.from_json("b.tags", "map<string,string>"), lambda _, v: value(v))
    empty = F.expr(f"cast(map() as map<string,{ATTRIBUTE}>)")
    service = F.when(F.col("b.service_name").isNotNull(), F.create_map(F.lit("service.name"), value(F.col("b.service_name")))).otherwise(empty)
    return one.select(
        "trace_id", "span_id", *[f"b.{c}" for c in ("parent_span_id", "name", "kind", "status")], F.lit(None).cast("string").alias("status_message"), "b.start_ns", "b.end_ns",
        F.coalesce(attrs, empty).cast(f"map<string,{ATTRIBUTE}>").alias("span_attrs"), service.cast(f"map<string,{ATTRIBUTE}>").alias("resource_attrs"),
        F.lit(None).cast("string").alias("scope_name"), F.lit(None).cast("string").alias("scope_version"), empty.alias("scope_attrs"),
    )
