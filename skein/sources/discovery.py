"""What is there: series, label names and values, metadata, tags, and the results' JSON encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import labels as lab
from skein.plans.promql import parser as pp
from skein.plans.promql.compile import evaluate, matcher


def matching(rows: DataFrame, selectors: list[str]) -> DataFrame:
    """Rows whose labels match at least one selector; all rows if there is none."""
    if not selectors:
        return rows
    hit = F.lit(False)
    for text in selectors:
        one = F.lit(True)
        for name, op, value in pp.parse(text).matchers:
            one = one & matcher(lab.get(F.col("labels"), name), op, value)
        hit = hit | one
    return rows.filter(hit)


def within(rows: DataFrame, time: str, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        rows = rows.filter(F.col(time) >= start)
    return rows if end is None else rows.filter(F.col(time) <= end)


def series(rows: DataFrame, selectors: list[str], time: str = "ts_ms", start: int | None = None, end: int | None = None) -> DataFrame:
    return matching(within(rows, time, start, end), selectors).select("labels").distinct()


def label_names(rows: DataFrame, selectors: list[str] = (), time: str = "ts_ms", start: int | None = None, end: int | None = None) -> DataFrame:  # type: ignore[assignment]
    found = matching(within(rows, time, start, end), list(selectors)).select(F.explode("labels").alias("l"))
    return found.select(F.col("l.name").alias("name")).distinct()


def label_values(rows: DataFrame, name: str, selectors: list[str] = (), time: str = "ts_ms", start: int | None = None, end: int | None = None) -> DataFrame:  # type: ignore[assignment]
    found = matching(within(rows, time, start, end), list(selectors)).select(lab.get(F.col("labels"), name).alias("value"))
    return found.filter(F.col("value").isNotNull()).distinct()


def metric_metadata(catalogue: DataFrame) -> DataFrame:
    """metric_name, metric_type, unit: of several rows of a metric the last (highest series_id) counts."""
    return catalogue.groupBy("metric_name").agg(F.max_by("metric_type", "series_id").alias("metric_type"), F.max_by(F.coalesce("unit", F.lit("")), "series_id").alias("unit"))


def federate(spark, samples: DataFrame, selectors: list[str], at_ms: int) -> DataFrame:
    """Text lines name{labels} value timestamp of the newest sample of every matching series."""
    parts = [evaluate(spark, samples, s, at_ms) for s in selectors]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    escape = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    text = F.transform(F.filter("labels", lambda x: x["name"] != "__name__"), lambda x: F.concat(x["name"], F.lit('="'), escape(x["value"]), F.lit('"')))
    name = F.coalesce(lab.get(F.col("labels"), "__name__"), F.lit(""))
    line = F.concat(name, F.lit("{"), F.array_join(text, ","), F.lit("} "), F.col("value").cast("string"), F.lit(" "), F.lit(str(at_ms)))
    return rows.filter(F.col("hist").isNull()).dropDuplicates(["labels"]).select(line.alias("line"))


# --- traces ---------------------------------------------------------------------------------------------------------


def trace_by_id(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.filter(F.col("trace_id") == trace_id.lower()).orderBy("start_ns", "span_id")


def exact_search(spans: DataFrame, attributes: dict[str, str], start_ns: int, end_ns: int, limit: int = 20) -> DataFrame:
    """trace_id, start_ns of traces that overlap [start, end] and in which every attribute value occurs."""
    text = lambda m, k: F.try_element_at(m, F.lit(k))["s"]
    hits = [F.max(F.coalesce((text("span_attrs", k) == v) | (text("resource_attrs", k) == v), (text("span_attrs", k) == v), (text("resource_attrs", k) == v), F.lit(False))).alias(f"h{i}") for i, (k, v) in enumerate(attributes.items())]
    g = spans.groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), *hits)
    keep = (F.col("start_ns") <= end_ns) & (F.col("end_ns") >= start_ns)
    for i in range(len(hits)):
        keep = keep & F.col(f"h{i}")
    return g.filter(keep).select("trace_id", "start_ns").orderBy("start_ns", "trace_id").limit(limit)


def scan(spans: DataFrame, limit: int = 20) -> DataFrame:
    return spans.groupBy("trace_id").agg(F.min("start_ns").alias("start_ns"), F.count("*").alias("spans")).orderBy("start_ns", "trace_id").limit(limit)


SCOPES = {"span": "span_attrs", "resource": "resource_attrs", "instrumentation": "scope_attrs"}
# Tags that every span has.
INTRINSIC_TAGS = ["duration", "kind", "name", "rootName", "rootServiceName", "status", "statusMessage", "traceDuration"]


def tag_names(spans: DataFrame, scope: str | None = None) -> DataFrame:
    """scope, name of the attributes in use, and of the intrinsics."""
    parts = [spans.select(F.lit(s).alias("scope"), F.explode(F.map_keys(m)).alias("name")).distinct() for s, m in SCOPES.items() if scope in (None, s)]
    if scope in (None, "intrinsic"):
        parts.append(spans.sparkSession.createDataFrame([("intrinsic", n) for n in INTRINSIC_TAGS], "scope string, name string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tag_values(spans: DataFrame, name: str, scope: str | None = None) -> DataFrame:
    """type, value of an attribute, or of the intrinsics name, kind and status."""
    if scope in (None, "intrinsic") and name in ("name", "kind", "status"):
        return spans.select(F.lit("string" if name == "name" else "keyword").alias("type"), F.col(name).alias("value")).filter(F.col("value").isNotNull()).distinct()
    parts = [spans.select(F.try_element_at(m, F.lit(name)).alias("v")) for s, m in SCOPES.items() if scope in (None, s)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    v = F.col("v")
    kind = F.when(v["s"].isNotNull(), "string").when(v["b"].isNotNull(), "bool").when(v["i"].isNotNull(), "int").when(v["d"].isNotNull(), "float")
    return out.filter(v.isNotNull()).select(kind.alias("type"), F.coalesce(v["s"], v["b"].cast("string"), v["i"].cast("string"), v["d"].cast("string")).alias("value")).distinct()


# --- encodings ------------------------------------------------------------------------------------------------------


def as_map(labels: Column) -> Column:
    return F.map_from_entries(labels)


def _number(v: Column) -> Column:
    whole = (F.floor(v) == v) & (F.abs(v) < 1e15)
    return F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf").when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def prometheus_json(vector: DataFrame, range_query: bool = False) -> DataFrame:
    """One JSON object per series: metric with value, or with values in time order (bounded by the steps)."""
    pair = F.array((F.col("step") / 1000.0).cast("string"), _number(F.col("value")))
    if not range_query:
        return vector.select(F.to_json(F.struct(as_map(F.col("labels")).alias("metric"), pair.alias("value"))).alias("json"))
    g = vector.groupBy("labels").agg(F.array_sort(F.collect_list(F.struct("step", pair.alias("p")))).alias("v"))
    return g.select(F.to_json(F.struct(as_map(F.col("labels")).alias("metric"), F.transform("v", lambda x: x["p"]).alias("values"))).alias("json"))


def loki_json(entries: DataFrame) -> DataFrame:
    """One JSON object per stream of a limited log result: stream, and values [time, line] newest first."""
    g = entries.groupBy("labels").agg(F.sort_array(F.collect_list(F.struct("ts_ns", "line")), asc=False).alias("v"))
    values = F.transform("v", lambda x: F.array(x["ts_ns"].cast("string"), x["line"]))
    return g.select(F.to_json(F.struct(as_map(F.col("labels")).alias("stream"), values.alias("values"))).alias("json"))


def tempo_json(summaries: DataFrame) -> DataFrame:
    return summaries.select(
        F.to_json(
            F.struct(
                F.col("trace_id").alias("traceID"), F.col("root_service").alias("rootServiceName"), F.col("root_name").alias("rootTraceName"),
                F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.floor(F.col("duration_ns") / 1_000_000).alias("durationMs"), F.struct(F.col("matched")).alias("spanSet"),
            )
        ).alias("json")
    )
