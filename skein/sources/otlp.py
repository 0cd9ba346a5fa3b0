"""Metrics, logs and traces in JSON to model rows, with from_json and explode only: OTLP metrics, logs and traces, Loki push, Zipkin, bulk NDJSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import labels as lab
from skein.functions.histograms import HISTOGRAM
from skein.functions.levels import detected_level
from skein.model import ATTRIBUTE
from skein.plans.logql.stages import clean, flatten

ANY = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double>"
ATTRS = f"array<struct<key:string,value:{ANY}>>"
POINT = f"attributes:{ATTRS},timeUnixNano:string"
METRICS = (
    f"resourceMetrics array<struct<resource:struct<attributes:{ATTRS}>,scopeMetrics:array<struct<metrics:array<struct<name:string,unit:string,description:string,"
    f"gauge:struct<dataPoints:array<struct<{POINT},asDouble:double,asInt:string>>>,"
    f"sum:struct<aggregationTemporality:string,isMonotonic:boolean,dataPoints:array<struct<{POINT},asDouble:double,asInt:string>>>,"
    f"histogram:struct<aggregationTemporality:string,dataPoints:array<struct<{POINT},count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>>>>,"
    f"exponentialHistogram:struct<aggregationTemporality:string,dataPoints:array<struct<{POINT},count:string,sum:double,scale:int,zeroCount:string,zeroThreshold:double,"
    "positive:struct<offset:int,bucketCounts:array<string>>,negative:struct<offset:int,bucketCounts:array<string>>>>>,"
    f"summary:struct<dataPoints:array<struct<{POINT},count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>>>>>>>>>>"
)
# Unit suffixes of metric names.
UNITS = {"s": "seconds", "ms": "milliseconds", "us": "microseconds", "ns": "nanoseconds", "min": "minutes", "h": "hours", "d": "days", "By": "bytes", "KiBy": "kibibytes", "MiBy": "mebibytes", "GiBy": "gibibytes", "KBy": "kilobytes", "MBy": "megabytes", "GBy": "gigabytes", "m": "meters", "V": "volts", "A": "amperes", "J": "joules", "W": "watts", "g": "grams", "Cel": "celsius", "Hz": "hertz", "%": "percent"}
DELTA = ("1", "AGGREGATION_TEMPORALITY_DELTA")


def clean_name(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9_:]", "_"), "_+", "_")
    return F.when(c.rlike("^[0-9]"), F.concat(F.lit("_"), c)).otherwise(c)


def clean_label(c: Column) -> Column:
    c = F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    return F.when(c.rlike("^[0-9]"), F.concat(F.lit("key_"), c)).otherwise(c)


def metric_name(name: Column, unit: Column, counter: bool | Column, ratio: bool | Column) -> Column:
    """Sanitised name, with the unit and, of counters, _total behind; a gauge of unit 1 is a ratio."""
    word = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.coalesce(unit, F.lit("")))
    base = F.regexp_replace(clean_name(name), "^_+|_+$", "")
    counter, ratio = (c if isinstance(c, Column) else F.lit(c) for c in (counter, ratio))
    base = F.when(counter, F.regexp_replace(base, "_total$", "")).otherwise(base)
    base = F.when(word.isNotNull() & ~F.endswith(base, word), F.concat(base, F.lit("_"), word)).otherwise(base)
    base = F.when(ratio & (unit == "1") & ~F.endswith(base, F.lit("ratio")), F.concat(base, F.lit("_ratio"))).otherwise(base)
    return F.when(counter, F.concat(base, F.lit("_total"))).otherwise(base)


def text_of(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], v["boolValue"].cast("string"), v["doubleValue"].cast("string"))


def pairs(attrs: Column) -> Column:
    return F.transform(F.coalesce(attrs, F.array().cast(ATTRS)), lambda a: F.struct(clean_label(a["key"]).alias("name"), text_of(a["value"]).alias("value"))).cast(lab.LABELS)


def attribute(attrs: Column, name: str) -> Column:
    return text_of(F.get(F.filter(attrs, lambda a: a["key"] == name), F.lit(0))["value"])


def _label(name: str, value: Column) -> Column:
    return F.array(F.struct(F.lit(name).alias("name"), value.alias("value"))).cast(lab.LABELS)


def metrics(bodies: DataFrame, column: str = "value") -> DataFrame:
    """labels, ts_ms, value, stale, hist of OTLP metric requests. Delta temporality is dropped; of histograms come
    cumulative _bucket, _sum and _count series, of exponential ones native histograms, of summaries quantile series."""
    m = (
        bodies.select(F.from_json(column, METRICS)["resourceMetrics"].alias("r")).select(F.explode("r").alias("r"))
        .select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeMetrics").alias("s")).select("ra", F.explode("s.metrics").alias("m")).select("ra", "m.*")
    )
    service = F.concat_ws("/", attribute(F.col("ra"), "service.namespace"), attribute(F.col("ra"), "service.name"))
    base = F.concat(pairs(F.col("ra")), _label("job", service), _label("instance", F.coalesce(attribute(F.col("ra"), "service.instance.id"), F.lit(""))))
    ts = F.expr("cast(p.timeUnixNano AS bigint) div 1000000")  # not by a float, which is too coarse

    def points(field: str, name: Column, delta: bool = True) -> DataFrame:
        rows = m.filter(F.col(field).isNotNull())
        if delta:
            rows = rows.filter(~F.coalesce(F.col(f"{field}.aggregationTemporality"), F.lit("2")).isin(*DELTA))
        return rows.select(base.alias("base"), name.alias("name"), F.explode(f"{field}.dataPoints").alias("p"))

    def rows(df: DataFrame, name: Column, value: Column, extra: list[Column] = (), hist: Column | None = None) -> DataFrame:  # type: ignore[assignment]
        merged = F.concat(_label("__name__", name), *extra, pairs(F.col("p.attributes")), F.col("base"))
        first = lambda x, i: ~F.exists(F.slice(merged, F.lit(1), i), lambda y: y["name"] == x["name"])
        unique = lab.canonical(F.filter(merged, first))
        return df.select(unique.alias("labels"), ts.alias("ts_ms"), value.cast("double").alias("value"), F.lit(False).alias("stale"), (hist if hist is not None else F.lit(None)).cast(HISTOGRAM).alias("hist"))

    number = F.coalesce(F.col("p.asDouble"), F.col("p.asInt").cast("double"))
    gauge = points("gauge", metric_name(F.col("name"), F.col("unit"), False, True), False)
    total = points("sum", metric_name(F.col("name"), F.col("unit"), F.coalesce(F.col("sum.isMonotonic"), F.lit(False)), False))
    hist = points("histogram", metric_name(F.col("name"), F.col("unit"), False, False))
    expo = points("exponentialHistogram", metric_name(F.col("name"), F.col("unit"), False, False))
    summ = points("summary", metric_name(F.col("name"), F.col("unit"), False, False), False)
    bounds = F.concat(F.transform("p.explicitBounds", lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), F.array(F.lit("+Inf")))
    cumulative = F.transform("p.bucketCounts", lambda _, i: F.aggregate(F.slice("p.bucketCounts", F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x.cast("double")))
    buckets = hist.select("*", F.explode(F.arrays_zip(bounds.alias("le"), cumulative.alias("n"))).alias("b"))
    quantiles = summ.select("*", F.explode("p.quantileValues").alias("q"))
    side = lambda s: F.transform(F.coalesce(F.col(f"p.{s}.bucketCounts"), F.array().cast("array<string>")), lambda x, i: F.struct((F.col(f"p.{s}.offset") + i + 1).alias("index"), x.cast("double").alias("count")))
    native = F.struct(
        F.col("p.scale").alias("schema"), F.coalesce(F.col("p.zeroThreshold"), F.lit(0.0)).alias("zero_threshold"), F.coalesce(F.col("p.zeroCount").cast("double"), F.lit(0.0)).alias("zero_count"), F.col("p.count").cast("double").alias("count"),
        F.col("p.sum").alias("sum"), side("positive").alias("positive"), side("negative").alias("negative"), F.array().cast("array<double>").alias("custom_values"), F.lit("UNKNOWN").alias("hint"),
    )
    n = F.col("name")
    parts = [rows(gauge, n, number), rows(total, n, number), rows(buckets, F.concat(n, F.lit("_bucket")), F.col("b.n"), [_label("le", F.col("b.le"))])]
    for df in (hist, summ):
        parts += [rows(df, F.concat(n, F.lit("_sum")), F.col("p.sum")), rows(df, F.concat(n, F.lit("_count")), F.col("p.count"))]
    parts += [rows(expo, n, F.lit(None), hist=native), rows(quantiles, n, F.col("q.value"), [_label("quantile", F.regexp_replace(F.col("q.quantile").cast("string"), r"\.0$", ""))])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("value").isNotNull() | F.col("hist").isNotNull())


EMPTY = "cast(map() as map<string,string>)"


def _entry(labels: Column, ts: Column, line: Column, meta: Column) -> list[Column]:
    level = detected_level(line, meta, labels)
    return [labels.alias("labels"), ts.alias("ts_ns"), line.alias("line"), F.map_concat(F.map_filter(meta, lambda k, _: k != "detected_level"), F.create_map(F.lit("detected_level"), level)).alias("metadata")]


def loki_push(bodies: DataFrame, column: str = "value") -> DataFrame:
    """labels, ts_ns, line, metadata of JSON push bodies."""
    s = bodies.select(F.explode(F.from_json(column, "streams array<struct<stream:map<string,string>,values:array<array<string>>>>")["streams"]).alias("s"))
    v = s.select(lab.from_map(F.col("s.stream")).alias("ls"), F.explode("s.values").alias("v"))
    meta = F.coalesce(F.from_json(F.get("v", F.lit(2)), "map<string,string>"), F.expr(EMPTY))
    return v.select("ls", F.get("v", F.lit(0)).cast("bigint").alias("ts"), F.get("v", F.lit(1)).alias("text"), meta.alias("meta")).select(*_entry(F.col("ls"), F.col("ts"), F.col("text"), F.col("meta")))


def logs(bodies: DataFrame, column: str = "value") -> DataFrame:
    """OTLP logs: resource attributes become stream labels, scope and record attributes metadata."""
    kind = f"resourceLogs array<struct<resource:struct<attributes:{ATTRS}>,scopeLogs:array<struct<scope:struct<name:string,version:string,attributes:{ATTRS}>,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityText:string,body:{ANY},attributes:{ATTRS},traceId:string,spanId:string>>>>>>"
    r = bodies.select(F.explode(F.from_json(column, kind)["resourceLogs"]).alias("r")).select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeLogs").alias("s"))
    r = r.select("ra", F.col("s.scope").alias("scope"), F.explode("s.logRecords").alias("l"))
    as_map = lambda a: F.map_from_entries(F.filter(F.array_distinct(pairs(a)), lambda x: x["value"].isNotNull()))
    fixed = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.create_map(F.lit(name), c)).otherwise(F.expr(EMPTY))
    meta = F.map_concat(as_map(F.col("l.attributes")), fixed("severity_text", F.col("l.severityText")), fixed("trace_id", F.col("l.traceId")), fixed("span_id", F.col("l.spanId")), fixed("scope_name", F.col("scope.name")))
    ts = F.coalesce(F.when(F.col("l.timeUnixNano") != "0", F.col("l.timeUnixNano")), F.col("l.observedTimeUnixNano")).cast("bigint")
    v = r.select(lab.canonical(pairs(F.col("ra"))).alias("ls"), ts.alias("ts"), F.coalesce(text_of(F.col("l.body")), F.lit("")).alias("text"), meta.alias("meta"))
    return v.select(*_entry(F.col("ls"), F.col("ts"), F.col("text"), F.col("meta")))


def bulk(bodies: DataFrame, column: str = "value", time_field: str = "@timestamp", message_field: str = "message", stream_fields: tuple[str, ...] = ()) -> DataFrame:
    """NDJSON of action and document lines; only index and create count. Nested fields are flattened with '_'.

    Documents lie on the line after their action; lines are paired within a body, so bodies stay whole.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for body in b[column]:
                lines = iter([x for x in (body or "").split("\n") if x.strip()])
                for action in lines:
                    op = next(iter(json.loads(action)), "")
                    if op == "delete":
                        continue
                    document = next(lines, None)
                    if document is None or op not in ("index", "create"):
                        continue
                    flat = flatten(json.loads(document))
                    when = pd.Timestamp(flat.pop(clean(time_field), None) or 0)
                    when = when.tz_convert(None) if when.tzinfo else when
                    line = flat.pop(clean(message_field), "")
                    stream = {clean(f): flat.pop(clean(f)) for f in stream_fields if clean(f) in flat}
                    rows.append((stream, int(when.value), line, flat))
            yield pd.DataFrame(rows, columns=["ls", "ts", "text", "meta"])

    v = bodies.select(column).mapInPandas(run, "ls map<string,string>, ts long, text string, meta map<string,string>")
    return v.select(lab.from_map(F.col("ls")).alias("ls"), "ts", "text", "meta").select(*_entry(F.col("ls"), F.col("ts"), F.col("text"), F.col("meta")))


def _typed(attrs: Column) -> Column:
    entry = lambda a: F.struct(a["key"].alias("key"), F.struct(a["value"]["stringValue"].alias("s"), a["value"]["boolValue"].alias("b"), a["value"]["intValue"].cast("bigint").alias("i"), a["value"]["doubleValue"].alias("d")).alias("value"))
    return F.map_from_entries(F.transform(F.coalesce(attrs, F.array().cast(ATTRS)), entry)).cast(f"map<string,{ATTRIBUTE}>")


# Numbers and names of span kinds and status codes.
KINDS = ["unspecified", "internal", "server", "client", "producer", "consumer"]
STATUS = ["unset", "ok", "error"]


def _enum(c: Column, prefix: str, names: list[str]) -> Column:
    out = F.lower(F.regexp_replace(c, f"^{prefix}", ""))
    for i, n in enumerate(names):
        out = F.when(c == str(i), F.lit(n)).otherwise(out)
    return F.coalesce(out, F.lit(names[0]))


def traces(bodies: DataFrame, column: str = "value") -> DataFrame:
    """Span rows of OTLP trace requests; ids in lower-case hex."""
    span = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{ATTRS},status:struct<code:string,message:string>>"
    kind = f"resourceSpans array<struct<resource:struct<attributes:{ATTRS}>,scopeSpans:array<struct<scope:struct<name:string,version:string,attributes:{ATTRS}>,spans:array<{span}>>>>>"
    r = bodies.select(F.explode(F.from_json(column, kind)["resourceSpans"]).alias("r")).select(F.col("r.resource.attributes").alias("ra"), F.explode("r.scopeSpans").alias("ss"))
    s = r.select("ra", F.col("ss.scope").alias("c"), F.explode("ss.spans").alias("s")).filter(~F.col("s.traceId").rlike("^0*$"))
    return s.select(
        F.lower("s.traceId").alias("trace_id"), F.lower("s.spanId").alias("span_id"), F.lower(F.nullif("s.parentSpanId", F.lit(""))).alias("parent_span_id"), F.col("s.name").alias("name"),
        _enum(F.col("s.kind"), "SPAN_KIND_", KINDS).alias("kind"), _enum(F.col("s.status.code"), "STATUS_CODE_", STATUS).alias("status"), F.col("s.status.message").alias("status_message"),
        F.col("s.startTimeUnixNano").cast("bigint").alias("start_ns"), F.col("s.endTimeUnixNano").cast("bigint").alias("end_ns"), _typed(F.col("s.attributes")).alias("span_attrs"), _typed(F.col("ra")).alias("resource_attrs"),
        F.col("c.name").alias("scope_name"), F.col("c.version").alias("scope_version"), _typed(F.col("c.attributes")).alias("scope_attrs"),
    )


def zipkin(bodies: DataFrame, column: str = "value") -> DataFrame:
    """Span rows of Zipkin v2 JSON arrays; times there are microseconds."""
    kind = "array<struct<traceId:string,id:string,parentId:string,name:string,kind:string,timestamp:bigint,duration:bigint,localEndpoint:struct<serviceName:string>,tags:map<string,string>>>"
    s = bodies.select(F.explode(F.from_json(column, kind)).alias("s"))
    value = lambda v: F.struct(v.alias("s"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("d"))
    empty = F.expr(f"cast(map() as map<string,{ATTRIBUTE}>)")
    tags = F.coalesce(F.transform_values("s.tags", lambda _, v: value(v)).cast(f"map<string,{ATTRIBUTE}>"), empty)
    service = F.when(F.col("s.localEndpoint.serviceName").isNotNull(), F.create_map(F.lit("service.name"), value(F.col("s.localEndpoint.serviceName"))).cast(f"map<string,{ATTRIBUTE}>")).otherwise(empty)
    return s.select(
        F.lpad(F.lower("s.traceId"), 32, "0").alias("trace_id"), F.lower("s.id").alias("span_id"), F.lower("s.parentId").alias("parent_span_id"), F.col("s.name").alias("name"), F.coalesce(F.lower("s.kind"), F.lit("unspecified")).alias("kind"),
        F.when(F.map_contains_key(F.coalesce("s.tags", F.expr(EMPTY)), "error"), F.lit("error")).otherwise(F.lit("unset")).alias("status"), F.try_element_at("s.tags", F.lit("error")).alias("status_message"),
        (F.col("s.timestamp") * 1000).alias("start_ns"), ((F.col("s.timestamp") + F.coalesce("s.duration", F.lit(0))) * 1000).alias("end_ns"), tags.alias("span_attrs"), service.alias("resource_attrs"),
        F.lit(None).cast("string").alias("scope_name"), F.lit(None).cast("string").alias("scope_version"), empty.alias("scope_attrs"),
    )
