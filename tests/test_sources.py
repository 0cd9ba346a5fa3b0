import datetime as dt
import json
import struct
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skein.functions.levels import detected_level
from skein.labels import LABELS as labels_type
from skein.operators import late
from skein.sources import discovery, otlp, wire
from skein.streaming import ingest


def bodies(spark, *objects):
    return spark.createDataFrame([(o if isinstance(o, str) else json.dumps(o),) for o in objects], "value string")


def attrs(**kw):
    return [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in kw.items()]


def as_dict(r):
    return {x.name: x.value for x in r.labels}


def test_otlp_metrics(spark):
    p = {"attributes": attrs(code="200"), "timeUnixNano": "60000000000"}
    metrics = [
        {"name": "mem.use", "unit": "By", "gauge": {"dataPoints": [p | {"asInt": "7"}]}},
        {"name": "reqs", "unit": "1", "sum": {"aggregationTemporality": 2, "isMonotonic": True, "dataPoints": [p | {"asDouble": 3.0}]}},
        {"name": "gone", "sum": {"aggregationTemporality": 1, "dataPoints": [p | {"asDouble": 3.0}]}},
        {"name": "lat", "unit": "s", "histogram": {"aggregationTemporality": 2, "dataPoints": [p | {"count": "6", "sum": 9.5, "bucketCounts": ["1", "2", "3"], "explicitBounds": [0.5, 1]}]}},
        {"name": "exp", "exponentialHistogram": {"aggregationTemporality": 2, "dataPoints": [p | {"count": "3", "sum": 4.0, "scale": 1, "zeroCount": "0", "positive": {"offset": -1, "bucketCounts": ["1", "2"]}}]}},
        {"name": "sum.q", "summary": {"dataPoints": [p | {"count": "2", "sum": 5.0, "quantileValues": [{"quantile": 0.5, "value": 1.5}]}]}},
    ]
    body = {"resourceMetrics": [{"resource": {"attributes": attrs(service__name="api", service__instance__id="i1")}, "scopeMetrics": [{"metrics": metrics}]}]}
    rows = otlp.metrics(bodies(spark, body)).collect()
    got = {(as_dict(r)["__name__"], as_dict(r).get("le", as_dict(r).get("quantile"))): r.value for r in rows}
    assert got == {
        ("mem_use_bytes", None): 7.0, ("reqs_total", None): 3.0, ("lat_seconds_bucket", "0.5"): 1.0, ("lat_seconds_bucket", "1"): 3.0, ("lat_seconds_bucket", "+Inf"): 6.0, ("lat_seconds_sum", None): 9.5,
        ("lat_seconds_count", None): 6.0, ("exp", None): None, ("sum_q_sum", None): 5.0, ("sum_q_count", None): 2.0, ("sum_q", "0.5"): 1.5,
    }
    exp = next(r for r in rows if as_dict(r)["__name__"] == "exp")
    assert [(b["index"], b["count"]) for b in exp.hist.positive] == [(0, 1.0), (1, 2.0)] and as_dict(exp)["job"] == "api" and as_dict(exp)["instance"] == "i1" and exp.ts_ms == 60_000


def test_logs_and_bulk(spark):
    push = {"streams": [{"stream": {"app": "x", "e": ""}, "values": [["5", "level=warn msg", {"trace": "t"}], ["6", "plain"]]}]}
    got = otlp.loki_push(bodies(spark, push)).orderBy("ts_ns").collect()
    assert [(r.ts_ns, r.line, r.metadata, as_dict(r)) for r in got] == [(5, "level=warn msg", {"trace": "t", "detected_level": "warn"}, {"app": "x"}), (6, "plain", {"detected_level": "unknown"}, {"app": "x"})]
    record = {"timeUnixNano": "9", "severityText": "ERROR", "body": {"stringValue": "boom"}, "attributes": attrs(k="v")}
    body = {"resourceLogs": [{"resource": {"attributes": attrs(service__name="api")}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [record]}]}]}
    r = otlp.logs(bodies(spark, body)).collect()[0]
    assert r.line == "boom" and r.metadata == {"k": "v", "severity_text": "ERROR", "scope_name": "s", "detected_level": "error"} and as_dict(r) == {"service_name": "api"}
    lines = "\n".join(json.dumps(x) for x in ({"index": {}}, {"@timestamp": "1970-01-01T00:00:01Z", "message": "hi", "a": {"b": 1}, "app": "z"}, {"delete": {}}, {"update": {}}, {"x": 1}, {"create": {}}, {"message": "two"}))
    got = otlp.bulk(bodies(spark, lines), stream_fields=("app",)).orderBy("line").collect()
    assert [(r.line, r.ts_ns, as_dict(r), r.metadata.get("a_b")) for r in got] == [("hi", 1_000_000_000, {"app": "z"}, "1"), ("two", 0, {}, None)]


@pytest.mark.parametrize("line,want", [('{"level":"WARN"}', "warn"), ("lvl=err x", "error"), ("E0106 00:01:02.0 1 a.go:1] x", "error"), ("a CRITICAL b", "critical"), ("nothing", "unknown"), ("x" * 600 + " error", "unknown")])
def test_levels(spark, line, want):
    empty = F.expr("cast(map() as map<string,string>)")
    df = spark.createDataFrame([(line,)], "line string").select(detected_level(F.col("line"), empty, F.array().cast("array<struct<name:string,value:string>>")).alias("l"))
    assert df.collect()[0].l == want


def test_traces_and_zipkin(spark):
    span = {"traceId": "AB" * 16, "spanId": "CD" * 8, "parentSpanId": "", "name": "n", "kind": 2, "startTimeUnixNano": "10", "endTimeUnixNano": "30", "attributes": [{"key": "i", "value": {"intValue": "5"}}], "status": {"code": "STATUS_CODE_ERROR"}}
    body = {"resourceSpans": [{"resource": {"attributes": attrs(service__name="api")}, "scopeSpans": [{"scope": {"name": "lib"}, "spans": [span, span | {"traceId": "0" * 32}]}]}]}
    r = otlp.traces(bodies(spark, body)).collect()
    assert len(r) == 1 and (r[0].trace_id, r[0].parent_span_id, r[0].kind, r[0].status, r[0].span_attrs["i"].i, r[0].end_ns, r[0].scope_name) == ("ab" * 16, None, "server", "error", 5, 30, "lib")
    z = otlp.zipkin(bodies(spark, [{"traceId": "1F", "id": "2", "name": "z", "kind": "CLIENT", "timestamp": 5, "duration": 7, "localEndpoint": {"serviceName": "s"}, "tags": {"error": "bad"}}])).collect()[0]
    assert (z.trace_id, z.start_ns, z.end_ns, z.status, z.status_message, z.resource_attrs["service.name"].s) == ("0" * 30 + "1f", 5000, 12000, "error", "bad", "s")
    spans = otlp.traces(bodies(spark, body))
    assert discovery.trace_by_id(spans, "AB" * 16).count() == 1 and discovery.exact_search(spans, {"service.name": "api"}, 0, 10).count() == 1 and discovery.exact_search(spans, {"service.name": "no"}, 0, 10).count() == 0
    assert {(x.scope, x.name) for x in discovery.tag_names(spans, "resource").collect()} == {("resource", "service.name")} and discovery.tag_values(spans, "i").collect()[0].type == "int"


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(no, data):
    return _varint(no << 3 | 2) + _varint(len(data)) + data


def _snappy(data):
    return _varint(len(data)) + b"".join(bytes([(len(c) - 1) << 2]) + c for c in (data[i : i + 60] for i in range(0, len(data), 60)))


def test_remote_write(spark):
    label = lambda n, v: _field(1, _field(1, n) + _field(2, v))
    sample = lambda bits, ts: _field(2, b"\x09" + bits + _varint(2 << 3) + _varint(ts))
    hist = _field(4, _varint(1 << 3) + _varint(3) + b"\x19" + struct.pack("<d", 4.0) + _varint(4 << 3) + _varint(2) + _field(11, _varint(1 << 3) + _varint(2) + _varint(2 << 3) + _varint(2)) + _field(12, _varint(2) + _varint(2)) + _varint(15 << 3) + _varint(9))
    one = _field(1, label(b"x", b"1") + label(b"__name__", b"m") + sample(struct.pack("<d", 2.5), 7) + sample(struct.pack("<Q", wire.STALE_BITS), 8) + hist)
    symbols = _field(4, b"") + _field(4, b"__name__") + _field(4, b"n")
    two = symbols + _field(5, _field(1, _varint(1) + _varint(2)) + sample(struct.pack("<d", 1.0), 3))
    df = spark.createDataFrame([(bytearray(_snappy(one)),), (bytearray(_snappy(two)),)], "content binary")
    rows = sorted(wire.remote_write(df).collect(), key=lambda r: r.ts_ms)
    assert [(r.ts_ms, r.stale) for r in rows] == [(3, False), (7, False), (8, True), (9, False)] and as_dict(rows[1]) == {"__name__": "m", "x": "1"} and as_dict(rows[0]) == {"__name__": "n"}
    h = rows[3].hist
    assert (h.schema, h["count"], h["sum"], [(b["index"], b["count"]) for b in h.positive]) == (1, 3.0, 4.0, [(1, 1.0), (2, 2.0)])
    assert wire.unsnappy(_varint(10) + bytes([(4 - 1) << 2]) + b"abcd" + bytes([((6 - 4) << 2) | 1, 4])) == b"abcdabcdab"
    with pytest.raises(ValueError):
        wire.unsnappy(b"\x05\x00a")


@pytest.mark.parametrize("version", [1, 2])
def test_remote_write_of_many_rows(spark, version):
    """A row of 6 labels took 1.4 ms of a core to encode and decode."""
    name = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    labels = F.array(*[name(f"l{i}", F.col("id") % (7 + i)) for i in range(5)], name("long", F.repeat(F.lit("x"), 200)))
    rows = spark.range(0, 40_000, 1, 1).select(F.when(F.col("id") == 5, F.array().cast(labels_type)).otherwise(labels).alias("labels"), (F.col("id") - 1000).alias("timestamp_ms"), F.when(F.col("id") != 6, F.col("id") / 8).alias("value"))
    began = time.monotonic()
    got = wire.remote_write(wire.encoded(rows, version)).withColumnRenamed("ts_ms", "timestamp_ms").persist()
    assert got.count() == 40_000
    assert time.monotonic() - began < 20
    want = rows.withColumns({"labels": F.array_sort("labels"), "value": F.coalesce("value", F.lit(float("nan")))})
    assert want.exceptAll(got.select("labels", "timestamp_ms", "value")).count() == 0
    got.unpersist()


def test_remote_write_of_new_series(spark, monkeypatch):
    """Each row a series of its own: a label that many of them carry was decoded for each."""
    name = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"))
    shared = [name(f"l{i}", F.lit("é" * i)) for i in range(4)]  # l0 has no value, so it goes
    rows = spark.range(0, 25_000, 1, 1).select(F.array(name("pod", F.col("id")), *shared, name("a", F.col("id") % 9)).alias("labels"), F.col("id").alias("timestamp_ms"), (F.col("id") / 8).alias("value"))
    bodies = [r.content for r in wire.encoded(rows.limit(500)).collect()]
    decoded, message = [], wire.message
    monkeypatch.setattr(wire, "message", lambda data: decoded.append(data) or message(data))
    schema = to_arrow_schema(StructType.fromDDL(wire.SCHEMA))
    kept = wire.Rows(schema)
    for body in bodies:
        kept.add(wire.unsnappy(body))
    assert [[(x["name"], x["value"]) for x in r] for r in kept.batch()["labels"].to_pylist()[::499]] == [[("a", a), ("l1", "é"), ("l2", "éé"), ("l3", "ééé"), ("pod", pod)] for a, pod in (("0", "0"), ("4", "499"))]
    assert len(decoded) == 500 + 4 + 9
    monkeypatch.undo()
    got = wire.remote_write(wire.encoded(rows)).withColumnRenamed("ts_ms", "timestamp_ms")
    want = rows.withColumn("labels", F.array_sort(F.filter("labels", lambda x: x["value"] != "")))
    assert got.count() == 25_000 and want.exceptAll(got.select("labels", "timestamp_ms", "value")).count() == 0


def test_remote_write_keeps_nan(spark):
    """Both kinds of NaN are values, as in the samples view; they came out as null."""
    rows = spark.createDataFrame([([("a", "b")], i, v) for i, v in enumerate((float("nan"), 1.5, float("inf")))], f"labels {labels_type}, timestamp_ms long, value double")
    got = sorted((r.ts_ms, str(r.value), r.stale) for r in wire.remote_write(wire.encoded(rows)).collect())
    assert got == [(0, "nan", False), (1, "1.5", False), (2, "inf", False)]
    stale = _field(1, _field(2, b"\x09" + struct.pack("<Q", wire.STALE_BITS)))
    r = wire.remote_write(spark.createDataFrame([(bytearray(_snappy(stale)),)], "content binary")).collect()[0]
    assert (str(r.value), r.stale, r.labels, r.ts_ms) == ("nan", True, [], 0)


def test_remote_write_of_odd_bodies(spark):
    """References beyond 127, given apart or packed; series of both versions share the tables of one task; broken bodies."""
    symbols = [b"", *[b"s%d" % i for i in range(300)]]
    table = b"".join(_field(4, x) for x in symbols)
    apart = b"".join(_varint(1 << 3) + _varint(x) for x in (200, 2, 3, 299))
    packed = _field(1, b"".join(map(_varint, (200, 2)))) + _field(1, b"".join(map(_varint, (3, 299))))
    point = _field(2, b"\x09" + struct.pack("<d", 1.0) + _varint(2 << 3) + _varint((1 << 64) - 5))
    inline = _field(1, _field(1, _field(1, b"s2") + _field(2, b"s298")) + _field(1, _field(2, b"s1") + _field(1, b"s199")) + _field(1, _field(1, b"gone")) + point + point)
    bodies = [_snappy(x) for x in (table + _field(5, apart + point) + _field(5, packed + point), inline, _field(3, b""))]
    got = wire.remote_write(spark.createDataFrame([(bytearray(x),) for x in bodies], "content binary").coalesce(1)).collect()
    assert [(as_dict(r), r.ts_ms, r.value) for r in got] == [({"s199": "s1", "s2": "s298"}, -5, 1.0)] * 4
    for broken in (b"", b"\xff\xff\xff\xff\x0f\x00a", _snappy(_field(1, point)[:-3])):
        with pytest.raises((ValueError, IndexError)):
            list(wire.message(wire.unsnappy(broken)))


def test_discovery_and_encodings(spark):
    from promcase import load

    s = load(spark, "1m", 'm{job="a"} 1 2\nm{job="b"} 3 NaN\nn{x="1"} 5 6')
    assert discovery.series(s, ["m"]).count() == 2 and discovery.series(s, ["m", "n"], start=60_000).count() == 3
    assert {r.name for r in discovery.label_names(s, ["m"]).collect()} == {"__name__", "job"} and {r.value for r in discovery.label_values(s, "job").collect()} == {"a", "b"}
    assert {r.line for r in discovery.federate(spark, s, ["m", '{job="a"}'], 60_000).collect()} == {'m{job="a"} 2.0 60000', 'm{job="b"} NaN 60000'}
    from skein.plans.promql.compile import evaluate

    out = [json.loads(r.json) for r in discovery.prometheus_json(evaluate(spark, s, "n", 60_000)).collect()]
    assert out == [{"metric": {"__name__": "n", "x": "1"}, "value": ["60.0", "6"]}]
    out = [json.loads(r.json) for r in discovery.prometheus_json(evaluate(spark, s, "n", 0, 60_000, 60_000), True).collect()]
    assert out[0]["values"] == [["0.0", "5"], ["60.0", "6"]]


def test_streams(spark, tmp_path):
    t = dt.datetime(2025, 1, 6)
    schema = "id long, at timestamp, v double"
    rows = [(i % 30, t + dt.timedelta(seconds=i % 30), float(i % 3)) for i in range(60)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.deduplicated(ingest.read_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1), ["id"], "at")
    ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    ingest.compact(spark, str(tmp_path / "in"), str(tmp_path / "compact"), ["id"], "at", files=1)
    assert spark.read.parquet(str(tmp_path / "compact")).count() == 30
    state = ingest.LateState(spark, str(tmp_path / "state"), ["ns"])
    to_state = lambda df: late.multiset(df.withColumn("ns", F.lit("n")), ["ns"], F.unix_millis("at"), F.unix_millis("at"), F.col("v"), 10_000, 1000)
    query = state.start(ingest.read_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1), to_state, str(tmp_path / "cp2"))
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    total = late.counts(state.read(last), ["ns"]).agg(F.sum("final_count")).collect()[0][0]
    assert total == 60
    state.fold(to_state(spark.createDataFrame(rows[:5], schema)), last)  # a repeated batch replaces its version
    assert late.counts(state.read(last), ["ns"]).agg(F.sum("final_count")).collect()[0][0] < 60 + 5
    with pytest.raises(FileNotFoundError):
        state.fold(to_state(spark.createDataFrame(rows[:5], schema)), last + 2)  # a version is missing
    gone = state.expire(last, 0)
    assert gone >= 1 and late.counts(state.read(last), ["ns"]).count() > 0  # replaced days went, the state stays
    assert state.expire(last, 1 << 60) >= 1 and state.read(last) is None
    counts = ingest.windowed_counts(ingest.read_stream(spark, str(tmp_path / "in"), schema), "at", [], "10 seconds")
    q = counts.writeStream.format("memory").queryName("win").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select max(n) from win").collect()[0][0] == 20
