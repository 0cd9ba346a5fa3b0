"""Queries of the general training-data problems and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import dedupe, hierarchy, late, logparse, regrid
from skein.runtime import table, utc_micros

ORDER = [("assignment_generation", "desc"), ("received_at", "asc"), ("delivery_id", "asc")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.redelivered(table(spark, d, "write_batches"), ["namespace"], "request_id", ORDER, "delivery_id")


def p1_requests(spark: SparkSession, d: str) -> DataFrame:
    kept = dedupe.exactly_once(table(spark, d, "write_batches"), ["namespace"], "request_id", ORDER)
    return kept.groupBy("namespace").agg(F.count("*").alias("n_batches"), F.sum("n_samples").alias("n_samples"))


def _grid(spark: SparkSession, d: str, within_days: bool) -> DataFrame:
    readings = regrid.counted_samples(table(spark, d, "samples"), table(spark, d, "metric_series"))
    return regrid.regular_grid(readings, max_gap_ms=300_000, within_days=within_days)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return regrid.missing_periods(_grid(spark, d, within_days=True), within_days=True)


def _kinds(grid: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return grid.groupBy("series_id").agg(
        F.count("*").alias("periods"), n(F.col("observed")).alias("observed"), n(F.col("filled")).alias("filled"),
        n(~F.col("observed") & ~F.col("filled")).alias("marked"),
    )


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    """Of the periods within the days."""
    return _kinds(_grid(spark, d, within_days=True))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """The periods within the days that have a value, read or carried forward."""
    grid = _grid(spark, d, within_days=True)
    return grid.filter(F.col("observed") | F.col("filled")).select("series_id", "period_start_ms", "value", "filled")


def p2_series(spark: SparkSession, d: str) -> DataFrame:
    """Of every period from a series' first reading to its last."""
    return _kinds(_grid(spark, d, within_days=False))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return logparse.parse(table(spark, d, "log_entries")).select("entry_id", "last_entry_id", "event_ms", "level", "component")


def p3_messages(spark: SparkSession, d: str) -> DataFrame:
    return logparse.parse(table(spark, d, "log_entries")).select("entry_id", "message")


def p3_templates(spark: SparkSession, d: str) -> DataFrame:
    """template, entries, and how many of them state a level, a component: the leaves of the partitioning."""
    rows = logparse.parse(table(spark, d, "log_entries"))
    return rows.groupBy("template").agg(F.count("*").alias("entries"), F.sum(F.when(F.col("level") != "unknown", 1).otherwise(0)).alias("with_level"), F.count("component").alias("with_component"))


PERIOD_MS, CUTOFF_MS = 300_000, 1_800_000


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    samples = late.first_arrivals(
        table(spark, d, "samples").select(F.col("sample_id").alias("id"), "namespace", F.col("timestamp_ms").alias("event_ms"), F.col("value").alias("value"), "ingested_at"),
        ["id"], "ingested_at", ["namespace", "event_ms", "value"],
    ).withColumn("src", F.lit("sample"))
    logs = late.first_arrivals(
        table(spark, d, "log_entries").select(
            F.col("entry_id").alias("id"), "namespace", F.floor(F.col("timestamp_ns") / 1_000_000).cast("bigint").alias("event_ms"),
            F.octet_length("line").cast("double").alias("value"), "ingested_at",
        ),
        ["id"], "ingested_at", ["namespace", "event_ms", "value"],
    ).withColumn("src", F.lit("log"))
    return samples.unionByName(logs)


def _late_state(spark: SparkSession, d: str) -> DataFrame:
    rows = _arrivals(spark, d)
    return late.multiset(rows, ["src", "namespace"], F.col("event_ms"), utc_micros(F.col("ingested_at")) / F.lit(1000), F.col("value"), PERIOD_MS, CUTOFF_MS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = late.counts(_late_state(spark, d), ["src", "namespace"]).filter(F.col("late_arrivals") > 0)
    return found.drop("late_arrivals")


def p4_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Of both sources: values of samples, byte lengths of log lines."""
    return late.statistics(_late_state(spark, d), ["src", "namespace"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.resolve(hierarchy.span_links(table(spark, d, "spans")))
    return found.select(
        F.col("tree").alias("trace_id"), F.col("node").alias("span_id"), F.col("root").alias("root_span_id"), F.col("depth").cast("bigint").alias("depth"),
        F.col("n_descendants").cast("bigint").alias("n_descendants"),
    )


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """trace_id, span_id, path: the ids from the root to the span, null on or below a cycle."""
    found = hierarchy.resolve(hierarchy.span_links(table(spark, d, "spans")), with_path=True)
    return found.select(F.col("tree").alias("trace_id"), F.col("node").alias("span_id"), F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    """trace_id, span_id, descendant, distance: every pair of a span and a span below it."""
    found = hierarchy.descendants(hierarchy.resolve(hierarchy.span_links(table(spark, d, "spans")), with_path=True))
    return found.select(F.col("tree").alias("trace_id"), F.col("node").alias("span_id"), "descendant", F.col("distance").cast("bigint").alias("distance"))


QUERIES = {f.__name__: f for f in (p1_found, p1_requests, p2_found, p2_grid, p2_values, p2_series, p3_found, p3_messages, p3_templates, p4_found, p4_statistics, p5_found, p5_paths, p5_descendants)}

_P1 = """
WITH w AS (SELECT *, lower(regexp_replace(request_id, '^\\s+|\\s+$', '', 'g')) AS rid FROM write_batches),
r AS (SELECT *, row_number() OVER (PARTITION BY namespace, rid ORDER BY assignment_generation DESC NULLS LAST, received_at, delivery_id) AS k
      FROM w WHERE rid <> '')
"""
_P2 = """
WITH s AS (SELECT m.series_id, m.interval_ms, a.timestamp_ms - a.timestamp_ms % m.interval_ms AS p
  FROM (SELECT namespace, timestamp_ms, list_sort(list_filter(labels, lambda x: x.value <> '')) AS ls FROM samples
        WHERE value IS NOT NULL AND NOT isnan(value) AND NOT coalesce(stale, false)) a
  JOIN (SELECT series_id, interval_ms, namespace, list_sort(list_filter(labels, lambda x: x.value <> '')) AS ls FROM metric_series) m
  ON a.namespace = m.namespace AND a.ls = m.ls),
b AS (SELECT DISTINCT series_id, interval_ms, p, p // 86400000 AS day FROM s),
g AS (SELECT series_id, interval_ms, day, unnest(generate_series(lo, hi, interval_ms)) AS p
  FROM (SELECT series_id, interval_ms, day, min(p) AS lo, max(p) AS hi FROM b GROUP BY 1, 2, 3))
"""
_P4 = """
WITH r AS (
  SELECT 'sample' AS src, namespace, sample_id AS id, timestamp_ms AS ms, min(epoch_us(ingested_at)) AS us, min_by(value, ingested_at) AS value
  FROM samples WHERE ingested_at IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'log', namespace, entry_id, timestamp_ns // 1000000, min(epoch_us(ingested_at)), min_by(strlen(line), ingested_at)
  FROM log_entries WHERE ingested_at IS NOT NULL GROUP BY ALL),
k AS (SELECT *, ms - ms % 300000 AS p FROM r)
"""
_P5 = """
WITH RECURSIVE l AS (
  SELECT lower(trace_id) AS t, lower(span_id) AS s,
    min_by(coalesce(lower(list_filter(refs, lambda r: r.ref_type = 'CHILD_OF' AND lower(r.trace_id) = lower(trace_id))[1].span_id), ''), ingested_at) AS raw
  FROM spans GROUP BY 1, 2),
e AS (SELECT a.t, a.s, b.s AS parent FROM l a LEFT JOIN l b ON a.t = b.t AND a.raw = b.s),
up AS (SELECT t, s, s AS at, 0 AS depth FROM e WHERE parent IS NULL
  UNION ALL SELECT e.t, e.s, up.at, up.depth + 1 FROM up JOIN e ON e.t = up.t AND e.parent = up.s),
anc AS (SELECT e.t, e.s, e.parent AS a FROM e JOIN up ON e.t = up.t AND e.s = up.s WHERE e.parent IS NOT NULL
  UNION ALL SELECT anc.t, anc.s, e.parent FROM anc JOIN e ON e.t = anc.t AND e.s = anc.a WHERE e.parent IS NOT NULL)"""
ORACLES = {
    "p5_paths": _P5.replace("s AS at, 0 AS depth", "s AS at, 0 AS depth, s AS path").replace("up.depth + 1 FROM", "up.depth + 1, up.path || '/' || e.s FROM")
    + " SELECT e.t AS trace_id, e.s AS span_id, up.path FROM e LEFT JOIN up ON e.t = up.t AND e.s = up.s",
    "p5_descendants": _P5.replace("e.parent AS a FROM", "e.parent AS a, 1 AS far FROM").replace("anc.s, e.parent FROM", "anc.s, e.parent, anc.far + 1 FROM")
    + " SELECT t AS trace_id, a AS span_id, s AS descendant, far::BIGINT AS distance FROM anc",
    "p2_values": _P2 + """, v AS (SELECT m.series_id, a.timestamp_ms - a.timestamp_ms % m.interval_ms AS p, max((a.timestamp_ms, a.value)) AS newest
        FROM (SELECT namespace, timestamp_ms, value, list_sort(list_filter(labels, lambda x: x.value <> '')) AS ls FROM samples WHERE value IS NOT NULL AND NOT isnan(value) AND NOT coalesce(stale, false)) a
        JOIN (SELECT series_id, interval_ms, namespace, list_sort(list_filter(labels, lambda x: x.value <> '')) AS ls FROM metric_series) m ON a.namespace = m.namespace AND a.ls = m.ls GROUP BY ALL),
        o AS (SELECT g.series_id, g.p, b.p IS NOT NULL AS ok, max(b.p) OVER (PARTITION BY g.series_id, g.day ORDER BY g.p) AS seen FROM g LEFT JOIN b ON g.series_id = b.series_id AND g.p = b.p)
        SELECT o.series_id, o.p AS period_start_ms, v.newest[2] AS value, NOT ok AS filled FROM o JOIN v ON v.series_id = o.series_id AND v.p = o.seen WHERE ok OR o.p - seen <= 300000""",
    "p1_found": _P1 + "SELECT delivery_id FROM r WHERE k > 1",
    "p1_requests": _P1 + """, kept AS (SELECT namespace, n_samples FROM r WHERE k = 1
        UNION ALL SELECT namespace, n_samples FROM w WHERE rid IS NULL OR rid = '')
        SELECT namespace, count(*) AS n_batches, sum(n_samples)::BIGINT AS n_samples FROM kept GROUP BY 1""",
    "p2_found": _P2 + "SELECT series_id, p AS period_start_ms FROM g ANTI JOIN b USING (series_id, p)",
    "p2_grid": _P2 + """, o AS (SELECT g.*, b.p IS NOT NULL AS ok, max(b.p) OVER (PARTITION BY g.series_id, g.day ORDER BY g.p) AS seen
        FROM g LEFT JOIN b ON g.series_id = b.series_id AND g.p = b.p)
        SELECT series_id, count(*) AS periods, count(*) FILTER (ok) AS observed, count(*) FILTER (NOT ok AND p - seen <= 300000) AS filled,
        count(*) FILTER (NOT ok AND p - seen > 300000) AS marked FROM o GROUP BY 1""",
    "p2_series": _P2 + """, h AS (SELECT series_id, unnest(generate_series(min(p), max(p), interval_ms)) AS p FROM b GROUP BY series_id, interval_ms),
        o AS (SELECT h.*, b.p IS NOT NULL AS ok, max(b.p) OVER (PARTITION BY h.series_id ORDER BY h.p) AS seen
        FROM h LEFT JOIN b ON h.series_id = b.series_id AND h.p = b.p)
        SELECT series_id, count(*) AS periods, count(*) FILTER (ok) AS observed, count(*) FILTER (NOT ok AND p - seen <= 300000) AS filled,
        count(*) FILTER (NOT ok AND p - seen > 300000) AS marked FROM o GROUP BY 1""",
    "p4_found": _P4 + """SELECT src, namespace, p AS period_start_ms, count(*) FILTER (us < (p + 300000) * 1000) AS first_count,
        count(*) FILTER (us < (p + 2100000) * 1000) AS final_count, count(*) FILTER (us >= (p + 2100000) * 1000) AS dropped_count
        FROM k GROUP BY 1, 2, 3 HAVING count(*) FILTER (us >= (p + 300000) * 1000) > 0""",
    "p4_statistics": _P4 + """SELECT src, namespace, p AS period_start_ms, count(value) AS n, count(DISTINCT value) AS distinct_values,
        min(value)::DOUBLE AS minimum, max(value)::DOUBLE AS maximum, quantile_disc(value, 0.5)::DOUBLE AS median
        FROM k WHERE us < (p + 2100000) * 1000 AND value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2, 3""",
    "p5_found": """
WITH RECURSIVE l AS (
  SELECT lower(trace_id) AS t, lower(span_id) AS s,
    min_by(coalesce(lower(list_filter(refs, lambda r: r.ref_type = 'CHILD_OF' AND lower(r.trace_id) = lower(trace_id))[1].span_id), ''), ingested_at) AS raw
  FROM spans GROUP BY 1, 2),
e AS (SELECT a.t, a.s, b.s AS parent FROM l a LEFT JOIN l b ON a.t = b.t AND a.raw = b.s),
up AS (SELECT t, s, s AS at, 0 AS depth FROM e WHERE parent IS NULL
  UNION ALL SELECT e.t, e.s, up.at, up.depth + 1 FROM up JOIN e ON e.t = up.t AND e.parent = up.s),
anc AS (SELECT e.t, e.s, e.parent AS a FROM e JOIN up ON e.t = up.t AND e.s = up.s WHERE e.parent IS NOT NULL
  UNION ALL SELECT anc.t, anc.s, e.parent FROM anc JOIN e ON e.t = anc.t AND e.s = anc.a WHERE e.parent IS NOT NULL),
n AS (SELECT t, a AS s, count(*) AS c FROM anc GROUP BY 1, 2)
SELECT e.t AS trace_id, e.s AS span_id, coalesce(up.at, '') AS root_span_id, coalesce(up.depth, -1)::BIGINT AS depth,
  CASE WHEN up.t IS NULL THEN -1 ELSE coalesce(n.c, 0) END::BIGINT AS n_descendants
FROM e LEFT JOIN up ON e.t = up.t AND e.s = up.s LEFT JOIN n ON e.t = n.t AND e.s = n.s""",
}
