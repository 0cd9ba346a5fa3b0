"""Queries that cover the query languages, search and files over whole tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import labels as lab
from skein import model
from skein.plans import files as fs
from skein.plans.logql.compile import query_logs, query_metric
from skein.plans.promql.compile import evaluate
from skein.plans.search import rank
from skein.plans.traceql.compile import matched_spans, search
from skein.runtime import table
from skein.sources import discovery

DAY0, HOUR = 1_736_121_600_000, 3_600_000  # 2025-01-06 00:00 UTC
START, END, STEP = DAY0, DAY0 + 96 * HOUR, HOUR

NOT_A_NUMBER, INFINITE = -9e99, 9e98
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sample_view(spark: SparkSession, d: str) -> DataFrame:
    """All samples as one metric ``sample``; the original name is the label ``metric``."""
    return model.metric_samples(spark, d, as_metric="sample")


def flat(df: DataFrame, names: list[str]) -> DataFrame:
    """step, value and the named labels as columns, rounded beside the ties that sums leave open. NaN and infinite values
    are stood for by numbers (NOT_A_NUMBER, INFINITE), so that every engine compares them alike."""
    own, v = [lab.get(F.col("labels"), n).alias(n) for n in names], F.col("value")
    shown = F.when(F.isnan(v), F.lit(NOT_A_NUMBER)).when(F.abs(v) == float("inf"), F.signum(v) * INFINITE).otherwise(F.round(v + 2e-8, 6))
    return df.select(*own, "step", shown.alias("value"))


def every(df: DataFrame, names: list[str]) -> DataFrame:
    """step, value and the named labels as columns, with NaN and infinite values."""
    return df.select(*[lab.get(F.col("labels"), n).alias(n) for n in names], "step", "value")


SERIES = """
WITH s AS (SELECT namespace, list_sort(list_filter(labels, lambda x: x.value <> '')) AS ls, timestamp_ms AS ts,
  arg_max(coalesce(value, 'nan'::DOUBLE), sample_id) AS v, arg_max(coalesce(stale, false), sample_id) AS stale
  FROM samples WHERE value IS NOT NULL OR coalesce(stale, false) GROUP BY ALL),
q AS (SELECT *, list_filter(ls, lambda x: x.name = 'job')[1].value AS job, list_filter(ls, lambda x: x.name = '__name__')[1].value AS metric FROM s),
"""
GRID = f"g AS (SELECT unnest(generate_series({START}, {END}, {STEP})) AS t),"


def over(ms: int) -> str:
    return SERIES + GRID + f"""
w AS (SELECT namespace, ls, job, metric, t, ts, v, lag(v) OVER x AS pv, lag(ts) OVER x AS pts FROM q JOIN g ON ts > t - {ms} AND ts <= t WHERE NOT stale
  WINDOW x AS (PARTITION BY namespace, ls, t ORDER BY ts)),
"""


def prom(name: str, text: str, labels: list[str], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return flat(evaluate(spark, sample_view(spark, d), text, START, END, STEP), labels)

    QUERIES[name] = run
    ORACLES[name] = sql
    if "[30m]" in text:  # windows that leave no sample out, every result row kept; no SQL twin
        whole = text.replace("[30m]", "[1h]")
        QUERIES[f"{name}_1h"] = lambda spark, d: every(evaluate(spark, sample_view(spark, d), whole, START, END, STEP), labels)


FINITE = "true"
HALF = 1_800_000


SHOWN = f"CASE WHEN isnan(value) THEN {NOT_A_NUMBER} WHEN isinf(value) THEN sign(value) * {INFINITE} ELSE round(value + 2e-8, 6) END"


def by_job(inner: str, ms: int = HALF, op: str = "sum") -> str:
    """SQL of ``op by (job) (f(sample[..]))``; ``inner``: expression over the rows w of one series and step."""
    return over(ms) + f"""r AS (SELECT namespace, ls, job, t, {inner} AS x FROM w GROUP BY ALL),
z AS (SELECT job, t AS step, {op}(x) AS value FROM r WHERE x IS NOT NULL GROUP BY ALL)
SELECT job, step, {SHOWN} AS value FROM z WHERE {FINITE}"""


def rate_sql(counter: bool, per_second: bool) -> str:
    resets = "coalesce(sum(CASE WHEN v < pv AND NOT isnan(v) AND NOT isnan(pv) THEN pv END), 0)" if counter else "0"
    zero = "CASE WHEN ch > 0 AND v0 >= 0 AND sd * v0 / ch < st THEN sd * v0 / ch ELSE st END" if counter else "st"
    return over(HALF) + f"""a AS (SELECT namespace, ls, job, t, count(*) AS n, min(ts) AS t0, max(ts) AS t1, arg_min(v, ts) AS v0, arg_max(v, ts) - arg_min(v, ts) + {resets} AS ch
  FROM w GROUP BY ALL HAVING count(*) > 1),
b AS (SELECT *, (t1 - t0) / 1000 AS sd, (t1 - t0) / 1000 / (n - 1) AS av, (t0 - t + {HALF}) / 1000 AS s0, (t - t1) / 1000 AS e0 FROM a),
c AS (SELECT *, CASE WHEN s0 >= av * 1.1 THEN av / 2 ELSE s0 END AS st, CASE WHEN e0 >= av * 1.1 THEN av / 2 ELSE e0 END AS en FROM b),
z AS (SELECT job, t AS step, sum(ch * ((sd + ({zero}) + en) / sd){" / 1800" if per_second else ""}) AS value FROM c GROUP BY ALL)
SELECT job, step, {SHOWN} AS value FROM z WHERE {FINITE}"""


# Samples that are NaN or infinite make sums of their job NaN or infinite in either engine.
prom("promql_rate", "sum by (job) (rate(sample[30m]))", ["job"], rate_sql(True, True))
prom("promql_increase", "sum by (job) (increase(sample[30m]))", ["job"], rate_sql(True, False))
prom("promql_delta", "sum by (job) (delta(sample[30m]))", ["job"], rate_sql(False, False))
RANGE = {
    "sum_over_time": "sum(v)", "avg_over_time": "avg(v)", "count_over_time": "count(*)", "present_over_time": "1",
    "min_over_time": "coalesce(min(CASE WHEN NOT isnan(v) THEN v END), 'nan'::DOUBLE)", "max_over_time": "coalesce(max(CASE WHEN NOT isnan(v) THEN v END), 'nan'::DOUBLE)",
    "last_over_time": "arg_max(v, ts)", "resets": "sum(CASE WHEN v < pv AND NOT isnan(v) AND NOT isnan(pv) THEN 1 ELSE 0 END)",
    "changes": "sum(CASE WHEN pv IS NOT NULL AND v <> pv AND NOT (isnan(v) AND isnan(pv)) THEN 1 ELSE 0 END)",
    "idelta": "CASE WHEN count(*) > 1 THEN arg_max(v, ts) - arg_max(pv, ts) END",
    "irate": "CASE WHEN count(*) > 1 THEN (CASE WHEN arg_max(v, ts) < arg_max(pv, ts) AND NOT isnan(arg_max(v, ts)) THEN arg_max(v, ts) ELSE arg_max(v, ts) - arg_max(pv, ts) END) / ((max(ts) - arg_max(pts, ts)) / 1000) END",
}
for _f, _sql in RANGE.items():
    prom(f"promql_{_f}", f"sum by (job) ({_f}(sample[30m]))", ["job"], by_job(_sql))
prom("promql_stdvar_over_time", "max by (job) (stdvar_over_time(sample[30m]) / (avg_over_time(sample[30m]) ^ 2 + 1))", ["job"],
     over(HALF) + f"""r AS (SELECT job, t, CASE WHEN sum(CASE WHEN isfinite(v) THEN 0 ELSE 1 END) = 0 THEN var_pop(CASE WHEN isfinite(v) THEN v END) / (avg(CASE WHEN isfinite(v) THEN v END) ^ 2 + 1) ELSE 'nan'::DOUBLE END AS x
 FROM w GROUP BY namespace, ls, job, t),
z AS (SELECT job, t AS step, coalesce(max(CASE WHEN NOT isnan(x) THEN x END), 'nan'::DOUBLE) AS value FROM r GROUP BY ALL) SELECT job, step, {SHOWN} AS value FROM z WHERE {FINITE}""")
INSTANT = SERIES + GRID + """
i AS (SELECT namespace, ls, job, metric, t, arg_max(v, ts) AS v, arg_max(stale, ts) AS stale, max(ts) AS ts FROM q JOIN g ON ts > t - 300000 AND ts <= t GROUP BY ALL),
n AS (SELECT * EXCLUDE (stale) FROM i WHERE NOT stale),
"""


def instant(name: str, text: str, labels: list[str], value: str, group: str = "job", where: str = "true") -> None:
    cols = f"{group}, " if group else ""
    prom(name, text, labels, INSTANT + f"z AS (SELECT {cols}t AS step, {value} AS value FROM n WHERE {where} GROUP BY ALL) SELECT {cols}step, {SHOWN} AS value FROM z WHERE {FINITE}")


instant("promql_sum", "sum by (job) (sample)", ["job"], "sum(v)")
instant("promql_avg", "avg by (job) (sample)", ["job"], "avg(v)")
instant("promql_count", "count by (job) (sample)", ["job"], "count(*)")
instant("promql_group", "group by (metric) (sample)", ["metric"], "1", "metric")
instant("promql_min", "min by (job) (sample)", ["job"], "coalesce(min(CASE WHEN NOT isnan(v) THEN v END), 'nan'::DOUBLE)")
instant("promql_max", "max by (job) (sample)", ["job"], "coalesce(max(CASE WHEN NOT isnan(v) THEN v END), 'nan'::DOUBLE)")
instant("promql_quantile", "quantile by (namespace) (0.9, sample == sample)", ["namespace"], "quantile_cont(v, 0.9)", "namespace", "NOT isnan(v)")
instant("promql_comparison", "count by (job) (sample > 100)", ["job"], "count(*)", "job", "v > 100 AND NOT isnan(v)")
instant("promql_bool", "sum by (job) (sample >= bool 100)", ["job"], "sum(CASE WHEN v >= 100 AND NOT isnan(v) THEN 1 ELSE 0 END)")
instant("promql_arithmetic", "max by (job) ((sample - 1) * 2 / 4 + 3)", ["job"], "coalesce(max(CASE WHEN NOT isnan(v) THEN (v - 1) * 2 / 4 + 3 END), 'nan'::DOUBLE)")
instant("promql_math", "max by (job) (floor(sqrt(abs(sample))))", ["job"], "coalesce(max(CASE WHEN NOT isnan(v) THEN floor(sqrt(abs(v))) END), 'nan'::DOUBLE)")
instant("promql_clamp_round", "max by (job) (round(clamp(sample, 0, 50), 5))", ["job"], "coalesce(max(CASE WHEN NOT isnan(v) THEN floor(least(greatest(v, 0), 50) * 0.2 + 0.5) / 0.2 END), 'nan'::DOUBLE)")
instant("promql_timestamp", "max by (job) (timestamp(sample))", ["job"], "max(ts) / 1000")
instant("promql_calendar", "max by (job) (hour(timestamp(sample)) * 100 + minute(timestamp(sample)))", ["job"], "max(hour(make_timestamp(ts * 1000)) * 100 + minute(make_timestamp(ts * 1000)))")
instant("promql_without", "count(sum without (instance, pod, zone, code, Route, job) (sample)) by (namespace)", ["namespace"], "count(DISTINCT list_filter(ls, lambda x: x.name NOT IN ('instance', 'pod', 'zone', 'code', 'Route', 'job', '__name__')) || [{'name': 'metric', 'value': metric}])", "namespace")
prom("promql_label_replace", "count by (team) (label_replace(sample, 'team', '$1', 'namespace', '([a-z]+)-.*'))", ["team"], INSTANT + "z AS (SELECT regexp_extract(namespace, '^([a-z]+)-.*$', 1) AS team, t AS step, count(*)::DOUBLE AS value FROM n GROUP BY ALL) SELECT team, step, value FROM z")
prom("promql_offset", "sum by (job) (count_over_time(sample[30m] offset 1h))", ["job"], SERIES + GRID + "z AS (SELECT job, t AS step, count(*)::DOUBLE AS value FROM q JOIN g ON ts > t - 5400000 AND ts <= t - 3600000 WHERE NOT stale GROUP BY ALL) SELECT job, step, value FROM z")
prom("promql_at", f"sum by (job) (count_over_time(sample[1d] @ {END // 1000}))", ["job"], SERIES + GRID + f"c AS (SELECT job, count(*)::DOUBLE AS value FROM q WHERE NOT stale AND ts > {END - 86_400_000} AND ts <= {END} GROUP BY 1) SELECT job, t AS step, value FROM c CROSS JOIN g")
prom("promql_subquery", "max by (job) (max_over_time(count by (job) (sample)[6h:1h]))", ["job"], SERIES + f"""h AS (SELECT unnest(generate_series({START - 5 * HOUR}, {END}, {HOUR})) AS t),
i AS (SELECT job, ls, namespace, t, arg_max(stale, ts) AS stale FROM q JOIN h ON ts > t - 300000 AND ts <= t GROUP BY ALL), k AS (SELECT job, t, count(*) AS n FROM i WHERE NOT stale GROUP BY ALL),
{GRID} z AS (SELECT job, g.t AS step, max(n)::DOUBLE AS value FROM k JOIN g ON k.t > g.t - {6 * HOUR} AND k.t <= g.t GROUP BY ALL) SELECT job, step, value FROM z""")
prom("promql_topk", "topk by (namespace) (2, count by (namespace, job) (sample) * 1000 + count by (namespace, job) (count_over_time(sample[3d])))", ["namespace", "job"], INSTANT + """
l AS (SELECT namespace, job, t, count(DISTINCT ls) AS m FROM (SELECT namespace, job, ls, t FROM q JOIN g ON ts > t - 259200000 AND ts <= t WHERE NOT stale) GROUP BY ALL),
c AS (SELECT n.namespace, n.job, n.t, count(*) * 1000 + any_value(l.m) AS v FROM n JOIN l ON n.namespace = l.namespace AND n.job = l.job AND n.t = l.t GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY namespace, t ORDER BY v DESC, job) AS r FROM c)
SELECT namespace, job, t AS step, v::DOUBLE AS value FROM k WHERE r <= 2""")
prom("promql_matching", "sum by (namespace, job) (count_over_time(sample[30m])) / on (namespace) group_left () sum by (namespace) (count_over_time(sample[30m]))", ["namespace", "job"], over(HALF) + """
a AS (SELECT namespace, job, t, count(*) AS n FROM w GROUP BY ALL), b AS (SELECT namespace, t, count(*) AS n FROM w GROUP BY ALL)
SELECT a.namespace, a.job, a.t AS step, round(a.n / b.n + 2e-8, 6) AS value FROM a JOIN b ON a.namespace = b.namespace AND a.t = b.t""")
PRESENT = INSTANT + "a AS (SELECT DISTINCT job, t FROM n WHERE v > 100 AND NOT isnan(v)), b AS (SELECT job, t, count(*)::DOUBLE AS value FROM n GROUP BY ALL) SELECT job, t AS step, value FROM b "
prom("promql_and", "count by (job) (sample) and on (job) (sample > 100)", ["job"], PRESENT + "SEMI JOIN a USING (job, t)")
prom("promql_unless", "count by (job) (sample) unless on (job) (sample > 100)", ["job"], PRESENT + "ANTI JOIN a USING (job, t)")
prom("promql_or", "count by (job) (sample > 100) or count by (job) (sample)", ["job"], INSTANT + "a AS (SELECT job, t, count(*) FILTER (v > 100 AND NOT isnan(v)) AS x, count(*) AS y FROM n GROUP BY ALL) SELECT job, t AS step, (CASE WHEN x > 0 THEN x ELSE y END)::DOUBLE AS value FROM a")
prom("promql_absent", "absent(sample{job=~'amber.*'} > 1000)", [], INSTANT + "a AS (SELECT DISTINCT t FROM n WHERE job LIKE 'amber%' AND v > 1000 AND NOT isnan(v)) SELECT t AS step, 1.0::DOUBLE AS value FROM g ANTI JOIN a USING (t)")
prom("promql_scalar_time", "vector(scalar(count(sample)) + time())", [], INSTANT + "c AS (SELECT t, count(*) AS k FROM n GROUP BY 1) SELECT t AS step, coalesce(round(k + t / 1000 + 2e-8, 6), " + str(NOT_A_NUMBER) + ") AS value FROM g LEFT JOIN c USING (t)")
prom("promql_deriv", "count by (job) (deriv(sample[30m]) > 0)", ["job"], over(HALF) + """r AS (SELECT job, regr_slope(v, (ts - t) / 1000) AS x, min(v) AS lo, max(v) AS hi, t FROM w GROUP BY namespace, ls, job, t HAVING count(*) > 1 AND bool_and(isfinite(v)))
SELECT job, t AS step, count(*)::DOUBLE AS value FROM r WHERE x > 0 AND lo <> hi GROUP BY ALL""")


def promql_count_values(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate(spark, sample_view(spark, d), "count_values by (job) ('v', floor(sample / 100))", START, END, STEP)
    return out.select(lab.get(F.col("labels"), "job").alias("job"), lab.get(F.col("labels"), "v").alias("v"), "step", "value")


QUERIES["promql_count_values"] = promql_count_values
ORACLES["promql_count_values"] = INSTANT + """f AS (SELECT job, t, CASE WHEN isnan(v) THEN 'NaN' WHEN v = 'inf'::DOUBLE THEN '+Inf' WHEN v = '-inf'::DOUBLE THEN '-Inf' WHEN abs(v) < 1e18 THEN CASE WHEN floor(v / 100) = 0 THEN '0' ELSE floor(v / 100)::HUGEINT::VARCHAR END END AS x FROM n)
SELECT job, x AS v, t AS step, count(*)::DOUBLE AS value FROM f GROUP BY ALL"""

LE = ["0.001", "0.01", "0.1", "1", "10"]


def latency_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative counts of span durations per service, as classic bucket series at one time."""
    rows = table(spark, d, "spans").filter(F.col("duration").isNotNull() & F.col("service_name").isNotNull())
    sums = [F.sum(F.when(F.col("duration") <= float(x) * 1e9, 1.0).otherwise(0.0)).alias(x) for x in LE]
    wide = rows.groupBy("service_name").agg(*sums, F.count("*").cast("double").alias("+Inf"))
    pairs = F.explode(F.create_map(*[c for x in [*LE, "+Inf"] for c in (F.lit(x), F.col(f"`{x}`"))])).alias("le", "value")
    own = lab.canonical(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("__name__", F.lit("latency_bucket")), ("le", F.col("le")), ("service", F.col("service_name")))]))
    return wide.select("service_name", pairs).select(own.alias("labels"), F.lit(START).cast("bigint").alias("ts_ms"), "value", F.lit(False).alias("stale"))


def promql_histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    return flat(evaluate(spark, latency_buckets(spark, d), "histogram_quantile(0.5, latency_bucket)", START), ["service"])


QUERIES["promql_histogram_quantile"] = promql_histogram_quantile
ORACLES["promql_histogram_quantile"] = f"""
WITH b AS (SELECT service_name AS service, unnest([0.001, 0.01, 0.1, 1, 10]::DOUBLE[]) AS le FROM (SELECT DISTINCT service_name FROM spans WHERE service_name IS NOT NULL AND duration IS NOT NULL)),
c AS (SELECT service, le, (SELECT count(*) FROM spans s WHERE s.service_name = service AND duration <= le * 1e9)::DOUBLE AS n, (SELECT count(*) FROM spans s WHERE s.service_name = service AND duration IS NOT NULL) AS total FROM b),
p AS (SELECT *, lag(le, 1, 0) OVER w AS low, lag(n, 1, 0) OVER w AS before FROM c WINDOW w AS (PARTITION BY service ORDER BY le)),
f AS (SELECT service, min_by(low + (le - low) * (total * 0.5 - before) / (n - before), le) AS value FROM p WHERE n >= total * 0.5 GROUP BY 1)
SELECT service, {START}::BIGINT AS step, round(coalesce(f.value, 10) + 2e-8, 6) AS value FROM (SELECT DISTINCT service FROM c) LEFT JOIN f USING (service)"""


def native(name: str, text: str, value: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = model.native_histograms(spark, d)
        named = rows.withColumn("labels", lab.put(lab.put(F.col("labels"), "metric", lab.get(F.col("labels"), "__name__")), "__name__", F.lit("h")))
        return flat(evaluate(spark, named, text, START, END, STEP), ["namespace"])

    QUERIES[name] = run
    ORACLES[name] = f"""WITH s AS (SELECT namespace, list_sort(list_filter(labels, lambda x: x.value <> '')) AS ls, timestamp_ms AS ts, arg_max(hist_count, hist_id) AS c, arg_max(coalesce(hist_sum, 'nan'::DOUBLE), hist_id) AS total
  FROM histograms WHERE hist_count IS NOT NULL GROUP BY ALL), {GRID}
n AS (SELECT namespace, ls, t, arg_max(c, ts) AS c, arg_max(total, ts) AS total FROM s JOIN g ON ts > t - 300000 AND ts <= t GROUP BY ALL),
z AS (SELECT namespace, t AS step, {value} AS value FROM n GROUP BY ALL) SELECT namespace, step, {SHOWN} AS value FROM z WHERE {FINITE}"""


native("promql_native_count", "sum by (namespace) (histogram_count(h))", "sum(c)")
native("promql_native_sum", "sum by (namespace) (histogram_sum(h))", "sum(total)")
native("promql_native_aggregate", "histogram_count(sum by (namespace) (h))", "sum(c)")


# --- logs -----------------------------------------------------------------------------------------------------------

LOGS = f"""
WITH e AS (SELECT entry_id, any_value(namespace) AS namespace, any_value(list_filter(labels, lambda x: x.name = 'app')[1].value) AS app, any_value(timestamp_ns) AS ns, any_value(line) AS line,
  any_value(structured_metadata) AS meta FROM log_entries WHERE line IS NOT NULL AND timestamp_ns IS NOT NULL GROUP BY 1), {GRID}
w AS (SELECT e.*, t FROM e JOIN g ON ns > (t - 3600000) * 1000000 AND ns <= t * 1000000)
"""


def logql(name: str, text: str, labels: list[str], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return flat(query_metric(spark, model.log_entries(spark, d), text, START, END, STEP), labels)

    QUERIES[name] = run
    ORACLES[name] = LOGS + sql


ALL = '{namespace=~".+"}'
logql("logql_count_over_time", f"sum by (namespace) (count_over_time({ALL}[1h]))", ["namespace"], "SELECT namespace, t AS step, count(*)::DOUBLE AS value FROM w GROUP BY ALL")
logql("logql_rate", f"sum by (app) (rate({ALL}[1h]))", ["app"], "SELECT app, t AS step, round(count(*) / 3600 + 2e-8, 6) AS value FROM w GROUP BY ALL")
logql("logql_bytes_over_time", f"sum by (app) (bytes_over_time({ALL}[1h]))", ["app"], "SELECT app, t AS step, sum(strlen(line))::DOUBLE AS value FROM w GROUP BY ALL")
logql("logql_line_contains", f'sum by (app) (count_over_time({ALL} |= "lease" != "peer" [1h]))', ["app"], "SELECT app, t AS step, count(*)::DOUBLE AS value FROM w WHERE contains(line, 'lease') AND NOT contains(line, 'peer') GROUP BY ALL")
logql("logql_line_regex", f'sum by (app) (count_over_time({ALL} |~ "took=[0-9]+ms" !~ "rows=9" [1h]))', ["app"], "SELECT app, t AS step, count(*)::DOUBLE AS value FROM w WHERE regexp_matches(line, 'took=[0-9]+ms') AND NOT regexp_matches(line, 'rows=9') GROUP BY ALL")
logql("logql_matchers", '{app=~"amber.*|birch.*", namespace!~"prod-.*"} |= "" '.join(["sum by (app) (count_over_time(", "[1h]))"]), ["app"], "SELECT app, t AS step, count(*)::DOUBLE AS value FROM w WHERE regexp_matches(app, '^(amber.*|birch.*)$') AND NOT regexp_matches(namespace, '^prod-') GROUP BY ALL")
logql("logql_regexp_unwrap", f'max by (app) (max_over_time({ALL} | regexp "took=(?P<took>[0-9]+)ms" | unwrap took [1h]))', ["app"], "SELECT app, t AS step, max(regexp_extract(line, 'took=([0-9]+)ms', 1)::DOUBLE) AS value FROM w WHERE regexp_matches(line, 'took=[0-9]+ms') GROUP BY ALL")
logql("logql_label_filter", f'sum by (kind) (count_over_time({ALL} | regexp "shard (?P<part>[0-9]+) (?P<kind>[a-z]+)" | part >= 500 | drop part [1h]))', ["kind"], "SELECT regexp_extract(line, 'shard ([0-9]+) ([a-z]+)', 2) AS kind, t AS step, count(*)::DOUBLE AS value FROM w WHERE regexp_extract(line, 'shard ([0-9]+) ([a-z]+)', 1) <> '' AND try_cast(regexp_extract(line, 'shard ([0-9]+) ([a-z]+)', 1) AS INT) >= 500 GROUP BY ALL")
logql("logql_topk", f"topk(3, sum by (app) (count_over_time({ALL}[1h])))", ["app"], "SELECT app, step, value FROM (SELECT app, t AS step, count(*)::DOUBLE AS value, row_number() OVER (PARTITION BY t ORDER BY count(*) DESC, app) AS r FROM w GROUP BY app, t) WHERE r <= 3")
logql("logql_ratio", f'sum by (app) (count_over_time({ALL} |= "retry" [1h])) / sum by (app) (count_over_time({ALL}[1h]))', ["app"], "SELECT app, t AS step, round(count(*) FILTER (contains(line, 'retry')) / count(*) + 2e-8, 6) AS value FROM w GROUP BY ALL HAVING count(*) FILTER (contains(line, 'retry')) > 0")
logql("logql_distinct", f"approx_count_distinct(pod, {ALL}[1h]) by (namespace)", ["namespace"], "SELECT namespace, t AS step, count(DISTINCT pod)::DOUBLE AS value FROM (SELECT w.*, p.pod FROM w JOIN (SELECT entry_id, any_value(list_filter(labels, lambda x: x.name = 'pod' AND x.value <> '')[1].value) AS pod FROM log_entries GROUP BY 1) p USING (entry_id)) WHERE pod IS NOT NULL GROUP BY ALL")


def logql_entries(spark: SparkSession, d: str) -> DataFrame:
    out = query_logs(spark, model.log_entries(spark, d), ALL + ' |= "lease" | decolorize', START * 10**6, END * 10**6, 100)
    return out.select("ts_ns", "line")


QUERIES["logql_entries"] = logql_entries
ORACLES["logql_entries"] = LOGS + f""", u AS (SELECT ns, line, min(entry_id) AS id FROM (SELECT e.*, l.ls FROM e JOIN (SELECT entry_id, any_value(list_sort(list_filter(labels, lambda x: x.value <> ''))) AS ls FROM log_entries GROUP BY 1) l USING (entry_id))
  WHERE contains(line, 'lease') AND ns >= {START} * 1000000 AND ns < {END} * 1000000 GROUP BY namespace, ls, ns, line, meta)
SELECT ns AS ts_ns, regexp_replace(line, '\\x1b\\[[0-9;:?]*[A-Za-z]', '', 'g') AS line FROM (SELECT * FROM u ORDER BY ns DESC, id DESC LIMIT 100)"""


# --- traces ---------------------------------------------------------------------------------------------------------

SPANS = """
WITH s AS (SELECT lower(trace_id) AS t, lower(span_id) AS s, arg_min(struct_pack(p := coalesce(lower(list_filter(refs, lambda r: r.ref_type = 'CHILD_OF' AND lower(r.trace_id) = lower(trace_id))[1].span_id), ''),
    name := operation_name, kind := lower(span_kind), status := lower(status_code), start := epoch_us(start_time) * 1000, dur := coalesce(duration, 0), service := service_name, tags := tags), ingested_at) AS b
  FROM spans WHERE start_time IS NOT NULL GROUP BY ALL),
x AS (SELECT t, s, b.p AS p, b.name AS name, b.kind AS kind, b.status AS status, b.start AS start, b.dur AS dur, b.service AS service, b.tags AS tags FROM s)
"""


def traceql(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return matched_spans(model.spans(spark, d), text).select("trace_id", "span_id")

    QUERIES[name] = run
    ORACLES[name] = SPANS + sql


WHERE = "SELECT t AS trace_id, s AS span_id FROM x WHERE "
PAIR = "SELECT DISTINCT b.t AS trace_id, b.s AS span_id FROM x a JOIN x b ON a.t = b.t "
traceql("traceql_filter", "{ status = error && duration > 50ms }", WHERE + "status = 'error' AND dur > 50000000")
traceql("traceql_attribute", '{ .http.method = "POST" || resource.service.name =~ "^amber" }', WHERE + "coalesce(tags['http.method'] = 'POST', false) OR coalesce(regexp_matches(service, '^amber'), false)")
traceql("traceql_nil", "{ .http.method = nil && kind != server }", WHERE + "tags['http.method'] IS NULL AND coalesce(kind <> 'server', false)")
traceql("traceql_child", '{ kind = server } > { name = "merge" }', PAIR + "AND b.p = a.s WHERE a.kind = 'server' AND b.name = 'merge'")
traceql("traceql_parent", '{ name = "merge" } < { kind = server }', PAIR + "AND a.p = b.s AND a.p <> '' WHERE a.name = 'merge' AND b.kind = 'server'")
traceql("traceql_sibling", "{ status = error } ~ { kind = client }", PAIR + "AND a.p = b.p AND a.p <> '' AND a.s <> b.s WHERE a.status = 'error' AND b.kind = 'client'")
traceql("traceql_not_child", "{ kind = server } !> { status = error }", "SELECT t AS trace_id, s AS span_id FROM x WHERE status = 'error' AND NOT EXISTS (SELECT 1 FROM x a WHERE a.t = x.t AND a.s = x.p AND a.kind = 'server')")
traceql("traceql_union_child", "{ kind = server } &> { status = error }", ", r AS (" + PAIR + "AND b.p = a.s WHERE a.kind = 'server' AND b.status = 'error') SELECT * FROM r UNION SELECT DISTINCT a.t, a.s FROM x a JOIN x b ON a.t = b.t AND b.p = a.s WHERE a.kind = 'server' AND b.status = 'error'")
QUERIES["traceql_descendant"] = lambda spark, d: matched_spans(model.spans(spark, d), '{ name = "query" } >> { status = error }').select("trace_id", "span_id")
ORACLES["traceql_descendant"] = SPANS.replace("WITH s AS", "WITH RECURSIVE s AS") + ", d AS (SELECT t, s AS low FROM (SELECT b.t, b.s FROM x a JOIN x b ON b.t = a.t AND b.p = a.s WHERE a.name = 'query') UNION SELECT d.t, x.s FROM d JOIN x ON x.t = d.t AND x.p = d.low) SELECT t AS trace_id, s AS span_id FROM x WHERE status = 'error' AND (t, s) IN (SELECT t, low FROM d)"
QUERIES["traceql_ancestor"] = lambda spark, d: matched_spans(model.spans(spark, d), "{ status = error } << { kind = server }").select("trace_id", "span_id")
ORACLES["traceql_ancestor"] = SPANS.replace("WITH s AS", "WITH RECURSIVE s AS") + ", u AS (SELECT t, p AS up FROM x WHERE status = 'error' UNION SELECT u.t, x.p FROM u JOIN x ON x.t = u.t AND x.s = u.up) SELECT t AS trace_id, s AS span_id FROM x WHERE kind = 'server' AND (t, s) IN (SELECT t, up FROM u)"
traceql("traceql_and", '{ status = error } && { name = "merge" }', ", k AS (SELECT t FROM x GROUP BY t HAVING bool_or(coalesce(status = 'error', false)) AND bool_or(coalesce(name = 'merge', false))) SELECT t AS trace_id, s AS span_id FROM x WHERE t IN (SELECT t FROM k) AND (status = 'error' OR name = 'merge')")
traceql("traceql_count", "{ kind = server } | count() > 3", ", k AS (SELECT t FROM x WHERE kind = 'server' GROUP BY t HAVING count(*) > 3) " + WHERE + "kind = 'server' AND t IN (SELECT t FROM k)")
traceql("traceql_by_avg", "{} | by(resource.service.name) | avg(duration) > 100ms", ", k AS (SELECT t, service FROM x GROUP BY ALL HAVING avg(dur) > 100000000) SELECT x.t AS trace_id, x.s AS span_id FROM x JOIN k ON x.t = k.t AND x.service IS NOT DISTINCT FROM k.service")
traceql("traceql_trace_duration", "{ traceDuration > 1s && childCount = 0 }", ", k AS (SELECT t FROM x GROUP BY t HAVING max(start + dur) - min(start) > 1000000000) SELECT t AS trace_id, s AS span_id FROM x WHERE t IN (SELECT t FROM k) AND NOT EXISTS (SELECT 1 FROM x c WHERE c.t = x.t AND c.p = x.s)")


def traceql_search(spark: SparkSession, d: str) -> DataFrame:
    return search(model.spans(spark, d), "{ status = error }", 50).select("trace_id", "start_ns", "duration_ns", "matched")


QUERIES["traceql_search"] = traceql_search
ORACLES["traceql_search"] = SPANS + "SELECT t AS trace_id, min(start) AS start_ns, max(start + dur) - min(start) AS duration_ns, count(*) FILTER (status = 'error') AS matched FROM x GROUP BY t HAVING count(*) FILTER (status = 'error') > 0 ORDER BY start_ns, t LIMIT 50"


# --- search ---------------------------------------------------------------------------------------------------------


def vector_rows(spark: SparkSession, d: str) -> DataFrame:
    return rank.latest(table(spark, d, "vectors"))


VECTORS = "WITH l AS (SELECT id, arg_max(struct_pack(d := coalesce(deleted, false), vector := vector, category := category, price := price, tags := tags), seq) AS b FROM vectors GROUP BY 1), v AS (SELECT id, b.vector AS vector, b.category AS category, b.price AS price, b.tags AS tags FROM l WHERE NOT b.d) "


def embedding_rows(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    rows = table(spark, d, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), F.col("embedding").alias("vector"), "label")
    return rows, list(rows.orderBy("id").limit(1).collect()[0].vector)  # one row


def _knn(metric: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows, query = embedding_rows(spark, d)
        return rank.knn(rows, query, 20, metric).select("id", F.round("`$dist`", 6).alias("dist"))

    return run


def _knn_sql(dist: str) -> str:
    return f"WITH e AS (SELECT lpad(vec_id::VARCHAR, 12, '0') AS id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT v AS q FROM e ORDER BY id LIMIT 1) SELECT id, round(dist, 6) AS dist FROM (SELECT id, {dist} AS dist FROM e, q ORDER BY dist, id LIMIT 20)"


for _m, _d in (("cosine", "1 - list_cosine_similarity(v, q)"), ("l2", "list_distance(v, q) ^ 2"), ("dot", "-list_dot_product(v, q)")):
    QUERIES[f"search_knn_{_m}"] = _knn(_m)
    ORACLES[f"search_knn_{_m}"] = _knn_sql(_d)


def filtered(name: str, where, sql: str) -> None:
    QUERIES[name] = lambda spark, d: rank.count(vector_rows(spark, d), where)
    ORACLES[name] = VECTORS + f"SELECT count(*) AS count FROM v WHERE {sql}"


filtered("search_filter_compare", ["And", [["price", "Gte", 1000], ["price", "Lt", 4000], ["Not", ["category", "Eq", "alert"]]]], "coalesce(price >= 1000 AND price < 4000, false) AND NOT coalesce(category = 'alert', false)")
filtered("search_filter_sets", ["Or", [["category", "In", ["alert", "runbook"]], ["tags", "ContainsAny", ["flintgate", "duskgate"]]]], "coalesce(category IN ('alert', 'runbook'), false) OR coalesce(list_has_any(tags, ['flintgate', 'duskgate']), false)")
filtered("search_filter_globs", ["And", [["category", "Glob", "*-[a-n]*"], ["category", "NotIGlob", "SCH*"], ["tags", "Glob", "amber*"]]], "coalesce(regexp_matches(category, '^.*-[a-n].*$'), false) AND NOT coalesce(category ILIKE 'sch%', false) AND len(list_filter(tags, lambda x: x LIKE 'amber%')) > 0")
filtered("search_filter_exists", ["And", [["category", "NotExists"], ["price", "NotEq", 7], ["tags", "NotContains", "x"]]], "category IS NULL AND coalesce(price <> 7, true) AND NOT coalesce(list_contains(tags, 'x'), false)")
QUERIES["search_order"] = lambda spark, d: rank.order_by(vector_rows(spark, d), "price", True, 50).select("id", "price")
ORACLES["search_order"] = VECTORS + "SELECT id, price FROM v ORDER BY price DESC NULLS LAST, id LIMIT 50"
QUERIES["search_order_array"] = lambda spark, d: rank.order_by(vector_rows(spark, d), "tags", False, 50).select("id")
ORACLES["search_order_array"] = VECTORS + "SELECT id FROM v ORDER BY list_min(tags) NULLS LAST, id LIMIT 50"
QUERIES["search_collapse"] = lambda spark, d: rank.collapse(vector_rows(spark, d).filter(F.col("price").isNotNull()), [F.col("price"), F.col("id")], ["category"], 3, 100).select("id", "category")
ORACLES["search_collapse"] = VECTORS + "SELECT id, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY price, id) AS r FROM v WHERE price IS NOT NULL) WHERE r <= 3 ORDER BY price, id LIMIT 100"


def search_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = vector_rows(spark, d).filter(F.col("price").isNotNull())
    a, b = rank.order_by(rows, "price", False, 100), rank.order_by(rows, "price", True, 1000)
    return rank.fuse([(a, [F.col("price"), F.col("id")]), (b, [F.col("price").desc(), F.col("id")])], limit=30).select("id", F.round("`$score`", 9).alias("score"))


QUERIES["search_fusion"] = search_fusion
ORACLES["search_fusion"] = VECTORS + """, p AS (SELECT * FROM v WHERE price IS NOT NULL), a AS (SELECT id, row_number() OVER (ORDER BY price, id) AS r FROM p QUALIFY r <= 100), b AS (SELECT id, row_number() OVER (ORDER BY price DESC, id) AS r FROM p QUALIFY r <= 1000)
SELECT id, round(sum(1 / (60 + r)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY sum(1 / (60 + r)) DESC, id LIMIT 30"""


def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return rank.bm25(rows, "segment flusher lease", 50).select("id", F.round("`$score`", 5).alias("score"))


QUERIES["search_bm25"] = search_bm25


def search_centroids(spark: SparkSession, d: str) -> DataFrame:
    rows, query = embedding_rows(spark, d)
    return rank.Centroids(rows, 16).search(query, 20).select("id", F.round("`$dist`", 6).alias("dist"))


QUERIES["search_centroids"] = search_centroids


# --- files and discovery --------------------------------------------------------------------------------------------


def document_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter(F.col("text").isNotNull())
    path = F.concat(F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return rows.select(F.lit("t").alias("tenant"), path.alias("path"), F.lit("file").alias("kind"), F.octet_length("text").cast("bigint").alias("size"), F.encode("text", "UTF-8").alias("content"))


FILES = "WITH f AS (SELECT '/' || coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, text, strlen(text) AS size FROM documents WHERE text IS NOT NULL) "
QUERIES["files_glob"] = lambda spark, d: fs.glob(document_files(spark, d), "/{en,de}/wiki/amber*/*[05].txt", None).select("path", "size")
ORACLES["files_glob"] = FILES + "SELECT path, size FROM f WHERE regexp_matches(path, '^/(en|de)/wiki/amber[^/]*/[^/]*[05]\\.txt$')"
QUERIES["files_grep"] = lambda spark, d: fs.grep(document_files(spark, d), "without warning", fixed=True, limit=None).select("path", "line_number", "line")
ORACLES["files_grep"] = FILES + """, l AS (SELECT path, unnest(regexp_split_to_array(regexp_replace(text, '\\n$', ''), '\\r?\\n')) AS line, generate_subscripts(regexp_split_to_array(regexp_replace(text, '\\n$', ''), '\\r?\\n'), 1) AS line_number FROM f WHERE NOT contains(text, chr(0)))
SELECT path, line_number, line FROM l WHERE contains(line, 'without warning')"""
QUERIES["discovery_label_values"] = lambda spark, d: discovery.label_values(model.metric_samples(spark, d), "job", ['{__name__=~"tel_.*"}'])
ORACLES["discovery_label_values"] = SERIES.rstrip().rstrip(",") + " SELECT DISTINCT job AS value FROM q WHERE job IS NOT NULL AND metric LIKE 'tel_%'"
QUERIES["discovery_label_names"] = lambda spark, d: discovery.label_names(model.metric_samples(spark, d))
ORACLES["discovery_label_names"] = SERIES.rstrip().rstrip(",") + " SELECT DISTINCT name FROM (SELECT unnest(list_transform(ls, lambda x: x.name)) AS name FROM q UNION ALL SELECT 'namespace')"
QUERIES["discovery_metadata"] = lambda spark, d: discovery.metric_metadata(table(spark, d, "metric_series"))
ORACLES["discovery_metadata"] = "SELECT metric_name, arg_max(metric_type, series_id) AS metric_type, arg_max(coalesce(unit, ''), series_id) AS unit FROM metric_series GROUP BY 1"
QUERIES["discovery_tag_names"] = lambda spark, d: discovery.tag_names(model.spans(spark, d), "span")
ORACLES["discovery_tag_names"] = SPANS + "SELECT DISTINCT 'span' AS scope, unnest(map_keys(tags)) AS name FROM x WHERE tags IS NOT NULL"


# --- further functions, one query each ---------------------------------------------------------------------------------

NUMBER = "NOT isnan(v)"
UNIT_RANGE = {
    "abs": "abs(X)", "ceil": "ceil(X)", "floor": "floor(X)", "exp": "exp(X)", "sqrt": "sqrt(X)", "sin": "sin(X)", "cos": "cos(X)", "tan": "tan(X)", "asin": "asin(X)", "acos": "acos(X)", "atan": "atan(X)",
    "sinh": "sinh(X)", "cosh": "cosh(X)", "tanh": "tanh(X)", "asinh": "asinh(X)", "deg": "degrees(X)", "rad": "radians(X)", "sgn": "sign(X)",
}
for _f, _sql in UNIT_RANGE.items():
    instant(f"promql_{_f}", f"max by (job) ({_f}(clamp(sample == sample, 0, 1)))", ["job"], f"max({_sql.replace('X', 'least(greatest(v, 0), 1)')})", "job", NUMBER)
for _f, _sql in {"ln": "ln(X)", "log2": "log2(X)", "log10": "log10(X)", "acosh": "acosh(X)"}.items():
    instant(f"promql_{_f}", f"max by (job) ({_f}(clamp(sample == sample, 1, 5)))", ["job"], f"max({_sql.replace('X', 'least(greatest(v, 1), 5)')})", "job", NUMBER)
instant("promql_atanh", "max by (job) (atanh(clamp(sample == sample, 0, 0.5)))", ["job"], "max(atanh(least(greatest(v, 0), 0.5)))", "job", NUMBER)
instant("promql_clamp_min", "min by (job) (clamp_min(sample == sample, 10))", ["job"], "min(greatest(v, 10))", "job", NUMBER)
instant("promql_clamp_max", "max by (job) (clamp_max(sample == sample, 10))", ["job"], "max(least(v, 10))", "job", NUMBER)
AT = "make_timestamp(ts * 1000)"
for _f, _sql in {"year": "year(T)", "month": "month(T)", "day_of_month": "day(T)", "day_of_year": "dayofyear(T)", "day_of_week": "dayofweek(T)", "hour": "hour(T)", "minute": "minute(T)", "days_in_month": "day(last_day(T))"}.items():
    instant(f"promql_{_f}", f"max by (job) ({_f}(timestamp(sample)))", ["job"], f"max({_sql.replace('T', AT)})")
GOOD = "v > -1e15 AND v < 1e15 AND NOT isnan(v)"
instant("promql_stddev", "stddev by (job) (sample > -1e15 < 1e15)", ["job"], "stddev_pop(v)", "job", GOOD)
instant("promql_stdvar", "sqrt(stdvar by (job) (sample > -1e15 < 1e15))", ["job"], "sqrt(var_pop(v))", "job", GOOD)
instant("promql_modulo_power", "max by (job) ((sample > -1e15 < 1e15) % 7 ^ 2)", ["job"], "max(fmod(v, 49))", "job", GOOD)
instant("promql_atan2", "max by (job) ((sample == sample) atan2 3)", ["job"], "max(atan2(v, 3))", "job", NUMBER)
instant("promql_unary_minus", "min by (job) (-(sample == sample))", ["job"], "min(-v)", "job", NUMBER)
instant("promql_division", "max by (job) (1 / (1 + abs(sample == sample)))", ["job"], "max(1 / (1 + abs(v)))", "job", NUMBER)
prom("promql_label_join", "count by (pair) (label_join(sample, 'pair', '/', 'namespace', 'job'))", ["pair"], INSTANT + "z AS (SELECT namespace || '/' || coalesce(job, '') AS pair, t AS step, count(*)::DOUBLE AS value FROM n GROUP BY ALL) SELECT pair, step, value FROM z")
prom("promql_quantile_over_time", "max by (job) (quantile_over_time(0.75, sample[30m]))", ["job"], over(HALF) + f"""r AS (SELECT job, t, quantile_cont(v, 0.75) AS x FROM w GROUP BY namespace, ls, job, t HAVING bool_and(isfinite(v))),
z AS (SELECT job, t AS step, max(x) AS value FROM r GROUP BY ALL) SELECT job, step, {SHOWN} AS value FROM z WHERE {FINITE}""")
ORACLES["promql_quantile_over_time"] = over(HALF) + f"""o AS (SELECT namespace, ls, job, t, list_sort(list(CASE WHEN isnan(v) THEN '-inf'::DOUBLE ELSE v END)) AS a, count(*) FILTER (isnan(v)) AS m FROM w GROUP BY ALL),
p AS (SELECT *, 0.75 * (len(a) - 1) AS pos FROM o), r AS (SELECT job, t, CASE WHEN floor(pos) < m THEN 'nan'::DOUBLE WHEN floor(pos) = pos THEN a[pos::INT + 1] ELSE a[floor(pos)::INT + 1] * (1 - pos + floor(pos)) + a[floor(pos)::INT + 2] * (pos - floor(pos)) END AS x FROM p),
z AS (SELECT job, t AS step, coalesce(max(CASE WHEN NOT isnan(x) THEN x END), 'nan'::DOUBLE) AS value FROM r GROUP BY ALL) SELECT job, step, {SHOWN} AS value FROM z WHERE {FINITE}"""
prom("promql_stddev_over_time", "count by (job) (stddev_over_time(sample[30m]) > 1)", ["job"], over(HALF) + "r AS (SELECT job, t, stddev_pop(v) AS x FROM w GROUP BY namespace, ls, job, t HAVING bool_and(isfinite(v))) SELECT job, t AS step, count(*)::DOUBLE AS value FROM r WHERE x > 1 GROUP BY ALL")
prom("promql_predict_linear", "count by (job) (predict_linear(sample[30m], 600) > 1000)", ["job"], over(HALF) + """r AS (SELECT job, t, CASE WHEN min(v) = max(v) THEN min(v) ELSE regr_intercept(v, (ts - t) / 1000) + 600 * regr_slope(v, (ts - t) / 1000) END AS x FROM w GROUP BY namespace, ls, job, t HAVING count(*) > 1 AND bool_and(isfinite(v)))
SELECT job, t AS step, count(*)::DOUBLE AS value FROM r WHERE x > 1000 GROUP BY ALL""")
prom("promql_absent_over_time", "absent_over_time(sample{job=~'amber.*'}[10m])", [], SERIES + GRID + "a AS (SELECT DISTINCT t FROM q JOIN g ON ts > t - 600000 AND ts <= t WHERE NOT stale AND job LIKE 'amber%') SELECT t AS step, 1.0::DOUBLE AS value FROM g ANTI JOIN a USING (t)")
prom("promql_bottomk", "bottomk by (namespace) (1, count by (namespace, job) (count_over_time(sample[3d])))", ["namespace", "job"], SERIES + GRID + """
l AS (SELECT namespace, job, t, count(DISTINCT ls) AS m FROM q JOIN g ON ts > t - 259200000 AND ts <= t WHERE NOT stale GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY namespace, t ORDER BY m, job) AS r FROM l)
SELECT namespace, job, t AS step, m::DOUBLE AS value FROM k WHERE r = 1""")
prom("promql_group_right", "sum by (namespace) (count_over_time(sample[30m])) - on (namespace) group_right () sum by (namespace, job) (count_over_time(sample[30m]))", ["namespace", "job"], over(HALF) + """
a AS (SELECT namespace, job, t, count(*) AS n FROM w GROUP BY ALL), b AS (SELECT namespace, t, count(*) AS n FROM w GROUP BY ALL) SELECT a.namespace, a.job, a.t AS step, (b.n - a.n)::DOUBLE AS value FROM a JOIN b ON a.namespace = b.namespace AND a.t = b.t""")
prom("promql_ignoring", "sum by (namespace, job) (count_over_time(sample[30m])) / ignoring (job) group_left sum by (namespace) (count_over_time(sample[30m]))", ["namespace", "job"], ORACLES["promql_matching"])
prom("promql_one_to_one", "count by (job) (count_over_time(sample[30m])) * count by (job) (last_over_time(sample[1h]))", ["job"], over(HALF) + """
a AS (SELECT job, t, count(DISTINCT (namespace, ls)) AS n FROM w GROUP BY ALL), b AS (SELECT job, t, count(DISTINCT (namespace, ls)) AS n FROM q JOIN g ON ts > t - 3600000 AND ts <= t WHERE NOT stale GROUP BY ALL)
SELECT a.job, a.t AS step, (a.n * b.n)::DOUBLE AS value FROM a JOIN b ON a.job IS NOT DISTINCT FROM b.job AND a.t = b.t""")

TOOK = ' | regexp "took=(?P<took>[0-9]+)ms" | unwrap took [1h]))'
V = "regexp_extract(line, 'took=([0-9]+)ms', 1)::DOUBLE"
HAS = "WHERE regexp_matches(line, 'took=[0-9]+ms') GROUP BY ALL"
for _f, _sql in {"sum": f"sum({V})", "min": f"min({V})"}.items():
    logql(f"logql_{_f}_over_time", f"{_f} by (app) ({_f}_over_time({ALL}{TOOK}", ["app"], f"SELECT app, t AS step, {_sql} AS value FROM w {HAS}")
for _f, _sql in {"avg": f"avg({V})", "stddev": f"stddev_pop({V})", "stdvar": f"var_pop({V})", "quantile": f"quantile_cont({V}, 0.5)", "first": f"arg_min({V}, (ns, entry_id))", "last": f"arg_max({V}, (ns, entry_id))"}.items():
    _q = f"{_f}_over_time({'0.5, ' if _f == 'quantile' else ''}{ALL}" + ' | regexp "took=(?P<took>[0-9]+)ms" | unwrap took [1h]) by (app)'
    logql(f"logql_{_f}_over_time", _q, ["app"], f"SELECT app, t AS step, round({_sql} + 2e-8, 6) AS value FROM w {HAS}")
logql("logql_absent_over_time", '{namespace=~".+"} |= "lease"'.join(["absent_over_time(", "[10m])"]), [], "SELECT t AS step, 1.0::DOUBLE AS value FROM g ANTI JOIN (SELECT DISTINCT t FROM e JOIN g ON ns > (t - 600000) * 1000000 AND ns <= t * 1000000 WHERE contains(line, 'lease')) USING (t)")
logql("logql_bytes_rate", f"sum by (namespace) (bytes_rate({ALL}[1h]))", ["namespace"], "SELECT namespace, t AS step, round(sum(strlen(line)) / 3600 + 2e-8, 6) AS value FROM w GROUP BY ALL")
logql("logql_bottomk", f"bottomk(2, sum by (app) (count_over_time({ALL}[1h])))", ["app"], "SELECT app, step, value FROM (SELECT app, t AS step, count(*)::DOUBLE AS value, row_number() OVER (PARTITION BY t ORDER BY count(*), app) AS r FROM w GROUP BY app, t) WHERE r <= 2")
logql("logql_and_unless", f'(sum by (app) (count_over_time({ALL}[1h])) and on (app) sum by (app) (count_over_time({ALL} |= "retry" [1h]))) unless on (app) sum by (app) (count_over_time({ALL} |= "lease" [1h]))', ["app"], "SELECT app, t AS step, count(*)::DOUBLE AS value FROM w GROUP BY ALL HAVING bool_or(contains(line, 'retry')) AND NOT bool_or(contains(line, 'lease'))")
logql("logql_or_vector", f'sum(count_over_time({ALL} |= "panicked" [1h])) or vector(0)', [], "SELECT g.t AS step, count(*) FILTER (contains(line, 'panicked'))::DOUBLE AS value FROM g LEFT JOIN w ON g.t = w.t GROUP BY 1")
logql("logql_label_replace", f'sum by (team) (label_replace(sum by (namespace) (count_over_time({ALL}[1h])), "team", "$1", "namespace", "([a-z]+)-.*"))', ["team"], "SELECT regexp_extract(namespace, '^([a-z]+)-.*$', 1) AS team, t AS step, count(*)::DOUBLE AS value FROM w GROUP BY ALL")
logql("logql_division_by_zero", f"sum by (app) (count_over_time({ALL}[1h])) / 0", ["app"], f"SELECT app, t AS step, {NOT_A_NUMBER}::DOUBLE AS value FROM w GROUP BY ALL")
logql("logql_pattern", f'sum by (code) (count_over_time({ALL} |= "lease renewed until" | pattern "<_>renewed until <code>:<_>" | code=~"[0-9][0-9]" | keep code [1h]))', ["code"], "SELECT regexp_extract(line, '^.*?renewed until ([^:]*):', 1) AS code, t AS step, count(*)::DOUBLE AS value FROM w WHERE contains(line, 'lease renewed until') AND regexp_matches(regexp_extract(line, '^.*?renewed until ([^:]*):', 1), '^[0-9][0-9]$') GROUP BY ALL")
logql("logql_line_format", f'sum by (app) (bytes_over_time({ALL} |= "lease" | line_format "{{{{.app}}}}: {{{{ __line__ | ToUpper | trunc 5 }}}}" [1h]))', ["app"], "SELECT app, t AS step, sum(strlen(app || ': ' || upper(substr(line, 1, 5))))::DOUBLE AS value FROM w WHERE contains(line, 'lease') GROUP BY ALL")
logql("logql_label_format", f'sum by (unit) (count_over_time({ALL} | label_format unit="{{{{ .app | trunc 4 }}}}-{{{{ .namespace }}}}" | keep unit [1h]))', ["unit"], "SELECT substr(app, 1, 4) || '-' || namespace AS unit, t AS step, count(*)::DOUBLE AS value FROM w GROUP BY ALL")
logql("logql_json", f'sum by (level) (count_over_time({ALL} |~ "^[{{].*[}}]$" | json level="level" | __error__="" | keep level [1h]))', ["level"], "SELECT nullif(json_extract_string(line, '$.level'), '') AS level, t AS step, count(*)::DOUBLE AS value FROM w WHERE regexp_matches(line, '^[{].*[}]$') AND json_valid(line) GROUP BY ALL")

traceql("traceql_or", "{ status = error } || { duration > 1s }", WHERE + "coalesce(status = 'error', false) OR dur > 1000000000")
traceql("traceql_arithmetic", "{ duration * 2 + 10ms > 1s - 5ms }", WHERE + "dur * 2 + 10000000 > 995000000")
traceql("traceql_not", '{ !(.http.method = "GET") && kind = client }', WHERE + "NOT coalesce(tags['http.method'] = 'GET', false) AND coalesce(kind = 'client', false)")
QUERIES["traceql_not_descendant"] = lambda spark, d: matched_spans(model.spans(spark, d), '{ name = "query" } !>> { status = error }').select("trace_id", "span_id")
ORACLES["traceql_not_descendant"] = ORACLES["traceql_descendant"].replace("AND (t, s) IN", "AND (t, s) NOT IN")
traceql("traceql_not_sibling", "{ status = error } !~ { kind = client }", "SELECT t AS trace_id, s AS span_id FROM x WHERE kind = 'client' AND NOT EXISTS (SELECT 1 FROM x a WHERE a.t = x.t AND a.p = x.p AND a.p <> '' AND a.s <> x.s AND a.status = 'error')")
traceql("traceql_coalesce", "{} | by(name) | coalesce() | count() > 10", ", k AS (SELECT t FROM x GROUP BY t HAVING count(*) > 10) " + WHERE + "t IN (SELECT t FROM k)")
traceql("traceql_min_max", "{} | max(duration) - min(duration) > 500ms", ", k AS (SELECT t FROM x GROUP BY t HAVING max(dur) - min(dur) > 500000000) " + WHERE + "t IN (SELECT t FROM k)")
traceql("traceql_sum", "{ kind = client } | sum(duration) >= 1s", ", k AS (SELECT t FROM x WHERE kind = 'client' GROUP BY t HAVING sum(dur) >= 1000000000) " + WHERE + "kind = 'client' AND t IN (SELECT t FROM k)")
traceql("traceql_pipeline_filter", "{ kind = server } | { status = error }", WHERE + "kind = 'server' AND status = 'error'")
traceql("traceql_root_name", '{ rootName = "query" && status = error }', ", r AS (SELECT t, arg_min(name, (start, s)) AS root FROM x WHERE NOT EXISTS (SELECT 1 FROM x q WHERE q.t = x.t AND q.s = x.p) GROUP BY t) " + WHERE + "status = 'error' AND t IN (SELECT t FROM r WHERE root = 'query')")


def traceql_nested_sets(spark: SparkSession, d: str) -> DataFrame:
    """Spans that are leaves by their nested-set numbers."""
    return matched_spans(model.spans(spark, d), "{ nestedSetRight - nestedSetLeft = 1 }").select("trace_id", "span_id")


QUERIES["traceql_nested_sets"] = traceql_nested_sets
ORACLES["traceql_nested_sets"] = SPANS.replace("WITH s AS", "WITH RECURSIVE s AS") + ", u AS (SELECT t, s FROM x WHERE p = '' UNION SELECT x.t, x.s FROM x JOIN u ON x.t = u.t AND x.p = u.s) SELECT t AS trace_id, s AS span_id FROM u WHERE NOT EXISTS (SELECT 1 FROM x c WHERE c.t = u.t AND c.p = u.s)"
