"""Further queries over whole tables: log stages, structural traces, sources as round trips, discovery, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import catalog as cat
from skein import labels as lab
from skein import model
from skein.catalog import ALL, END, FINITE, GRID, HALF, HOUR, INSTANT, LOGS, ORACLES, PAIR, QUERIES, SERIES, SPANS, START, STEP, VECTORS, WHERE, flat, instant, logql, over, prom, traceql
from skein.plans import files as fs
from skein.plans.logql.compile import query_logs, query_metric
from skein.plans.promql.compile import evaluate
from skein.plans.search import rank
from skein.plans.traceql.compile import legacy_tags, matched_spans, search
from skein.runtime import table
from skein.sources import discovery, otlp, vectors, wire

NOON = START + 36 * HOUR

# --- metrics ----------------------------------------------------------------------------------------------------------

instant("promql_pi", "sum by (job) (clamp(sample == sample, 0, 1) * pi())", ["job"], "sum(least(greatest(v, 0), 1) * pi())", "job", cat.NUMBER)
instant("promql_not_equal", "count by (job) (sample != 0)", ["job"], "count(*)", "job", "v <> 0")
instant("promql_less_equal", "count by (job) (sample <= 100)", ["job"], "count(*)", "job", "v <= 100 AND NOT isnan(v)")
# Where a function has no value: counted over all samples, infinite ones too.
OUTSIDE = {
    "ln": "v < 0", "log2": "v < 0", "log10": "v < 0", "sqrt": "v < 0", "asin": "v > 1 OR v < -1", "acos": "v > 1 OR v < -1", "acosh": "v < 1", "atanh": "v > 1 OR v < -1",
    "sin": "isinf(v)", "cos": "isinf(v)", "tan": "isinf(v)",
}
for _f, _sql in OUTSIDE.items():
    instant(f"promql_{_f}_undefined", f"count by (job) ({_f}(sample) != {_f}(sample))", ["job"], "count(*)", "job", f"isnan(v) OR {_sql}")
instant("promql_ln_zero", "count by (job) (ln(sample) == -Inf)", ["job"], "count(*)", "job", "v = 0")
instant("promql_exp_infinite", "count by (job) (exp(sample) == +Inf)", ["job"], "count(*)", "job", "v > 709.79 AND NOT isnan(v)")
instant("promql_nan_kept", "count by (job) (abs(sample) != abs(sample))", ["job"], "count(*)", "job", "isnan(v)")
ROUGH = "round(clamp({}, -1000, 1000), 0.01)"
SLOPE = "CASE WHEN NOT bool_and(isfinite(v)) THEN 'nan'::DOUBLE WHEN min(v) = max(v) THEN {0} ELSE {1} END"
for _name, _call, _sql, _least in (
    ("deriv", "deriv(sample[30m])", SLOPE.format("0", "regr_slope(v, (ts - t) / 1000)"), 2),
    ("predict_linear", "predict_linear(sample[30m], 600)", SLOPE.format("min(v)", "regr_intercept(v, (ts - t) / 1000) + 600 * regr_slope(v, (ts - t) / 1000)"), 2),
    ("stddev_over_time", "stddev_over_time(sample[30m])", "CASE WHEN NOT bool_and(isfinite(v)) THEN 'nan'::DOUBLE ELSE stddev_pop(CASE WHEN isfinite(v) THEN v END) END", 1),
):
    prom(f"promql_{_name}_value", f"max by (job) ({ROUGH.format(_call)})", ["job"], over(HALF) + f"""r AS (SELECT job, t, {_sql.replace('regr_slope(v,', 'regr_slope(CASE WHEN isfinite(v) THEN v END,').replace('regr_intercept(v,', 'regr_intercept(CASE WHEN isfinite(v) THEN v END,')} AS x
FROM w GROUP BY namespace, ls, job, t HAVING count(*) >= {_least}),
z AS (SELECT job, t AS step, max(CASE WHEN NOT isnan(x) THEN floor(least(greatest(x, -1000), 1000) * 100 + 0.5) / 100 END) AS value FROM r GROUP BY ALL) SELECT job, step, coalesce(round(value + 2e-8, 6), {cat.NOT_A_NUMBER}) AS value FROM z""")


def at_noon(name: str, text: str, names: list[str], sql: str) -> None:
    """An instant query at one time."""
    QUERIES[name] = lambda spark, d: flat(evaluate(spark, cat.sample_view(spark, d), text, NOON), names)
    ORACLES[name] = sql.replace(GRID, f"g AS (SELECT {NOON}::BIGINT AS t),")


COUNTED = SERIES + GRID + "z AS (SELECT job, t AS step, count(*)::DOUBLE AS value FROM q JOIN g ON ts > t - 1800000 AND ts <= t WHERE NOT stale GROUP BY ALL) SELECT job, step, value FROM z"
at_noon("promql_sort", "sort(sum by (job) (count_over_time(sample[30m])))", ["job"], COUNTED)
at_noon("promql_sort_desc", "sort_desc(sum by (job) (count_over_time(sample[30m])))", ["job"], COUNTED)
prom("promql_name_dropping", "count by (__name__) (abs(sample))", ["__name__"], INSTANT + "c AS (SELECT t, count(*)::DOUBLE AS k FROM n GROUP BY 1) SELECT NULL::VARCHAR AS \"__name__\", t AS step, k AS value FROM c")
prom("promql_or_ignores_names", "count by (__name__) (sample > 100) or count by (__name__) (abs(sample))", ["__name__"], INSTANT + "c AS (SELECT t, count(*) AS k, count(*) FILTER (v > 100 AND NOT isnan(v)) AS m FROM n GROUP BY 1) SELECT CASE WHEN m > 0 THEN 'sample' END AS \"__name__\", t AS step, (CASE WHEN m > 0 THEN m ELSE k END)::DOUBLE AS value FROM c")
prom("promql_negative_offset", "sum by (job) (count_over_time(sample[30m] offset -1h))", ["job"], SERIES + GRID + "z AS (SELECT job, t AS step, count(*)::DOUBLE AS value FROM q JOIN g ON ts > t + 1800000 AND ts <= t + 3600000 WHERE NOT stale GROUP BY ALL) SELECT job, step, value FROM z")
prom("promql_at_start_end", "sum by (job) (count_over_time(sample[1h] @ end())) - sum by (job) (count_over_time(sample[1h] @ start()))", ["job"], SERIES + GRID + f"""a AS (SELECT job, count(*) FILTER (ts > {END - HOUR} AND ts <= {END}) AS x, count(*) FILTER (ts > {START - HOUR} AND ts <= {START}) AS y FROM q WHERE NOT stale GROUP BY 1)
SELECT job, t AS step, (x - y)::DOUBLE AS value FROM a CROSS JOIN g WHERE x > 0 AND y > 0""")
prom("promql_matchers", 'count by (job) (sample{job!="",job!~"amber.*|b.*",namespace=~"prod-.+"})', ["job"], INSTANT + "z AS (SELECT job, t AS step, count(*)::DOUBLE AS value FROM n WHERE coalesce(job, '') <> '' AND NOT regexp_matches(job, '^(amber.*|b.*)$') AND regexp_matches(namespace, '^prod-.+$') GROUP BY ALL) SELECT job, step, value FROM z")
NATIVE = cat.native
NATIVE("promql_native_avg", "sum by (namespace) (histogram_avg(h))", "sum(CASE WHEN c = 0 THEN 'nan'::DOUBLE ELSE total / c END)")
NATIVE("promql_native_arithmetic", "sum by (namespace) (histogram_count(h * 3 + h))", "sum(c * 4)")
NATIVE("promql_native_division", "sum by (namespace) (histogram_sum(h / 4))", "sum(total / 4)")
NATIVE("promql_native_equal", "count by (namespace) (h == h)", "count(*)::DOUBLE")

# --- logs -------------------------------------------------------------------------------------------------------------

logql("logql_offset", f"sum by (app) (count_over_time({ALL}[1h] offset 30m))", ["app"], "SELECT app, t AS step, count(*)::DOUBLE AS value FROM e JOIN g ON ns > (t - 5400000) * 1000000 AND ns <= (t - 1800000) * 1000000 GROUP BY ALL")
ROWS_AT = "strpos(line, ' rows=') > 1 AND length(line) > strpos(line, ' rows=') + 5"
logql("logql_pattern_filter", f"sum by (app) (count_over_time({ALL} |> `<_> rows=<_>` [1h]))", ["app"], f"SELECT app, t AS step, count(*)::DOUBLE AS value FROM w WHERE {ROWS_AT} GROUP BY ALL")
logql("logql_pattern_filter_not", f"sum by (app) (count_over_time({ALL} !> `<_> rows=<_>` [1h]))", ["app"], f"SELECT app, t AS step, count(*)::DOUBLE AS value FROM w WHERE NOT ({ROWS_AT}) GROUP BY ALL")
logql("logql_or_chain", f'sum by (app) (count_over_time({ALL} |= "lease" or "peer" !~ "said" or "route" [1h]))', ["app"], "SELECT app, t AS step, count(*)::DOUBLE AS value FROM w WHERE (contains(line, 'lease') OR contains(line, 'peer')) AND NOT (contains(line, 'said') OR contains(line, 'route')) GROUP BY ALL")
logql("logql_match", f'sum by (app) (count_over_time({ALL} |= "tenant" | match "closing such" [1h]))', ["app"], "SELECT app, t AS step, count(*)::DOUBLE AS value FROM w WHERE contains(line, 'tenant') AND regexp_matches(lower(line), '(^|[^a-z0-9_.:''])such([^a-z0-9_.:'']|$)') AND regexp_matches(lower(line), '(^|[^a-z0-9_.:''])closing([^a-z0-9_.:'']|$)') GROUP BY ALL")
OBJECT = "CASE WHEN json_valid(line) THEN json_type(line) = 'OBJECT' ELSE false END"
logql("logql_json_flatten", f'sum by (target) (count_over_time({ALL} |= "fields" | json | __error__="" | fields_n > 50 [1h]))', ["target"], f"SELECT json_extract_string(line, '$.target') AS target, t AS step, count(*)::DOUBLE AS value FROM w WHERE contains(line, 'fields') AND {OBJECT} AND try_cast(json_extract_string(line, '$.fields.n') AS DOUBLE) > 50 GROUP BY ALL")
logql("logql_json_errors", f'sum by (app) (count_over_time({ALL} |= "panicked" | json | __error__="JSONParserErr" | drop __error__, __error_details__ [1h]))', ["app"], f"SELECT app, t AS step, count(*)::DOUBLE AS value FROM w WHERE contains(line, 'panicked') AND NOT {OBJECT} GROUP BY ALL")
TS = "|~ `^ts=[^ ]+ level=[a-zA-Z]+ component=[a-z-]+ msg=.* took=[0-9]+ms\\r?$`"
LINES = "w JOIN (SELECT entry_id, any_value(list_filter(labels, lambda x: x.name = 'component' AND x.value <> '')[1].value) AS stream_component FROM log_entries GROUP BY 1) USING (entry_id) WHERE regexp_matches(line, '^ts=[^ ]+ level=[a-zA-Z]+ component=[a-z-]+ msg=.* took=[0-9]+ms\\r?$')"
LEVEL, COMPONENT, TOOK = "regexp_extract(line, ' level=([a-zA-Z]+)', 1)", "regexp_extract(line, ' component=([a-z-]+)', 1)", "regexp_extract(line, ' took=([0-9]+)ms\\r?$', 1)::DOUBLE"
logql("logql_logfmt", f'sum by (level) (count_over_time({ALL} {TS} | logfmt | keep level [1h]))', ["level"], f"SELECT {LEVEL} AS level, t AS step, count(*)::DOUBLE AS value FROM {LINES} GROUP BY ALL")
logql("logql_collision", f"sum by (component_extracted) (count_over_time({ALL} {TS} | logfmt | keep component_extracted [1h]))", ["component_extracted"], f"SELECT CASE WHEN stream_component IS NOT NULL THEN {COMPONENT} END AS component_extracted, t AS step, count(*)::DOUBLE AS value FROM {LINES} GROUP BY ALL")
logql("logql_logfmt_chosen", f'sum by (lvl) (count_over_time({ALL} {TS} | logfmt --strict lvl="level" | keep lvl [1h]))', ["lvl"], f"SELECT {LEVEL} AS lvl, t AS step, count(*)::DOUBLE AS value FROM {LINES} GROUP BY ALL")
logql("logql_and_or", f'sum by (app) (count_over_time({ALL} {TS} | logfmt | (level="info" or level="error"), took > 300ms [1h]))', ["app"], f"SELECT app, t AS step, count(*)::DOUBLE AS value FROM {LINES} AND {LEVEL} IN ('info', 'error') AND {TOOK} > 300 GROUP BY ALL")
logql("logql_unwrap_duration", f"max by (app) (max_over_time({ALL} {TS} | logfmt | unwrap duration(took) [1h]))", ["app"], f"SELECT app, t AS step, round(max({TOOK} / 1000) + 2e-8, 6) AS value FROM {LINES} GROUP BY ALL")
SHARD = "regexp_extract(line, 'shard ([0-9]+) ([a-z]+)', {})"
logql("logql_post_unwrap", f'max by (app) (max_over_time({ALL} | regexp "shard (?P<n>[0-9]+) (?P<kind>[a-z]+)" | unwrap n | kind="moved" [1h]))', ["app"], f"SELECT app, t AS step, max({SHARD.format(1)}::DOUBLE) AS value FROM w WHERE {SHARD.format(2)} = 'moved' GROUP BY ALL")
logql("logql_comparison", f"sum by (app) (count_over_time({ALL}[1h])) > 3", ["app"], "SELECT app, t AS step, count(*)::DOUBLE AS value FROM w GROUP BY ALL HAVING count(*) > 3")
logql("logql_comparison_bool", f"sum by (app) (count_over_time({ALL}[1h])) <= bool 3", ["app"], "SELECT app, t AS step, (count(*) <= 3)::INT::DOUBLE AS value FROM w GROUP BY ALL")
logql("logql_sums", f"(sum by (app) (count_over_time({ALL}[1h])) * 7 + 3 - 1) % 5", ["app"], "SELECT app, t AS step, ((count(*) * 7 + 2) % 5)::DOUBLE AS value FROM w GROUP BY ALL")
logql("logql_group_left", f"sum by (namespace, app) (count_over_time({ALL}[1h])) * on (namespace) group_left sum by (namespace) (count_over_time({ALL}[1h]))", ["namespace", "app"], "SELECT a.namespace, a.app, a.t AS step, (a.n * b.n)::DOUBLE AS value FROM (SELECT namespace, app, t, count(*) AS n FROM w GROUP BY ALL) a JOIN (SELECT namespace, t, count(*) AS n FROM w GROUP BY ALL) b ON a.namespace = b.namespace AND a.t = b.t")
logql("logql_vector_aggregates", f"avg by (namespace) (sum by (namespace, app) (count_over_time({ALL}[1h])))", ["namespace"], "SELECT namespace, t AS step, round(avg(n) + 2e-8, 6) AS value FROM (SELECT namespace, app, t, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL")
logql("logql_vector_count", f"count by (namespace) (sum by (namespace, app) (count_over_time({ALL}[1h])))", ["namespace"], "SELECT namespace, t AS step, count(DISTINCT app)::DOUBLE AS value FROM w GROUP BY ALL")
logql("logql_loose_regex", f'sum by (app) (count_over_time({ALL} | app =~ "amber.*" [1h]))', ["app"], "SELECT app, t AS step, count(*)::DOUBLE AS value FROM w WHERE contains(app, 'amber') GROUP BY ALL")
logql("logql_metadata_filter", f'sum by (namespace) (count_over_time({ALL} | trace_id != "" [1h]))', ["namespace"], "SELECT namespace, t AS step, count(*)::DOUBLE AS value FROM w WHERE coalesce(meta['trace_id'], '') <> '' GROUP BY ALL")
logql("logql_without", f"sum without (pod, component, zone, stream, aaa_group, tier, owner, shard, zz_note, canary, namespace, app) (count_over_time({ALL} | drop trace_id, node, shard [1h]))", [], "SELECT t AS step, count(*)::DOUBLE AS value FROM w GROUP BY ALL")


def logql_made(name: str, line: str, text: str, labels: list[str], sql: str) -> None:
    """Over lines that are made of the table's columns; ``line``: expression over entry_id that both engines read alike."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = model.log_entries(spark, d).withColumn("line", F.expr(line))
        return flat(query_metric(spark, rows, text, START, END, STEP), labels)

    QUERIES[name] = run
    ORACLES[name] = LOGS.replace("any_value(line) AS line", f"{line} AS line") + sql


ADDRESS = "concat('addr=10.0.', CAST(entry_id % 64 AS STRING), '.', CAST(entry_id % 251 AS STRING), ' size=', CAST(entry_id % 97 AS STRING), 'KB from ', 'host')"
logql_made("logql_ip_line", ADDRESS, f'sum by (namespace) (count_over_time({ALL} |= ip("10.0.0.0/20") [1h]))', ["namespace"], "SELECT namespace, t AS step, count(*)::DOUBLE AS value FROM w WHERE entry_id % 64 < 16 GROUP BY ALL")
logql_made("logql_ip_label", ADDRESS, f'sum by (namespace) (count_over_time({ALL} | logfmt | addr = ip("10.0.3.1-10.0.9.200") [1h]))', ["namespace"], "SELECT namespace, t AS step, count(*)::DOUBLE AS value FROM w WHERE entry_id % 64 * 256 + entry_id % 251 BETWEEN 3 * 256 + 1 AND 9 * 256 + 200 GROUP BY ALL")
logql_made("logql_unwrap_bytes", ADDRESS, f"sum by (namespace) (sum_over_time({ALL} | logfmt | unwrap bytes(size) [1h]))", ["namespace"], "SELECT namespace, t AS step, sum(entry_id % 97 * 1000)::DOUBLE AS value FROM w GROUP BY ALL")
logql_made("logql_bytes_filter", ADDRESS, f"sum by (namespace) (count_over_time({ALL} | logfmt | size >= 50KB [1h]))", ["namespace"], "SELECT namespace, t AS step, count(*)::DOUBLE AS value FROM w WHERE entry_id % 97 >= 50 GROUP BY ALL")
PACKED = """concat('{"_entry":"n ', CAST(entry_id % 10 AS STRING), '","who":"w', CAST(entry_id % 5 AS STRING), '","app":"other","k":7}')"""
logql_made("logql_unpack", PACKED, f'sum by (who, app_extracted) (count_over_time({ALL} | unpack |= "n 3" | keep who, app_extracted [1h]))', ["who", "app_extracted"], "SELECT 'w' || (entry_id % 5) AS who, 'other' AS app_extracted, t AS step, count(*)::DOUBLE AS value FROM w WHERE entry_id % 10 = 3 GROUP BY ALL")
logql_made("logql_jinja", ADDRESS, f"sum by (namespace) (bytes_over_time({ALL} | logfmt | line_format jinja \"{{{{ size | upper }}}}-{{% if size == '5KB' %}}five{{% else %}}x{{% endif %}}\" [1h]))", ["namespace"], "SELECT namespace, t AS step, sum(strlen(entry_id % 97 || 'KB-' || CASE WHEN entry_id % 97 = 5 THEN 'five' ELSE 'x' END))::DOUBLE AS value FROM w GROUP BY ALL")
logql_made("logql_template_numbers", ADDRESS, f"sum by (unit) (count_over_time({ALL} | logfmt | label_format unit=`{{{{ mod (trimSuffix \"KB\" .size) 7 | add 1 }}}}` | keep unit [1h]))", ["unit"], "SELECT (entry_id % 97 % 7 + 1)::VARCHAR AS unit, t AS step, count(*)::DOUBLE AS value FROM w GROUP BY ALL")


def logql_at_end(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, d: flat(query_metric(spark, model.log_entries(spark, d), text, END), ["app"])
    ORACLES[name] = LOGS.replace(GRID, f"g AS (SELECT {END}::BIGINT AS t),").replace("(t - 3600000)", "(t - 345600000)") + sql


LAST = "SELECT app, t AS step, count(*)::DOUBLE AS value FROM w GROUP BY ALL"
logql_at_end("logql_approx_topk", f"approx_topk(3, sum by (app) (count_over_time({ALL}[4d])))", LAST + " ORDER BY value DESC, app LIMIT 3")
logql_at_end("logql_sort", f"sort(sum by (app) (count_over_time({ALL}[4d])))", LAST)
logql_at_end("logql_sort_desc", f"sort_desc(sum by (app) (count_over_time({ALL}[4d])))", LAST)


def logql_rate_counter(spark: SparkSession, d: str) -> DataFrame:
    text = f"sum by (namespace) (rate_counter({ALL} |= \"took=\" | regexp \"took=(?P<took>[0-9]+)ms\" | took != \"\" | keep namespace, took | unwrap took [1h]))"
    return flat(query_metric(spark, model.log_entries(spark, d), text, START, END, STEP), ["namespace"])


QUERIES["logql_rate_counter"] = logql_rate_counter  # entries of one time have no order in SQL: tested on a small fixture


def logql_matched_entries(spark: SparkSession, d: str) -> DataFrame:
    """The best entries of a full-text search; their scores are tested on a small fixture."""
    return query_logs(spark, model.log_entries(spark, d), ALL + ' | match "lease renewed"', START * 10**6, END * 10**6, 1000, True).select("ts_ns", "line", F.round("score", 6).alias("score"))


QUERIES["logql_matched_entries"] = logql_matched_entries
# The words of a text as the analyser takes them, in the other engine's regular expressions.
WORDS = rf"list_transform(regexp_extract_all({{0}}, '[A-Za-z][A-Za-z0-9+.-]*://[^\s\p{{{{Z}}}}\"''<>]+|[\p{{{{L}}}}\p{{{{N}}}}_.+-]+@[\p{{{{L}}}}\p{{{{N}}}}_-]+(?:\.[\p{{{{L}}}}\p{{{{N}}}}_-]+)+|\p{{{{Nd}}}}+(?:[.,]\p{{{{Nd}}}}+)+|(?:[\p{{{{L}}}}\p{{{{N}}}}_]+[''’.:])*[\p{{{{L}}}}\p{{{{N}}}}_]*[\p{{{{L}}}}\p{{{{N}}}}]|[\p{{{{L}}}}\p{{{{N}}}}_]+'), lambda x: lower(x))".replace("{{{{", "{{").replace("}}}}", "}}")
TF = "len(list_filter(words, lambda x: x = '{0}'))"
ORACLES["logql_matched_entries"] = LOGS + f""", b AS (SELECT *, {WORDS.format("line")} AS words, ns // 3600000000000 AS seg FROM e WHERE ns >= {START} * 1000000 AND ns < {END} * 1000000),
c AS (SELECT *, greatest(len(words), 1) AS size, {TF.format("lease")} AS t1, {TF.format("renewed")} AS t2 FROM b),
s AS (SELECT seg, count(*) AS n, avg(size) AS mean, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM c GROUP BY 1),
l AS (SELECT entry_id, any_value(list_sort(list_filter(labels, lambda x: x.value <> ''))) AS ls FROM log_entries GROUP BY 1),
k AS (SELECT namespace, ls, ns, line, meta, any_value(ln((n - d1 + 0.5) / (d1 + 0.5) + 1) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * size / greatest(mean, 1))) + ln((n - d2 + 0.5) / (d2 + 0.5) + 1) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * size / greatest(mean, 1)))) AS score
  FROM c JOIN s USING (seg) JOIN l USING (entry_id) WHERE t1 > 0 AND t2 > 0 GROUP BY ALL)
SELECT ns AS ts_ns, line, round(score, 6) AS score FROM k"""

# --- traces -----------------------------------------------------------------------------------------------------------

traceql("traceql_ids", '{ span:id =~ "^[0-7]" && trace:id =~ "[02468ace]$" }', WHERE + "regexp_matches(s, '^[0-7]') AND regexp_matches(t, '[02468ace]$')")
traceql("traceql_cross_type", "{ childCount > 0.5 && childCount < 2.5 }", ", k AS (SELECT t, p, count(*) AS n FROM x WHERE p <> '' GROUP BY ALL) SELECT x.t AS trace_id, x.s AS span_id FROM x JOIN k ON k.t = x.t AND k.p = x.s WHERE k.n < 2.5")
traceql("traceql_select", "{ status = error && kind = server } | select(name, .zone)", WHERE + "status = 'error' AND kind = 'server'")
traceql("traceql_not_parent", "{ kind = server } !< { status = error }", WHERE + "status = 'error' AND NOT EXISTS (SELECT 1 FROM x a WHERE a.t = x.t AND a.p = x.s AND a.kind = 'server')")
BOTH = " SELECT * FROM r UNION SELECT DISTINCT a.t, a.s FROM x a JOIN x b ON a.t = b.t AND {0}"
for _name, _op, _on in (("union_parent", "&<", "a.p = b.s AND a.p <> '' WHERE a.status = 'error' AND b.kind = 'server'"), ("union_sibling", "&~", "a.p = b.p AND a.p <> '' AND a.s <> b.s WHERE a.status = 'error' AND b.kind = 'server'")):
    traceql(f"traceql_{_name}", f"{{ status = error }} {_op} {{ kind = server }}", ", r AS (" + PAIR + "AND " + _on + ")" + BOTH.format(_on))
RECURSIVE = SPANS.replace("WITH s AS", "WITH RECURSIVE s AS")
UP = ", u AS (SELECT t, s AS low, p AS up FROM x WHERE {0} AND p <> '' UNION SELECT u.t, u.low, x.p FROM u JOIN x ON x.t = u.t AND x.s = u.up WHERE x.p <> '')"
traceql("traceql_not_ancestor", "{ status = error } !<< { kind = server }", "")
ORACLES["traceql_not_ancestor"] = RECURSIVE + UP.format("status = 'error'") + " SELECT t AS trace_id, s AS span_id FROM x WHERE kind = 'server' AND (t, s) NOT IN (SELECT t, up FROM u)"
traceql("traceql_union_descendant", '{ name = "query" } &>> { status = error }', "")
ORACLES["traceql_union_descendant"] = RECURSIVE + UP.format("status = 'error'") + ", m AS (SELECT u.t, u.low, u.up FROM u JOIN x ON x.t = u.t AND x.s = u.up WHERE x.name = 'query') SELECT t AS trace_id, low AS span_id FROM m UNION SELECT t, up FROM m"
traceql("traceql_union_ancestor", '{ status = error } &<< { name = "query" }', "")
ORACLES["traceql_union_ancestor"] = ORACLES["traceql_union_descendant"]
traceql("traceql_field_precedence", "{ duration > 1s || kind = server && status = error }", WHERE + "dur > 1000000000 OR coalesce(kind = 'server' AND status = 'error', false)")
traceql("traceql_scalar_precedence", "{} | count() + 2 * 3 > 12", ", k AS (SELECT t FROM x GROUP BY t HAVING count(*) > 6) " + WHERE + "t IN (SELECT t FROM k)")
traceql("traceql_no_instrumentation", '{ instrumentation:name = "x" || kind = consumer }', WHERE + "coalesce(kind = 'consumer', false)")
QUERIES["traceql_tags_search"] = lambda spark, d: matched_spans(model.spans(spark, d), legacy_tags('zone=zone-d http.method="POST"')).select("trace_id", "span_id")
ORACLES["traceql_tags_search"] = SPANS + WHERE + "tags['zone'] = 'zone-d' AND tags['http.method'] = 'POST'"
QUERIES["traceql_time_range"] = lambda spark, d: matched_spans(model.spans(spark, d, START * 10**6, (START + 24 * HOUR) * 10**6), "{ kind = server }").select("trace_id", "span_id")
ORACLES["traceql_time_range"] = SPANS + WHERE + f"kind = 'server' AND start >= {START * 10**6} AND start < {(START + 24 * HOUR) * 10**6}"

# --- search -----------------------------------------------------------------------------------------------------------

BM_TERMS = ["flusher", "lease", "segment"]
ORACLES["search_bm25"] = f"""WITH b AS (SELECT doc_id AS id, {WORDS.format("text")} AS words FROM documents WHERE text IS NOT NULL),
c AS (SELECT id, len(words) AS size, {", ".join(f"{TF.format(w)} AS t{i}" for i, w in enumerate(BM_TERMS))} FROM b),
s AS (SELECT count(*) AS n, avg(size) AS mean, {", ".join(f"count(*) FILTER (t{i} > 0) AS d{i}" for i in range(3))} FROM c),
q AS (SELECT *, CASE WHEN size < 64 THEN size ELSE floor(size / 2 ^ (floor(log2(size)) - 3)) * 2 ^ (floor(log2(size)) - 3) END AS kept FROM c, s),
r AS (SELECT id, {" + ".join(f"(ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2 / (t{i} + 1.2 * (0.25 + 0.75 * kept / greatest(mean, 1))))::FLOAT::DOUBLE" for i in range(3))} AS score FROM q WHERE t0 + t1 + t2 > 0)
SELECT id, round(score, 5) AS score FROM r ORDER BY r.score DESC, id LIMIT 50"""
ORACLES["search_centroids"] = ORACLES["search_knn_cosine"]  # the lists are searched exactly
cat.filtered("search_filter_bounds", ["And", [["price", "Gt", 1000], ["price", "Lte", 4000]]], "coalesce(price > 1000 AND price <= 4000, false)")
cat.filtered("search_filter_not_in", ["And", [["category", "NotIn", ["alert", "runbook"]], ["tags", "NotContainsAny", ["flintgate"]]]], "NOT coalesce(category IN ('alert', 'runbook'), false) AND NOT coalesce(list_has_any(tags, ['flintgate']), false)")
QUERIES["search_unranked"] = lambda spark, d: rank.unranked(cat.vector_rows(spark, d), 100, ["price", "Gt", 500]).select("id")
ORACLES["search_unranked"] = VECTORS + "SELECT id FROM v WHERE price > 500 ORDER BY id LIMIT 100"
QUERIES["search_project"] = lambda spark, d: rank.project(rank.order_by(cat.vector_rows(spark, d), "price", False, 20), None, ["tags"])
ORACLES["search_project"] = VECTORS + "SELECT id, category, price FROM v ORDER BY price NULLS LAST, id LIMIT 20"


def search_get(spark: SparkSession, d: str) -> DataFrame:
    rows = cat.vector_rows(spark, d)
    return rank.get(rows, rows.agg(F.min("id")).first()[0]).select("id", "category", "price")


QUERIES["search_get"] = search_get
ORACLES["search_get"] = VECTORS + "SELECT id, category, price FROM v ORDER BY id LIMIT 1"


def search_multi(spark: SparkSession, d: str) -> DataFrame:
    """Several requests over one state of the rows."""
    found = rank.multi(cat.vector_rows(spark, d), [lambda r: rank.count(r, ["price", "Gt", 1000]), lambda r: rank.count(r, ["category", "NotExists"])])
    return found[0].select(F.lit("dear").alias("request"), "count").unionByName(found[1].select(F.lit("plain").alias("request"), "count"))


QUERIES["search_multi"] = search_multi
ORACLES["search_multi"] = VECTORS + "SELECT 'dear' AS request, count(*) FILTER (price > 1000) AS count FROM v UNION ALL SELECT 'plain', count(*) FILTER (category IS NULL) FROM v"


def vector_writes(spark: SparkSession, d: str) -> DataFrame:
    """The log after one request: deletion by a filter, patches, deletes and a whole row, in their order."""
    log = table(spark, d, "vectors")
    rows = rank.latest(log)
    patches = rows.filter(F.col("category") == "runbook").select("id", F.lit(77).cast("bigint").alias("price"))
    deletes = rows.filter(F.col("price") == 0).select("id")
    new = spark.createDataFrame([("zz-new", "alert", 5)], "id string, category string, price bigint")
    after = vectors.apply_batch(log, 1 << 40, where=["category", "Eq", "alert"], rows=new, patches=patches, deletes=deletes)
    return rank.latest(vectors.compact(after)).groupBy("category").agg(F.count("*").alias("n"), F.sum("price").alias("price"))


QUERIES["source_vector_writes"] = vector_writes
ORACLES["source_vector_writes"] = VECTORS + """, k AS (SELECT category, CASE WHEN category = 'runbook' THEN 77 ELSE price END AS price, price = 0 AS gone FROM v WHERE coalesce(category <> 'alert', true) UNION ALL SELECT 'alert', 5, false)
SELECT category, count(*) AS n, sum(price)::BIGINT AS price FROM k WHERE NOT coalesce(gone, false) GROUP BY 1"""


def source_passages(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, fits (no passage is too long) of every text that isn't blank."""
    docs = table(spark, d, "documents").filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("id"), "text")
    p = vectors.passages(docs)
    return p.groupBy(F.col("`$doc_id`").cast("bigint").alias("doc_id")).agg((F.max(F.char_length("text")) <= vectors.MAX_CHARS).alias("fits"))


QUERIES["source_passages"] = source_passages
ORACLES["source_passages"] = r"SELECT doc_id, true AS fits FROM documents WHERE regexp_matches(text, '[^\s\p{Z}\x{85}\x{1c}-\x{1f}\x{b}]')"

# --- sources: the tables' rows as request bodies, decoded again -----------------------------------------------------------


def _attr(key: str | Column, value: Column) -> Column:
    return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value"))


def _metric_body(kind: str, point: list[Column], name: Column, service: Column, extra: list[Column] = ()) -> Column:  # type: ignore[assignment]
    data = F.struct(F.struct(F.array(F.struct(*point)).alias("dataPoints"), *extra).alias(kind), name.alias("name"))
    return F.to_json(F.struct(F.array(F.struct(F.struct(F.array(_attr("service.name", service)).alias("attributes")).alias("resource"), F.array(F.struct(F.array(data).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))).alias("value")


def _finite_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "samples").filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")) & F.col("timestamp_ms").isNotNull())
    return rows.withColumn("name", lab.get(F.col("labels"), "__name__")).filter(F.col("name").isNotNull() & F.col("namespace").isNotNull())


def _samples_out(df: DataFrame) -> DataFrame:
    return df.groupBy(lab.get(F.col("labels"), "job").alias("job"), lab.get(F.col("labels"), "__name__").alias("name")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.sum("ts_ms").alias("times"))


def _otlp_numbers(kind: str, extra=list):
    def run(spark: SparkSession, d: str) -> DataFrame:
        point = [(F.col("timestamp_ms") * 1_000_000).cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble")]
        return _samples_out(otlp.metrics(_finite_samples(spark, d).select(_metric_body(kind, point, F.col("name"), F.col("namespace"), extra()))))

    return run


SAMPLES_SQL = """WITH s AS (SELECT namespace, list_filter(labels, lambda x: x.name = '__name__' AND x.value <> '')[1].value AS name, value, timestamp_ms FROM samples WHERE isfinite(value) AND timestamp_ms IS NOT NULL)
SELECT namespace AS job, {0} AS name, count(*) AS n, min(value) AS low, max(value) AS high, sum(timestamp_ms)::BIGINT AS times FROM s WHERE name IS NOT NULL AND namespace IS NOT NULL GROUP BY ALL"""
QUERIES["source_otlp_gauge"] = _otlp_numbers("gauge")
ORACLES["source_otlp_gauge"] = SAMPLES_SQL.format("name")
QUERIES["source_otlp_sum"] = _otlp_numbers("sum", lambda: [F.lit("2").alias("aggregationTemporality"), F.lit(True).alias("isMonotonic")])
ORACLES["source_otlp_sum"] = SAMPLES_SQL.format("CASE WHEN ends_with(name, '_total') THEN name ELSE name || '_total' END")
BOUNDS = [0.001, 0.01, 0.1, 1.0, 10.0]


def source_otlp_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "spans").filter(F.col("duration").isNotNull() & F.col("service_name").isNotNull())
    edges = [float("-inf"), *[b * 1e9 for b in BOUNDS], float("inf")]
    counts = [F.sum(F.when((F.col("duration") > low) & (F.col("duration") <= up), 1).otherwise(0)).cast("string") for low, up in zip(edges, edges[1:], strict=False)]
    wide = rows.groupBy("service_name").agg(F.array(*counts).alias("c"), F.count("*").cast("string").alias("n"), F.sum("duration").cast("double").alias("total"))
    point = [F.lit(str(START * 10**6)).alias("timeUnixNano"), F.col("n").alias("count"), F.col("total").alias("sum"), F.col("c").alias("bucketCounts"), F.array(*map(F.lit, BOUNDS)).alias("explicitBounds")]
    out = otlp.metrics(wide.select(_metric_body("histogram", point, F.lit("took"), F.col("service_name"), [F.lit("2").alias("aggregationTemporality")])))
    return out.select(lab.get(F.col("labels"), "job").alias("job"), lab.get(F.col("labels"), "__name__").alias("name"), lab.get(F.col("labels"), "le").alias("le"), "value")


QUERIES["source_otlp_histogram"] = source_otlp_histogram
ORACLES["source_otlp_histogram"] = """WITH s AS (SELECT service_name AS job, duration FROM spans WHERE duration IS NOT NULL AND service_name IS NOT NULL), b AS (SELECT unnest(['0.001', '0.01', '0.1', '1', '10', '+Inf']) AS le)
SELECT job, 'took_bucket' AS name, le, count(*) FILTER (le = '+Inf' OR duration <= try_cast(le AS DOUBLE) * 1e9)::DOUBLE AS value FROM s CROSS JOIN b GROUP BY ALL
UNION ALL SELECT job, 'took_sum', NULL, sum(duration)::DOUBLE FROM s GROUP BY 1 UNION ALL SELECT job, 'took_count', NULL, count(*)::DOUBLE FROM s GROUP BY 1"""


def source_otlp_exponential(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "histograms").filter((F.col("hist_schema") >= 0) & F.col("hist_count").isNotNull() & F.col("timestamp_ms").isNotNull() & (F.size("positive_indexes") > 0))
    side = F.struct((F.get("positive_indexes", F.lit(0)) - 1).alias("offset"), F.transform("positive_counts", lambda x: x.cast("string")).alias("bucketCounts"))
    point = [(F.col("timestamp_ms") * 1_000_000).cast("string").alias("timeUnixNano"), F.col("hist_count").cast("string").alias("count"), F.col("hist_schema").alias("scale"), F.col("zero_count").cast("string").alias("zeroCount"), side.alias("positive")]
    out = otlp.metrics(rows.select(_metric_body("exponentialHistogram", point, F.lit("h"), F.col("namespace"), [F.lit("2").alias("aggregationTemporality")])))
    first = F.get("hist.positive", F.lit(0))["index"]
    return out.groupBy(lab.get(F.col("labels"), "job").alias("job"), F.col("hist.schema").alias("scale")).agg(
        F.count("*").alias("n"), F.round(F.sum("hist.count"), 3).alias("observations"), F.sum(first).alias("first_index"), F.sum(F.size("hist.positive")).cast("bigint").alias("buckets")
    )


QUERIES["source_otlp_exponential"] = source_otlp_exponential
ORACLES["source_otlp_exponential"] = """SELECT namespace AS job, hist_schema AS scale, count(*) AS n, round(sum(hist_count), 3) AS observations, sum(positive_indexes[1])::BIGINT AS first_index, sum(len(positive_indexes))::BIGINT AS buckets
FROM histograms WHERE hist_schema >= 0 AND hist_count IS NOT NULL AND timestamp_ms IS NOT NULL AND len(positive_indexes) > 0 GROUP BY ALL"""


def source_otlp_summary(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "spans").filter(F.col("duration").isNotNull() & F.col("service_name").isNotNull()).groupBy("service_name").agg(F.count("*").alias("n"), F.min("duration").alias("low"), F.max("duration").alias("high"))
    q = lambda share, c: F.struct(F.lit(share).alias("quantile"), F.col(c).cast("double").alias("value"))
    point = [F.lit(str(START * 10**6)).alias("timeUnixNano"), F.col("n").cast("string").alias("count"), F.array(q(0.0, "low"), q(0.5, "low"), q(1.0, "high")).alias("quantileValues")]
    out = otlp.metrics(wide.select(_metric_body("summary", point, F.lit("took"), F.col("service_name"))))
    return out.select(lab.get(F.col("labels"), "job").alias("job"), lab.get(F.col("labels"), "__name__").alias("name"), lab.get(F.col("labels"), "quantile").alias("quantile"), "value")


QUERIES["source_otlp_summary"] = source_otlp_summary
ORACLES["source_otlp_summary"] = """WITH s AS (SELECT service_name AS job, count(*)::DOUBLE AS n, min(duration)::DOUBLE AS low, max(duration)::DOUBLE AS high FROM spans WHERE duration IS NOT NULL AND service_name IS NOT NULL GROUP BY 1)
SELECT job, 'took' AS name, '0' AS quantile, low AS value FROM s UNION ALL SELECT job, 'took', '0.5', low FROM s UNION ALL SELECT job, 'took', '1', high FROM s UNION ALL SELECT job, 'took_count', NULL, n FROM s"""


def _log_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "log_entries").filter(F.col("line").isNotNull() & F.col("timestamp_ns").isNotNull() & F.col("namespace").isNotNull())


def _logs_out(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(lab.get(F.col("labels"), name).alias("namespace")).agg(F.count("*").alias("n"), F.sum(F.octet_length("line")).alias("bytes"), F.count(F.try_element_at("metadata", F.lit("trace_id"))).alias("traced"), F.max("ts_ns").alias("newest"))


LOGS_SQL = "SELECT namespace, count(*) AS n, sum(strlen(line))::BIGINT AS bytes, count(structured_metadata['trace_id']) AS traced, max(timestamp_ns) AS newest FROM log_entries WHERE line IS NOT NULL AND timestamp_ns IS NOT NULL AND namespace IS NOT NULL GROUP BY 1"


def source_log_push(spark: SparkSession, d: str) -> DataFrame:
    value = F.array(F.col("timestamp_ns").cast("string"), F.col("line"), F.coalesce(F.to_json("structured_metadata"), F.lit("{}")))
    body = F.to_json(F.struct(F.array(F.struct(F.create_map(F.lit("namespace"), F.col("namespace")).alias("stream"), F.array(value).alias("values"))).alias("streams")))
    return _logs_out(otlp.loki_push(_log_rows(spark, d).select(body.alias("value"))), "namespace")


def source_otlp_logs(spark: SparkSession, d: str) -> DataFrame:
    record = F.struct(F.col("timestamp_ns").cast("string").alias("timeUnixNano"), F.struct(F.col("line").alias("stringValue")).alias("body"), F.coalesce(F.try_element_at("structured_metadata", F.lit("trace_id")), F.lit("")).alias("traceId"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(_attr("k8s.namespace", F.col("namespace"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    return _logs_out(otlp.logs(_log_rows(spark, d).select(body.alias("value"))), "k8s_namespace")


def source_bulk(spark: SparkSession, d: str) -> DataFrame:
    when = F.concat(F.date_format(F.timestamp_seconds(F.floor(F.col("timestamp_ns") / 1_000_000_000)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad((F.col("timestamp_ns") % 1_000_000_000).cast("string"), 9, "0"), F.lit("Z"))
    document = F.to_json(F.struct(when.alias("@timestamp"), F.col("line").alias("message"), "namespace", F.try_element_at("structured_metadata", F.lit("trace_id")).alias("trace_id")))
    body = F.concat(F.lit('{"index":{}}\n'), document, F.lit('\n{"delete":{"_id":"1"}}\n'))
    return _logs_out(otlp.bulk(_log_rows(spark, d).select(body.alias("value")), stream_fields=("namespace",)), "namespace")


for _f in (source_log_push, source_otlp_logs, source_bulk):
    QUERIES[_f.__name__], ORACLES[_f.__name__] = _f, LOGS_SQL


def _span_rows(spark: SparkSession, d: str) -> DataFrame:
    good = F.col("trace_id").isNotNull() & F.col("span_id").isNotNull() & F.col("start_time").isNotNull() & F.col("duration").isNotNull() & F.col("service_name").isNotNull() & F.col("span_kind").isNotNull()
    return table(spark, d, "spans").filter(good).withColumn("start_us", cat.model.utc_micros(F.col("start_time")))


def _spans_out(df: DataFrame) -> DataFrame:
    text = lambda m, k: F.try_element_at(m, F.lit(k))["s"]
    return df.groupBy(text("resource_attrs", "service.name").alias("service"), "kind").agg(F.count("*").alias("n"), F.sum((F.col("end_ns") - F.col("start_ns")) / 1000).cast("bigint").alias("took_us"), F.count(text("span_attrs", "http.method")).alias("with_method"), F.min("trace_id").alias("least_trace"))


SPANS_SQL = """SELECT service_name AS service, lower(span_kind) AS kind, count(*) AS n, sum({0})::BIGINT AS took_us, count(tags['http.method']) AS with_method, min({1}) AS least_trace FROM spans
WHERE trace_id IS NOT NULL AND span_id IS NOT NULL AND start_time IS NOT NULL AND duration IS NOT NULL AND service_name IS NOT NULL AND span_kind IS NOT NULL GROUP BY ALL"""


def source_otlp_traces(spark: SparkSession, d: str) -> DataFrame:
    tags = F.transform(F.map_entries(F.coalesce("tags", F.expr("cast(map() as map<string,string>)"))), lambda e: _attr(e["key"], e["value"]))
    nanos = F.col("start_us") * 1000
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("operation_name").alias("name"), F.concat(F.lit("SPAN_KIND_"), F.upper("span_kind")).alias("kind"), nanos.cast("string").alias("startTimeUnixNano"), (nanos + F.floor(F.col("duration") / 1000) * 1000).cast("string").alias("endTimeUnixNano"), tags.alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(_attr("service.name", F.col("service_name"))).alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    return _spans_out(otlp.traces(_span_rows(spark, d).select(body.alias("value"))))


def source_zipkin(spark: SparkSession, d: str) -> DataFrame:
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("id"), F.col("operation_name").alias("name"), F.upper("span_kind").alias("kind"), F.col("start_us").alias("timestamp"), F.floor(F.col("duration") / 1000).alias("duration"), F.struct(F.col("service_name").alias("serviceName")).alias("localEndpoint"), "tags")
    return _spans_out(otlp.zipkin(_span_rows(spark, d).select(F.to_json(F.array(span)).alias("value"))))


QUERIES["source_otlp_traces"], ORACLES["source_otlp_traces"] = source_otlp_traces, SPANS_SQL.format("duration // 1000", "lower(trace_id)")
QUERIES["source_zipkin"], ORACLES["source_zipkin"] = source_zipkin, SPANS_SQL.format("duration // 1000", "lpad(lower(trace_id), 32, '0')")


def _remote_write(version: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _finite_samples(spark, d).select(lab.put(lab.canonical(F.col("labels")), "job", F.col("namespace")).alias("labels"), "timestamp_ms", "value")
        return _samples_out(wire.remote_write(wire.encoded(rows, version)))

    return run


for _v in (1, 2):
    QUERIES[f"source_remote_write_{_v}"], ORACLES[f"source_remote_write_{_v}"] = _remote_write(_v), SAMPLES_SQL.format("name")

# --- discovery, encodings, files ----------------------------------------------------------------------------------------

joined = lambda: F.array_join(F.transform("labels", lambda x: F.concat(x["name"], F.lit("="), x["value"])), ",")
QUERIES["discovery_series"] = lambda spark, d: discovery.series(model.metric_samples(spark, d), ['{__name__=~"tel_.*"}', '{namespace="prod-ledger"}']).select(joined().alias("series"))
ORACLES["discovery_series"] = SERIES.rstrip().rstrip(",") + " SELECT DISTINCT array_to_string(list_transform(list_sort(ls || [{'name': 'namespace', 'value': namespace}]), lambda x: x.name || '=' || x.value), ',') AS series FROM q WHERE metric LIKE 'tel_%' OR namespace = 'prod-ledger'"


def discovery_trace(spark: SparkSession, d: str) -> DataFrame:
    rows = model.spans(spark, d)
    return discovery.trace_by_id(rows, rows.agg(F.max("trace_id")).first()[0]).select("trace_id", "span_id", "name", "start_ns")


QUERIES["discovery_trace"] = discovery_trace
ORACLES["discovery_trace"] = SPANS + "SELECT t AS trace_id, s AS span_id, name, start AS start_ns FROM x WHERE t = (SELECT max(t) FROM x)"
QUERIES["discovery_exact_search"] = lambda spark, d: discovery.exact_search(model.spans(spark, d), {"http.method": "POST", "zone": "zone-d"}, START * 10**6, END * 10**6, 50)
ORACLES["discovery_exact_search"] = SPANS + f"SELECT t AS trace_id, min(start) AS start_ns FROM x GROUP BY t HAVING bool_or(coalesce(tags['http.method'] = 'POST', false)) AND bool_or(coalesce(tags['zone'] = 'zone-d', false)) AND min(start) <= {END * 10**6} AND max(start + dur) >= {START * 10**6} ORDER BY 2, 1 LIMIT 50"
QUERIES["discovery_scan"] = lambda spark, d: discovery.scan(model.spans(spark, d), 100)
ORACLES["discovery_scan"] = SPANS + "SELECT t AS trace_id, min(start) AS start_ns, count(*) AS spans FROM x GROUP BY t ORDER BY 2, 1 LIMIT 100"
QUERIES["discovery_tag_values"] = lambda spark, d: discovery.tag_values(model.spans(spark, d), "http.status_code", "span")
ORACLES["discovery_tag_values"] = SPANS + "SELECT DISTINCT 'string' AS type, tags['http.status_code'] AS value FROM x WHERE tags['http.status_code'] IS NOT NULL"
QUERIES["discovery_federate"] = lambda spark, d: discovery.federate(spark, cat.sample_view(spark, d), ['{namespace=~"prod-.*"}'], NOON).select(F.regexp_extract("line", r"^(\w+)\{", 1).alias("name"), F.regexp_extract("line", 'job="([^"]*)"', 1).alias("job"), F.regexp_extract("line", r" (\d+)$", 1).alias("at")).groupBy("name", "job", "at").agg(F.count("*").alias("n"))
ORACLES["discovery_federate"] = INSTANT.replace(GRID, f"g AS (SELECT {NOON}::BIGINT AS t),") + f"k AS (SELECT 1) SELECT 'sample' AS name, coalesce(job, '') AS job, '{NOON}' AS at, count(*) AS n FROM n WHERE regexp_matches(namespace, '^prod-') GROUP BY ALL"


def encode_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = discovery.prometheus_json(evaluate(spark, cat.sample_view(spark, d), "sum by (job) (count_over_time(sample[30m]))", START, END, STEP), True)
    return out.select(F.get_json_object("json", "$.metric.job").alias("job"), F.explode(F.from_json(F.get_json_object("json", "$.values"), "array<array<string>>")).alias("p")).select("job", F.get("p", F.lit(0)).cast("double").alias("at"), F.get("p", F.lit(1)).alias("text"))


QUERIES["encode_metrics"] = encode_metrics
ORACLES["encode_metrics"] = SERIES + GRID + "z AS (SELECT job, t, count(*) AS n FROM q JOIN g ON ts > t - 1800000 AND ts <= t WHERE NOT stale GROUP BY ALL) SELECT job, t / 1000 AS at, n::VARCHAR AS text FROM z"


def encode_logs(spark: SparkSession, d: str) -> DataFrame:
    rows = query_logs(spark, model.log_entries(spark, d), ALL + ' |= "lease"', START * 10**6, END * 10**6, 100)
    return discovery.loki_json(rows).select(F.explode(F.from_json(F.get_json_object("json", "$.values"), "array<array<string>>")).alias("p")).select(F.get("p", F.lit(0)).cast("bigint").alias("ts_ns"), F.get("p", F.lit(1)).alias("line"))


QUERIES["encode_logs"] = encode_logs
ORACLES["encode_logs"] = ORACLES["logql_entries"].replace("regexp_replace(line, '\\x1b\\[[0-9;:?]*[A-Za-z]', '', 'g') AS line", "line")
QUERIES["encode_traces"] = lambda spark, d: discovery.tempo_json(search(model.spans(spark, d), "{ status = error }", 50)).select(F.get_json_object("json", "$.traceID").alias("trace_id"), F.get_json_object("json", "$.durationMs").cast("bigint").alias("duration_ms"))
ORACLES["encode_traces"] = "SELECT trace_id, duration_ns // 1000000 AS duration_ms FROM (" + ORACLES["traceql_search"] + ")"


def files_tree(spark: SparkSession, d: str) -> DataFrame:
    """The tree after a rename, an append, a removal and a new file; sizes of what is left."""
    rows = fs.rename(cat.document_files(spark, d), "/en", "/xx")
    first = rows.filter(F.startswith("path", F.lit("/xx/"))).agg(F.min("path")).first()[0] or "/none"
    rows = fs.unlink(fs.append(rows, first, b"12345"), "/none/at/all")
    new = rows.limit(0).unionByName(spark.createDataFrame([("t", "/new/a.txt", "file", 3, bytearray(b"abc"))], "tenant string, path string, kind string, size bigint, content binary"))
    rows = fs.write(rows, new)
    return rows.groupBy(F.split("path", "/")[1].alias("top")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum(F.octet_length("content")).alias("held"))


QUERIES["files_tree"] = files_tree
ORACLES["files_tree"] = cat.FILES + """, r AS (SELECT CASE WHEN path LIKE '/en/%' THEN 'xx' ELSE split_part(path, '/', 2) END AS top, size FROM f UNION ALL SELECT 'new', 3 UNION ALL SELECT 'xx', 5 WHERE EXISTS (SELECT 1 FROM f WHERE path LIKE '/en/%'))
SELECT top, count(*) - CASE WHEN top = 'xx' THEN 1 ELSE 0 END AS n, sum(size)::BIGINT AS bytes, sum(size)::BIGINT AS held FROM r GROUP BY top"""
QUERIES["files_stat"] = lambda spark, d: fs.stat(cat.document_files(spark, d), cat.document_files(spark, d).agg(F.min("path")).first()[0]).select("path", "size")
ORACLES["files_stat"] = cat.FILES + "SELECT path, size FROM f ORDER BY path LIMIT 1"
QUERIES["files_grep_regex"] = lambda spark, d: fs.grep(cat.document_files(spark, d), r"lease (renewed|lost)", ignore_case=True, limit=None).groupBy("path").agg(F.count("*").alias("n"))
ORACLES["files_grep_regex"] = cat.FILES + """, l AS (SELECT path, unnest(regexp_split_to_array(regexp_replace(text, '\\n$', ''), '\\r?\\n')) AS line FROM f WHERE NOT contains(text, chr(0)))
SELECT path, count(*) AS n FROM l WHERE regexp_matches(line, '(?i)lease (renewed|lost)') GROUP BY 1"""
