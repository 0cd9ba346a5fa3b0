import re

import pytest

from skein.functions.templates import TemplateError, parse as parse_template, render
from skein.plans.logql import stages as st
from skein.plans.logql.compile import query_logs, query_metric
from skein.plans.promql.parser import QueryError

SCHEMA = "labels array<struct<name:string,value:string>>, ts_ns long, line string, metadata map<string,string>, entry_id long"
S = 1_000_000_000
LINES = [
    ("a", 1, 'level=info msg="hello world" took=10ms size=1KB status=200', {}),
    ("a", 2, 'level=error msg="bad thing" took=1.5s size=2KB status=500', {"trace": "t1"}),
    ("a", 3, 'level=info msg="hello again" took=20ms status=oops', {}),
    ("a", 3, 'level=info msg="hello again" took=20ms status=oops', {}),
    ("b", 4, '{"level":"warn","n":{"x":5},"arr":[1,{"k":"v"}],"ip":"10.0.0.7"}', {}),
    ("b", 5, "not json", {}),
    ("b", 6, "\x1b[31mred\x1b[0m GET /api/users 200", {}),
]


@pytest.fixture(scope="module")
def logs(spark):
    rows = [([("app", a)], t * S, line, m, i) for i, (a, t, line, m) in enumerate(LINES)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def lines(spark, logs, query, **kw):
    return [r.line for r in query_logs(spark, logs, query, 0, 100 * S, forward=True, **kw).collect()]


def labels(spark, logs, query):
    return [{x.name: x.value for x in r.labels} for r in query_logs(spark, logs, query, 0, 100 * S, forward=True).collect()]


def numbers(spark, logs, query, at=10, **kw):
    return {",".join(f"{x.name}={x.value}" for x in r.labels): r.value for r in query_metric(spark, logs, query, at * 1000, **kw).collect()}


@pytest.mark.parametrize(
    "query,count",
    [
        ('{app="a"}', 3), ('{app=~"a|b"}', 6), ('{app!="a", app=~".+"}', 3), ('{app="a"} |= "hello"', 2), ('{app="a"} != "hello"', 1), ('{app="a"} |~ "h.llo w"', 1), ('{app="a"} !~ "hello|bad"', 0),
        ('{app="a"} |= "world" or "bad"', 2), ('{app="a"} != "world" or "bad"', 1), ('{app="b"} |= ip("10.0.0.0/8")', 1), ('{app="b"} != ip("10.0.0.0/8")', 2), ('{app="b"} |> "<_>GET <_>"', 1),
        ('{app="a"} | logfmt | level="error"', 1), ('{app="a"} | logfmt | took > 15ms', 2), ('{app="a"} | logfmt | size >= 2KB', 1), ('{app="a"} | logfmt | status = 200', 2),
        ('{app="a"} | logfmt | level=~"err.*"', 1), ('{app="a"} | logfmt | level!~"inf.*" or took < 15ms', 2), ('{app="a"} | trace="t1"', 1), ('{app="b"} | json | n_x = 5 | __error__ = ""', 1),
        ('{app="a"} | match "hello again"', 1), ('{app="b"} | decolorize |= "red GET"', 1), ('{app="b"} | json | ip = ip("10.0.0.1-10.0.0.9")', 3),
    ],
)
def test_selection(spark, logs, query, count):
    assert len(lines(spark, logs, query)) == count


def test_parsers(spark, logs):
    got = labels(spark, logs, '{app="b"} |= "level" | json')[0]
    assert got == {"app": "b", "level": "warn", "n_x": "5", "ip": "10.0.0.7"}
    assert labels(spark, logs, '{app="b"} |= "level" | json k="arr[1].k", none="q"')[0] == {"app": "b", "k": "v"}
    assert labels(spark, logs, '{app="b"} |= "not" | json')[0]["__error__"] == "JSONParserErr"
    assert labels(spark, logs, '{app="a"} |= "world" | regexp "msg=.(?P<first>\\\\w+)"')[0] == {"app": "a", "first": "hello"}
    assert labels(spark, logs, '{app="b"} |= "GET" | decolorize | pattern "<colour> <method> <path> <code>"')[0] == {"app": "b", "code": "200", "colour": "red", "method": "GET", "path": "/api/users"}
    assert labels(spark, logs, '{app="a"} |= "world" | logfmt app="level"')[0] == {"app": "a", "app_extracted": "info"}
    assert labels(spark, logs, '{app="a"} |= "world" | logfmt | drop took, size, status, msg="hello world"')[0] == {"app": "a", "level": "info"}
    assert labels(spark, logs, '{app="a"} |= "world" | logfmt | keep level')[0] == {"level": "info"}
    assert labels(spark, logs, '{app="a"} |= "world" | logfmt | label_format lvl=level, x="{{.took}}!" | keep lvl, x')[0] == {"lvl": "info", "x": "10ms!"}
    assert lines(spark, logs, '{app="a"} |= "world" | logfmt | line_format "{{.level | ToUpper}} {{.msg}}"') == ["INFO hello world"]
    assert lines(spark, logs, '{app="a"} |= "world" | logfmt | line_format jinja "{{ level|upper }}:{{ __line__|length }}"')[0].startswith("INFO:")


def test_order_limit(spark, logs):
    got = query_logs(spark, logs, '{app=~".+"}', 0, 100 * S, limit=2).collect()
    assert [r.ts_ns // S for r in got] == [6, 5]
    got = query_logs(spark, logs, '{app="a"} | match "hello"', 0, 100 * S).collect()
    assert len(got) == 2 and got[0].score >= got[1].score > 0


@pytest.mark.parametrize(
    "query,want",
    [
        ('count_over_time({app="a"}[10s])', {"app=a": 4.0}), ('rate({app="a"}[10s])', {"app=a": 0.4}), ('sum(count_over_time({app=~".+"}[10s]))', {"": 7.0}), ('bytes_over_time({app="b"} |= "not" [10s])', {"app=b": 8.0}),
        ('sum by (level) (count_over_time({app="a"} | logfmt | drop took, size, msg, status [10s]))', {"level=info": 3.0, "level=error": 1.0}),
        ('sum_over_time({app="a"} | logfmt | status=~"[0-9]+" | unwrap status [10s]) by (app)', {"app=a": 700.0}), ('max_over_time({app="a"} | logfmt | unwrap duration(took) [10s]) by (app)', {"app=a": 1.5}),
        ('avg_over_time({app="a"} | logfmt | unwrap bytes(size) [10s]) by (app)', {"app=a": 1500.0}), ('quantile_over_time(0.5, {app="a"} | logfmt | unwrap bytes(size) [10s]) by (app)', {"app=a": 1500.0}),
        ('first_over_time({app="a"} | logfmt | unwrap bytes(size) [10s]) by (app)', {"app=a": 1000.0}), ('last_over_time({app="a"} | logfmt | unwrap bytes(size) [10s]) by (app)', {"app=a": 2000.0}),
        ('absent_over_time({app="zzz"}[10s])', {"app=zzz": 1.0}), ('absent_over_time({app="a"}[10s])', {}), ('approx_count_distinct(level, {app="a"} | logfmt [10s]) by (app)', {"app=a": 2.0}),
        ('topk(1, count_over_time({app=~".+"}[10s]))', {"app=a": 4.0}), ('bottomk(1, count_over_time({app=~".+"}[10s]))', {"app=b": 3.0}), ('count_over_time({app="a"}[10s]) / 0', {"app=a": float("nan")}),
        ('count_over_time({app=~".+"}[10s]) > 3', {"app=a": 4.0}), ('count_over_time({app=~".+"}[10s]) > bool 3', {"app=a": 1.0, "app=b": 0.0}), ('vector(2) * 3', {"": 6.0}), ("1 + 2", {"": 3.0}),
        ('count_over_time({app="a"}[10s]) + on(app) count_over_time({app=~".+"}[10s])', {"app=a": 8.0}), ('count_over_time({app="a"}[10s]) or vector(0)', {"app=a": 4.0, "": 0.0}),
        ('count_over_time({app="a"}[2s] offset 7s)', {"app=a": 3.0}), ('rate_counter({app="a"} | logfmt | unwrap bytes(size) [10s]) by (app)', {"app=a": 250.0}),
        ('label_replace(count_over_time({app="a"}[10s]), "z", "$1$1", "app", "(.)")', {"app=a,z=aa": 4.0}),
        ('sum(count_over_time({app="b"} | json [10s]))', {"": 3.0}),
    ],
)
def test_metrics(spark, logs, query, want):
    got = numbers(spark, logs, query)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, nan_ok=True)


def test_pipeline_errors_raise(spark, logs):
    with pytest.raises(Exception, match="JSONParserErr"):
        numbers(spark, logs, 'count_over_time({app="b"} | json [10s])')
    with pytest.raises(Exception, match="SampleExtractionErr"):
        numbers(spark, logs, 'sum_over_time({app="a"} | logfmt | unwrap status [10s])')
    assert numbers(spark, logs, 'sum by (app) (count_over_time({app="b"} | json | __error__="" [10s]))') == {"app=b": 1.0}


def test_range_grid(spark, logs):
    rows = query_metric(spark, logs, 'sum(count_over_time({app=~".+"}[2s]))', 2000, 6000, 2000).collect()
    assert {r.step: r.value for r in rows} == {2000: 2.0, 4000: 3.0, 6000: 2.0}


@pytest.mark.parametrize("query", ["{}", '{app=""}', '{app="a"', '{app="a"} | nope', 'sum_over_time({app="a"}[1s])', '{app="a"} | logfmt | a > "b"', 'count_over_time({app="a"})', '{app="a"} + 1', '{app="a"} | line_format "{{.x"', 'foo({app="a"}[1s])'])
def test_errors(spark, logs, query):
    with pytest.raises(QueryError):
        numbers(spark, logs, query)


def test_templates():
    f = lambda t, j=False: render(parse_template(t, j), {"a": "1", "b": "xy"}, "hello", 1_736_121_853_846_000_000)
    assert f("{{.a}}-{{ .b | upper }}") == "1-XY"
    assert f('{{ if eq .a "1" }}one{{ else if .b }}two{{ else }}x{{ end }}') == "one"
    assert f('{{ printf "%05d %s %.2f" (int .a) .b 3.14159 }}') == "00001 xy 3.14"
    assert f('{{ range $i, $e := fromJson "[1,2]" }}{{$i}}={{$e}};{{ end }}') == "0=1;1=2;"
    assert f('{{ default "d" .nope }}{{ .nope }}') == "d"
    assert f('{{ __timestamp__ | date "2006-01-02T15:04:05.000Z07:00" }}') == "2025-01-06T00:04:13.846Z"
    assert f('{{ regexReplaceAll "(\\\\w)(\\\\w)" .b "${2}${1}" }}') == "yx"
    assert f("{% if a == '1' %}yes{% else %}no{% endif %}{{ c|default('q') }}", True) == "yesq"
    assert f('{{ define "t" }}<{{.}}>{{ end }}{{ template "t" .a }}') == "<1>"
    with pytest.raises(TemplateError):
        parse_template("{{ nofunction .a }}")
    with pytest.raises(TemplateError):
        f("{{ div 1 0 }}")


def test_template_numbers_times_and_limits():
    ts = 1_736_121_600_123_456_789
    show = lambda text: render(parse_template(text), {"n": str(ts)}, "line", ts)
    assert show("{{ mod .n 1000 }} {{ div .n 1000 }} {{ div -7 2 }} {{ mod -7 2 }}") == "789 1736121600123456 -3 -1"
    assert show("{{ unixEpochNanos __timestamp__ }} {{ unixEpochMillis __timestamp__ }} {{ unixEpoch __timestamp__ }}") == "1736121600123456789 1736121600123 1736121600"
    assert show('{{ date "15:04:05.000000000" __timestamp__ }}') == "00:00:00.123456789"
    assert show('{{ substr -1 -1 "abcdef" }} {{ substr 1 3 "abcdef" }}') == "abcdef bc"
    for endless in ('{{ define "t" }}x{{ template "t" . }}{{ end }}{{ template "t" . }}', '{{ repeat 100000000 "abc" }}', "{{ range 1000000 }}x{{ end }}"):
        with pytest.raises(TemplateError):
            show(endless)


def test_pattern_and_logfmt():
    matches = lambda pattern, line: re.search(st.pattern_regex(pattern, r"\Z"), line) is not None
    assert matches("<_>b<_>", "abc") and not matches("<_>b<_>", "bc") and not matches("<_>b", "abc") and matches("<_>\\z", "a\\z") and not matches("", "a")
    assert st.pattern_fields("<a> - <_> [<b>]", "x - y [z] t") == {"a": "x", "b": "z"} and st.pattern_fields("<a>, <b>", "only") == {"a": "only"}
    assert st.pattern_fields("a <x>, <y>", "a 1") == {"x": "1"}
    assert st.logfmt('a=1 b="x \\"y\\"" c d=', False, True)[0] == {"a": "1", "b": 'x "y"', "c": "", "d": ""}
    assert st.logfmt("a=1 c", True, False)[1]
    assert [st.loose_regex(p)(v) for p, v in [("foo.*", "xfoo"), ("foo", "xfoo"), ("u37|u74", "xu37"), ("a[bc]", "xab"), (".+", "")]] == [True, False, True, False, False]
