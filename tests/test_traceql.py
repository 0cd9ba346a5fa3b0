import random

import pytest

from skein.model import ATTRIBUTE
from skein.plans.promql.parser import QueryError
from skein.plans.traceql.compile import Compiler, legacy_tags, matched_spans, search

SCHEMA = f"trace_id string, span_id string, parent_span_id string, name string, kind string, status string, status_message string, start_ns long, end_ns long, span_attrs map<string,{ATTRIBUTE}>, resource_attrs map<string,{ATTRIBUTE}>, scope_name string, scope_version string, scope_attrs map<string,{ATTRIBUTE}>"
MS = 1_000_000


def attr(v):
    return (v if isinstance(v, str) else None, v if isinstance(v, bool) else None, v if type(v) is int else None, v if isinstance(v, float) else None)


def span(trace, sid, parent, name, start, ms, service="web", status="unset", kind="internal", **attrs):
    return (trace, sid, parent, name, kind, status, None, start * MS, (start + ms) * MS, {k: attr(v) for k, v in attrs.items()}, {"service.name": attr(service)}, "lib", "1.0", {})


ROWS = [
    span("t1", "a", None, "GET /", 0, 100, kind="server", code=200, ratio=0.5, flag=True),
    span("t1", "b", "a", "db", 10, 20, service="db", code=500, status="error"),
    span("t1", "c", "a", "cache", 30, 10, method="GET"),
    span("t1", "d", "c", "disk", 31, 5, code=7),
    span("t2", "a", "zz", "orphan", 5, 50, code=200),
    span("t2", "e", "a", "db", 6, 40, service="db"),
    span("t3", "x", "y", "loop", 7, 1),
    span("t3", "y", "x", "loop", 7, 1),
]


@pytest.fixture(scope="module")
def spans(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


CASES = [
    ("{}", "t1a t1b t1c t1d t2a t2e t3x t3y"), ("{ .code = 200 }", "t1a t2a"), ("{ span.code > 100 }", "t1a t1b t2a"), ("{ .code != 200 }", "t1b t1d"), ("{ .nope != 1 }", ""), ('{ .code = "200" }', ""),
    ("{ .code = nil }", "t1c t2e t3x t3y"), ("{ .code != nil && .code < 10 }", "t1d"), ('{ resource.service.name = "db" }', "t1b t2e"), ('{ .service.name =~ "d." }', "t1b t2e"), ('{ name !~ "db|loop" }', "t1a t1c t1d t2a"),
    ("{ status = error }", "t1b"), ("{ kind = server }", "t1a"), ("{ duration > 30ms }", "t1a t2a t2e"), ("{ .flag }", "t1a"), ("{ !.flag }", ""), ("{ !(.code = 200) }", "t1b t1c t1d t2e t3x t3y"), ("{ .ratio + 1 = 1.5 }", "t1a"),
    ("{ .code / 0 = 1 }", ""), ("{ .code * 2 = 14 }", "t1d"), ("{ .code % 5 = 2 }", "t1d"), ("{ 2 ^ 3 = 8 && .code = 7 }", "t1d"), ("{ -.code = -7 }", "t1d"), ('{ trace:rootName = "GET /" }', "t1a t1b t1c t1d"), ('{ trace:rootService = "web" && name = "db" }', "t1b t2e"),
    ("{ traceDuration >= 100ms && childCount = 2 }", "t1a"), ('{ span:id = "d" }', "t1d"), ('{ instrumentation:name = "lib" && name = "db" }', "t1b t2e"), ("{ nestedSetLeft = 1 }", "t1a"), ("{ nestedSetParent = 1 }", "t1b t1c"), ("{ nestedSetRight = 8 || nestedSetLeft = 5 }", "t1a t1d"),
    ('{ kind = server } > { name = "db" }', "t1b"), ('{ name = "db" } < { kind = server }', "t1a"), ('{ kind = server } >> { name = "disk" }', "t1d"), ('{ name = "disk" } << {}', "t1a t1c"), ('{ name = "db" } ~ {}', "t1c"), ('{ name = "loop" } >> { name = "loop" }', "t3x t3y"),
    ('{ kind = server } !> { name = "db" }', "t2e"), ('{ kind = server } !>> {}', "t1a t2a t2e t3x t3y"), ('{ kind = server } &> { name = "db" }', "t1a t1b"), ('{ kind = server } &>> { name = "disk" }', "t1a t1d"), ('{ name = "db" } &~ { name = "cache" }', "t1b t1c"),
    ('{ name = "db" } && { name = "cache" }', "t1b t1c"), ('{ name = "disk" } || { status = error }', "t1b t1d"), ('{ name = "db" } || { name = "cache" } > { name = "disk" }', "t1b t1d t2e"),
    ('{} | { name = "db" }', "t1b t2e"), ("{} | count() > 2", "t1a t1b t1c t1d"), ("{} | by(resource.service.name) | count() = 3", "t1a t1c t1d"), ("{} | by(.code) | coalesce() | count() = 4", "t1a t1b t1c t1d"),
    ("{ .code != nil } | avg(.code) > 210", "t1a t1b t1d"), ("{} | max(duration) - min(duration) > 50ms", "t1a t1b t1c t1d"), ("{ name = \"cache\" } | sum(.code) > 0", ""), ("{} | count() + 1 = 3", "t2a t2e t3x t3y"),
]


@pytest.mark.parametrize("query,want", CASES, ids=[c[0] for c in CASES])
def test_matches(spans, query, want):
    got = sorted(r.trace_id + r.span_id for r in matched_spans(spans, query).collect())
    assert got == want.split()


def test_summary_and_select(spans):
    rows = search(spans, "{ .code != nil }").collect()
    assert [(r.trace_id, r.root_name, r.root_service, r.duration_ns, r.matched) for r in rows] == [("t1", "GET /", "web", 100 * MS, 3), ("t2", "orphan", "web", 50 * MS, 1)]
    assert search(spans, "{}", 1).count() == 1
    got = matched_spans(spans, '{ name = "disk" } | select(.code, name)').collect()[0].asDict()
    assert got[".code"] == "7" and got["name"] == "disk"
    assert legacy_tags('code=7 m="a b"') == '{ .code = "7" && .m = "a b" }'


@pytest.mark.parametrize("query", ["", "{ 1 }", '{ .a && "x" }', "{ duration = \"x\" }", "{ event.x = 1 }", "{} | rate()", "{} | count(.x) > 1", "{} | sum(name) > 1", "{} | by(1)", "{} | count()", "{ name = }", "{} >>> {}"])
def test_errors(spans, query):
    with pytest.raises(QueryError):
        matched_spans(spans, query)


def nested_by_walk(rows):
    """(left, right, above) of each span, by walking every trace from its parentless spans."""
    out = {(t, s): (0, 0, 0) for t, s, *_ in rows}
    under = {}
    for r in sorted(rows, key=lambda r: (r[7], r[1])):
        under.setdefault((r[0], r[2] or None), []).append(r[1])
    for t in {r[0] for r in rows}:
        at, todo = 0, [(s, -1, False) for s in reversed(under.get((t, None), []))]
        while todo:
            s, above, closing = todo.pop()
            if not closing:
                left = at = at + 1
                todo += [(s, (left, above), True), *[(c, left, False) for c in reversed(under.get((t, s), []))]]
            else:
                at += 1
                out[t, s] = (above[0], at, above[1])
    return out


def test_nested_sets(spark):
    """Against a walk: forests, orphans, cycles, a deep chain, a star; and the plan doesn't hold the spans' plan again and again."""
    rng = random.Random(3)
    rows = []
    for t in "abcd":
        for i in range(40):
            parent = rng.choice([None, "", "gone", *[f"n{j}" for j in (range(i) if rng.random() < 0.9 else range(40))] * 2])
            rows.append(span(t, f"n{i}", parent, "x", rng.randrange(5), 1))
    rows += [span("deep", f"d{i}", f"d{i - 1}" if i else None, "x", 1, 1) for i in range(70)] + [span("star", f"s{i}", "s0" if i else "", "x", -i, 1) for i in range(50)] + [span("self", "x", "x", "x", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    numbers = Compiler(df).nested_sets()
    want = nested_by_walk(rows)
    assert {(r.trace_id, r.span_id): (r._left, r._right, r._above) for r in numbers.collect()} == want
    assert len({v for v in want.values()}) > 100 and sum(v == (0, 0, 0) for v in want.values()) > 10
    assert numbers._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 3
