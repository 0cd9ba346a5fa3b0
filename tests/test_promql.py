import math

import pytest
from pyspark.sql import functions as F
from promcase import load, run

from skein.plans.promql.parser import QueryError, parse

DATA = """
http_requests{job="api", instance="0", group="production"} 0+10x10
http_requests{job="api", instance="1", group="production"} 0+20x10
http_requests{job="api", instance="0", group="canary"} 0+30x10
http_requests{job="app", instance="0", group="production"} 0+50x10
http_requests{job="app", instance="1", group="canary"} 0+80x10
resets{x="a"} 0 10 20 5 15 3 3
gaps{x="a"} 1 _ 3 _x3 7 stale 9
nums{x="a"} 1 2 3 4 5 6 7 8 9 10 11
odd{x="nan"} NaNx10
odd{x="inf"} Infx10
odd{x="one"} 1x10
b_bucket{le="0.1"} 1x10
b_bucket{le="0.2"} 3x10
b_bucket{le="1e0"} 3x10
b_bucket{le="+Inf"} 4x10
"""


@pytest.fixture(scope="module")
def s(spark):
    return load(spark, "5m", DATA).cache()


def near(a, b):
    return a == b or (a != a and b != b) or abs(a - b) <= 1e-9 * max(1, abs(a), abs(b))


def check(got, want):
    assert set(got) == set(want), (got, want)
    for k in want:
        assert near(got[k], want[k]), (k, got[k], want[k])


CASES = [
    ("sum(http_requests)", {"": 1900.0}),
    ("sum by (job) (http_requests)", {"job=api": 600.0, "job=app": 1300.0}),
    ("sum without (instance, group) (http_requests)", {"job=api": 600.0, "job=app": 1300.0}),
    ("avg by (group) (http_requests)", {"group=canary": 550.0, "group=production": 800.0 / 3}),
    ("count(http_requests)", {"": 5.0}),
    ("min(odd)", {"": 1.0}),
    ("max(odd)", {"": math.inf}),
    ("group by (x) (odd)", {"x=nan": 1.0, "x=inf": 1.0, "x=one": 1.0}),
    ("stddev(nums or vector(21))", {"": 5.0}),
    ("quantile(0.5, http_requests)", {"": 300.0}),
    ("quantile(2, nums)", {"": math.inf}),
    ("topk(1, http_requests)", {"__name__=http_requests,group=canary,instance=1,job=app": 800.0}),
    ("bottomk by (job) (1, http_requests)", {"__name__=http_requests,group=production,instance=0,job=api": 100.0, "__name__=http_requests,group=production,instance=0,job=app": 500.0}),
    ('count_values("v", nums > bool 3)', {"v=1": 1.0}),
    ("rate(nums[50m])", {"x=a": 1 / 300}),
    ("increase(resets[30m])", {"x=a": 0.0}),
    ("increase(resets[30m] offset 20m)", {"x=a": 33.6}),
    ("resets(resets[50m])", {"x=a": 2.0}),
    ("changes(resets[50m])", {"x=a": 4.0}),
    ("delta(nums[50m])", {"x=a": 10.0}),
    ("irate(nums[50m])", {"x=a": 1 / 300}),
    ("idelta(nums[50m])", {"x=a": 1.0}),
    ("deriv(nums[50m])", {"x=a": 1 / 300}),
    ("deriv(odd{x='one'}[50m])", {"x=one": 0.0}),
    ("predict_linear(nums[50m], 300)", {"x=a": 12.0}),
    ("sum_over_time(nums[10m])", {"x=a": 21.0}),
    ("avg_over_time(nums[10m])", {"x=a": 10.5}),
    ("min_over_time(nums[10m])", {"x=a": 10.0}),
    ("max_over_time(odd[10m])", {"x=nan": math.nan, "x=inf": math.inf, "x=one": 1.0}),
    ("count_over_time(gaps[50m])", {"x=a": 3.0}),
    ("last_over_time(gaps[50m])", {"__name__=gaps,x=a": 9.0}),
    ("quantile_over_time(0.5, nums[50m])", {"x=a": 6.5}),
    ("stddev_over_time(nums[15m])", {"x=a": math.sqrt(2 / 3)}),
    ("stdvar_over_time(nums[15m])", {"x=a": 2 / 3}),
    ("present_over_time(nums[15m])", {"x=a": 1.0}),
    ("absent_over_time(nothing{a='b', c!='d'}[5m])", {"a=b": 1.0}),
    ("absent(nums)", {}),
    ("absent(nothing{a='b'})", {"a=b": 1.0}),
    ("nums @ 600", {"__name__=nums,x=a": 3.0}),
    ("nums offset 10m", {"__name__=nums,x=a": 9.0}),
    ("nums offset -5m @ 0", {"__name__=nums,x=a": 2.0}),
    ("sum_over_time(nums[20m:10m])", {"x=a": 11.0 + 9.0}),
    ("max_over_time(rate(nums[10m])[20m:5m])", {"x=a": 1 / 300}),
    ("1 + 2 * 3 ^ 2", {"": 19.0}),
    ("-2 ^ 2", {"": -4.0}),
    ("1 / 0", {"": math.inf}),
    ("0 / 0", {"": math.nan}),
    ("-7 % 3", {"": -1.0}),
    ("1 > bool 2", {"": 0.0}),
    ("2 ^ 3 ^ 0", {"": 2.0}),
    ("nums / 0", {"x=a": math.inf}),
    ("nums > 5", {"__name__=nums,x=a": 11.0}),
    ("5 < nums", {"__name__=nums,x=a": 11.0}),
    ("nums == bool 11", {"x=a": 1.0}),
    ("odd == 1", {"__name__=odd,x=one": 1.0}),
    ("odd != 1", {"__name__=odd,x=nan": math.nan, "__name__=odd,x=inf": math.inf}),
    ("nums + on(x) resets offset 20m", {"x=a": 14.0}),
    ("sum by (job) (http_requests) / ignoring(group, instance) group_right http_requests{instance='1'}", {"group=production,instance=1,job=api": 3.0, "group=canary,instance=1,job=app": 1300 / 800}),
    ("http_requests{group='canary'} and on(job) http_requests{instance='1', group='production'}", {"__name__=http_requests,group=canary,instance=0,job=api": 300.0}),
    ("http_requests{group='canary'} unless on(job) http_requests{instance='1', group='production'}", {"__name__=http_requests,group=canary,instance=1,job=app": 800.0}),
    ("nums or vector(1)", {"__name__=nums,x=a": 11.0, "": 1.0}),
    ("abs(-nums)", {"x=a": 11.0}),
    ("ln(nums - 11)", {"x=a": -math.inf}),
    ("ceil(nums / 2)", {"x=a": 6.0}),
    ("round(nums / 4, 0.5)", {"x=a": 3.0}),
    ("clamp(nums, 1, 5)", {"x=a": 5.0}),
    ("clamp_min(odd, 5)", {"x=nan": math.nan, "x=inf": math.inf, "x=one": 5.0}),
    ("sgn(odd)", {"x=nan": math.nan, "x=inf": 1.0, "x=one": 1.0}),
    ("timestamp(nums)", {"x=a": 3000.0}),
    ("time()", {"": 3000.0}),
    ("scalar(nums)", {"": 11.0}),
    ("scalar(http_requests)", {"": math.nan}),
    ("vector(3)", {"": 3.0}),
    ("minute()", {"": 50.0}),
    ("day_of_week(vector(1136239445))", {"": 1.0}),
    ("days_in_month(vector(1454284800))", {"": 29.0}),
    ("year(vector(1136239445)) + hour(vector(1136239445))", {"": 2028.0}),
    ("histogram_quantile(0.5, b_bucket)", {"": 0.1 + 0.1 * 0.5}),
    ("histogram_quantile(0.9, b_bucket)", {"": 1.0}),
    ("histogram_fraction(0, 0.2, b_bucket)", {"": 0.75}),
    ("label_replace(nums, 'y', '$1-z', 'x', '(.*)')", {"__name__=nums,x=a,y=a-z": 11.0}),
    ("label_replace(nums, 'x', '', 'x', 'a')", {"__name__=nums": 11.0}),
    ("label_join(nums, 'y', '-', 'x', 'x')", {"__name__=nums,x=a,y=a-a": 11.0}),
    ('{__name__=~"nu.*", x!=""}', {"__name__=nums,x=a": 11.0}),
    ("sum(nums) by (x) * 2", {"x=a": 22.0}),
    ("sort(nums)", {"__name__=nums,x=a": 11.0}),
    ("rad(vector(180)) == pi()", {"": math.pi}),
]


@pytest.mark.parametrize("query,want", CASES, ids=[c[0] for c in CASES])
def test_instant(spark, s, query, want):
    got = run(spark, s, query, "50m")
    check(got, want)


def test_stale_and_gap(spark, s):
    assert run(spark, s, "gaps", "35m") == {}
    assert run(spark, s, "gaps", "14m") == {"__name__=gaps,x=a": 3.0}
    assert run(spark, s, "gaps", "15m") == {}


def test_range_query(spark, s):
    got = run(spark, s, "nums + 1", "0", "50m", "10m")
    assert got == {"x=a": {0: 2.0, 600: 4.0, 1200: 6.0, 1800: 8.0, 2400: 10.0, 3000: 12.0}}
    got = run(spark, s, "sum(nums @ end())", "0", "20m", "10m")
    assert got == {"": {0: 5.0, 600: 5.0, 1200: 5.0}}


@pytest.mark.parametrize("query", ["nums + on() http_requests", "http_requests * on(job) http_requests", "label_replace(http_requests, 'instance', 'x', '', '')"])
def test_too_many_partners_raise(spark, s, query):
    with pytest.raises(Exception, match="match|duplicate|labelset"):
        run(spark, s, query, "50m")


@pytest.mark.parametrize("query", ["", "nums[5m]", "{}", '{a=""}', "1 == 2", "sum(", "rate(nums)", "'x'", "foo(1)", "nums and 1", "topk(nums)", "limitk(1, nums)", 'x{a="1" or b="2"}', "nums[5m] offset", "quantile(scalar(nums), nums)"])
def test_errors(spark, s, query):
    with pytest.raises(QueryError):
        run(spark, s, query, "50m")


H = {"schema": 0, "zero_threshold": 0.001, "zero_count": 1.0, "count": 7.0, "sum": 20.0, "positive": [{"index": 1, "count": 2.0}, {"index": 2, "count": 4.0}], "negative": [], "custom_values": [], "hint": "UNKNOWN"}
H2 = {**H, "count": 14.0, "sum": 40.0, "zero_count": 2.0, "positive": [{"index": 1, "count": 4.0}, {"index": 2, "count": 8.0}]}


@pytest.fixture(scope="module")
def h(spark):
    rows = [({"__name__": "h", "i": "a"}, 0, H), ({"__name__": "h", "i": "a"}, 60_000, H2), ({"__name__": "h", "i": "b"}, 60_000, H)]
    return load(spark, "1m", 'f{i="a"} 1 2', rows).cache()


def test_native_histograms(spark, h):
    check(run(spark, h, "histogram_count(h)", "1m"), {"i=a": 14.0, "i=b": 7.0})
    check(run(spark, h, "histogram_sum(h)", "1m"), {"i=a": 40.0, "i=b": 20.0})
    check(run(spark, h, "histogram_avg(h)", "1m"), {"i=a": 40 / 14, "i=b": 20 / 7})
    check(run(spark, h, "histogram_count(sum(h))", "1m"), {"": 21.0})
    check(run(spark, h, "histogram_count(avg(h))", "1m"), {"": 10.5})
    check(run(spark, h, "histogram_count(increase(h[2m]))", "1m"), {"i=a": 14.0})
    check(run(spark, h, "histogram_count(h * 2)", "1m"), {"i=a": 28.0, "i=b": 14.0})
    check(run(spark, h, "histogram_count(h + h)", "1m"), {"i=a": 28.0, "i=b": 14.0})
    check(run(spark, h, "histogram_quantile(1, h)", "1m"), {"i=a": 4.0, "i=b": 4.0})
    assert set(run(spark, h, "h == h", "1m")) == {"__name__=h,i=a", "__name__=h,i=b"}
    check(run(spark, h, "count_over_time(h[2m])", "1m"), {"i=a": 2.0, "i=b": 1.0})
    check(run(spark, h, "histogram_fraction(0, 2, h)", "1m"), {"i=a": 3 / 7, "i=b": 3 / 7})
    check(run(spark, h, "count(h)", "1m"), {"": 2.0})
    check(run(spark, h, "f + 1", "1m"), {"i=a": 3.0})


def test_windows_that_mix_floats_and_histograms(spark):
    """Going from one kind to the other counts as a reset and a change; the last two samples decide the instant rates."""
    m, n, o = ({"__name__": x, "i": "a"} for x in "mno")
    rows = [(m, 60_000, H), (m, 180_000, H2), (n, 120_000, H), (n, 180_000, H2), (o, 0, H)]
    mixed = load(spark, "1m", 'm{i="a"} 1 _ 3 _ 2\nn{i="a"} 5 7 _ _\no{i="a"} _ 4 6 5', rows)
    at = lambda query: run(spark, mixed, query, "4m")
    check(at("resets(m[5m])"), {"i=a": 4.0})
    check(at("changes(m[5m])"), {"i=a": 4.0})
    check(at("changes(n[5m])"), {"i=a": 3.0})  # 5 to 7, to a histogram, to another one
    check(at("resets(n[5m])"), {"i=a": 1.0})
    check(at("resets(o[5m])"), {"i=a": 2.0})  # from a histogram to 4, 6 to 5
    assert at("irate(m[5m])") == {} and at("idelta(m[5m])") == {}  # the last two are of different kinds
    check(at("histogram_count(irate(n[5m]))"), {"i=a": 7 / 60})
    check(at("idelta(o[5m])"), {"i=a": -1.0})
    check(at("count_over_time(m[5m])"), {"i=a": 5.0})
    assert at("rate(m[5m])") == {}


def test_parser_shapes():
    assert parse("a - b - c").right.matchers == [("__name__", "=", "c")]
    assert parse("a ^ b ^ c").left.matchers == [("__name__", "=", "a")]
    assert parse("sum by (x) (a)").labels == ["x"]
    assert parse("a:b:c").matchers == [("__name__", "=", "a:b:c")]
    assert parse("x[1h30m] offset -5m").offset_ms == -300_000


def test_hourly_windows_see_every_sample(spark):
    from skein import catalog

    d = "/root/testdata/sf0.001"
    good = catalog.sample_view(spark, d).filter(~F.coalesce("stale", F.lit(False)) & (F.col("ts_ms") > catalog.START - catalog.HOUR) & (F.col("ts_ms") <= catalog.END))
    seen = catalog.QUERIES["promql_count_over_time_1h"](spark, d).agg(F.sum("value")).collect()[0][0]
    assert seen == good.count()
