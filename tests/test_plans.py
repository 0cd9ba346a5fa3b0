"""Filters that must reach the scan, seen in the plans."""

import re

import pytest

from skein import model
from skein.plans.logql.compile import query_logs
from skein.plans.promql.compile import evaluate
from skein.plans.traceql.compile import matched_spans

DATA = "/root/testdata/sf0.001"
DAY = 1_736_121_600_000


@pytest.fixture(autouse=True)
def whole_strings(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_logs(spark):
    df = query_logs(spark, model.log_entries(spark, DATA), '{namespace="prod-ledger"} |= "lease"', DAY * 10**6, (DAY + 3_600_000) * 10**6)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for part in (f"GreaterThanOrEqual(timestamp_ns,{DAY * 10**6})", "EqualTo(namespace,prod-ledger)", "StringContains(line,lease)"):
        assert part in plan, part


def test_metrics(spark):
    df = evaluate(spark, model.metric_samples(spark, DATA), '{namespace="prod-ledger"}', DAY, DAY + 3_600_000, 60_000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for part in (f"GreaterThan(timestamp_ms,{DAY - 300_000})", f"LessThanOrEqual(timestamp_ms,{DAY + 3_600_000})", "EqualTo(namespace,prod-ledger)"):
        assert part in plan, part


def test_traces(spark):
    df = matched_spans(model.spans(spark, DATA, DAY * 10**6, (DAY + 3_600_000) * 10**6), "{ status = error }")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"GreaterThanOrEqual\(start_time,2025-01-06T00:00", plan) and re.search(r"LessThan\(start_time,2025-01-06T01:00", plan)


@pytest.mark.parametrize("text", ["a<_>", "<_>b", "a<_>b<_>", "plain"])
def test_pattern_filters_run_as_columns(spark, text):
    df = query_logs(spark, model.log_entries(spark, DATA), '{namespace=~".+"} |> `%s`' % text, DAY * 10**6, (DAY + 3_600_000) * 10**6)
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
