"""Tiny loader for metric cases: 'name{labels} values' lines at a fixed interval."""

from __future__ import annotations

import math
import re

from skein.functions.histograms import HISTOGRAM
from skein.plans.promql.parser import duration_ms, parse
from skein.plans.promql.compile import evaluate

SCHEMA = f"labels array<struct<name:string,value:string>>, ts_ms bigint, value double, stale boolean, hist {HISTOGRAM}"


def values(text: str):
    for word in text.split():
        if m := re.fullmatch(r"_(?:x(\d+))?", word):
            for _ in range(int(m[1] or 1)):
                yield None
        elif word == "stale":
            yield "stale"
        elif m := re.fullmatch(r"([-+\w.]+?)(?:([-+][\d.]+))?x(\d+)", word):
            for i in range(int(m[3]) + 1):
                yield float(m[1]) + i * float(m[2] or 0)
        else:
            yield float(word)


def load(spark, interval: str, text: str, hists=()):
    step, rows = duration_ms(interval), []
    for line in filter(None, map(str.strip, text.splitlines())):
        m = re.match(r"([\w:]*(?:\{[^}]*\})?)\s+(.*)", line)
        labels = sorted((n, v) for n, _, v in parse(m[1]).matchers)
        for i, v in enumerate(values(m[2])):
            if v is not None:
                rows.append((labels, i * step, math.nan if v == "stale" else v, v == "stale", None))
    rows += [(sorted(ls.items()), ts, None, False, h) for ls, ts, h in hists]
    return spark.createDataFrame(rows, SCHEMA)


def run(spark, samples, query, at="0s", end=None, step="1m"):
    """{labels as text: value}, or {labels: {step seconds: value}} of a range query."""
    ms = lambda t: duration_ms(t) if t != "0" else 0
    df = evaluate(spark, samples, query, ms(at), None if end is None else ms(end), ms(step))
    out = {}
    for r in df.collect():
        key = ",".join(f"{x.name}={x.value}" for x in r.labels)
        value = r.value if r.hist is None else r.hist.asDict(recursive=True)
        if end is None:
            assert key not in out
            out[key] = value
        else:
            out.setdefault(key, {})[r.step / 1000] = value
    return out
