"""Numbers as text, and text as numbers, the way the query languages write them."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def format_float(x: float) -> str:
    """Shortest decimal form without an exponent; +Inf, -Inf and NaN by name."""
    if x != x:
        return "NaN"
    if x in (np.inf, -np.inf):
        return "+Inf" if x > 0 else "-Inf"
    return np.format_float_positional(x, trim="-")


@F.pandas_udf(T.StringType())
def go_float(x: pd.Series) -> pd.Series:
    return x.map(format_float)


# Units of byte sizes and of durations.
BYTES = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "pb": 10**15, "eb": 10**18, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "p": 10**15, "e": 10**18, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "pib": 2**50, "eib": 2**60, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40, "pi": 2**50, "ei": 2**60}
SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86_400.0, "w": 604_800.0, "y": 31_536_000.0}


def parse_bytes(text: str) -> float | None:
    m = re.fullmatch(r"\s*([\d,]*\.?\d+|\d+\.)\s*([A-Za-z]*)\s*", text or "")
    unit = BYTES.get(m[2].lower()) if m else None
    return None if unit is None else float(int(float(m[1].replace(",", "")) * unit))


def parse_duration(text: str) -> float | None:
    """Seconds of a duration like 1h2m3.5s or -10ms; None if it is none."""
    m = re.fullmatch(r"([+-]?)((?:(?:\d+\.?\d*|\.\d+)(?:ns|us|µs|μs|ms|[smhdwy]))+|0)", text or "")
    if not m:
        return None
    total = sum(float(n) * SECONDS[u] for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|[smhdwy])", m[2]))
    return -total if m[1] == "-" else total


def parse_float(text: str) -> float | None:
    try:
        t = (text or "").replace("_", "x")
        return float(t) if t.strip() == t and t else None
    except ValueError:
        return None
