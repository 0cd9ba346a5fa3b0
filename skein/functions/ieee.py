"""IEEE-754 arithmetic as Spark columns: Spark raises, saturates or returns null where the query languages don't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def num(x: float) -> Column:
    return F.lit(float(x))


def div(a: Column, b: Column) -> Column:
    """a / b with x/0 = ±Inf and 0/0 = NaN; the sign of a zero divisor counts."""
    below = b.cast("string") == "-0.0"
    zero = F.when(F.isnan(a) | (a == 0), num(NAN)).when((a > 0) != below, num(INF)).otherwise(num(-INF))
    return F.when(F.isnan(a) | F.isnan(b), num(NAN)).when(b == 0, zero).otherwise(a / F.when(b == 0, num(1)).otherwise(b))


def mod(a: Column, b: Column) -> Column:
    """Remainder with the dividend's sign; x % 0 and Inf % x are NaN, x % Inf is x."""
    bad = F.isnan(a) | F.isnan(b) | (b == 0) | (F.abs(a) == INF)
    safe = F.when(bad | (F.abs(b) == INF), num(1)).otherwise(b)
    return F.when(bad, num(NAN)).when(F.abs(b) == INF, a).otherwise(F.when(bad, num(0)).otherwise(a) % safe)


def power(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def comparison(op: str, a: Column, b: Column) -> Column:
    """Never null; NaN compares false but for !=."""
    a, b = F.coalesce(a, num(NAN)), F.coalesce(b, num(NAN))
    nan = F.isnan(a) | F.isnan(b)
    plain = {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return F.when(nan, F.lit(op == "!=")).otherwise(plain)


def log(kind: str, x: Column) -> Column:
    """ln, log2 or log10 with log(0) = -Inf and NaN below zero."""
    f = {"ln": F.ln, "log2": F.log2, "log10": F.log10}[kind]
    return F.when(F.isnan(x) | (x < 0), num(NAN)).when(x == 0, num(-INF)).when(x == INF, num(INF)).otherwise(f(F.when(x > 0, x).otherwise(num(1))))


def _whole(f, x: Column) -> Column:
    small = F.abs(x) < float(2**53)
    return F.when(small, f(F.when(small, x).otherwise(num(0))).cast("double")).otherwise(x)


def floor(x: Column) -> Column:
    return _whole(F.floor, x)


def ceil(x: Column) -> Column:
    return _whole(F.ceil, x)


def least_nan(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x) | F.isnan(y), num(NAN)).otherwise(F.least(x, y))


def greatest_nan(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x) | F.isnan(y), num(NAN)).otherwise(F.greatest(x, y))


def minimum(x: Column) -> Column:
    """Aggregate: NaN only if all are NaN (NaN is largest in Spark)."""
    return F.min(x)


def maximum(x: Column) -> Column:
    """Aggregate: NaN only if all are NaN."""
    return F.coalesce(F.max(F.when(~F.isnan(x), x)), F.max(x))


def quantile(q: float, x: Column, nan_q: float = NAN) -> Column:
    """Aggregate: linear interpolation over sorted values, NaN first. q < 0: -Inf, q > 1: +Inf, NaN: ``nan_q``.

    ``percentile`` keeps a count per distinct value and merges partials, so no group is collected.
    """
    if q != q:
        return F.when(F.count(x) > 0, num(nan_q))
    if q < 0 or q > 1:
        return F.when(F.count(x) > 0, num(-INF if q < 0 else INF))
    nans = F.sum(F.when(F.isnan(x), 1).otherwise(0))
    low = F.floor(num(q) * (F.count(x) - 1))
    return F.when(low < nans, num(NAN)).otherwise(F.percentile(F.when(F.isnan(x), num(-INF)).otherwise(x), F.lit(q)))
