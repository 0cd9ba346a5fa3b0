"""Native histograms (exponential and custom buckets) and classic bucket quantiles.

A histogram is a struct with sparse buckets (arrays of index and count). Algebra on it has no built-in Spark twin, so it
runs in Arrow UDFs over whole column batches; windows and groups reach a UDF as arrays that are bounded by the
window, or as partial sums.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = "array<struct<index:int,count:double>>"
HISTOGRAM = (
    "struct<schema:int,zero_threshold:double,zero_count:double,count:double,sum:double,"
    f"positive:{BUCKETS},negative:{BUCKETS},custom_values:array<double>,hint:string>"
)
#: Schema number of histograms with custom bounds.
CUSTOM = -53
#: Groups are summed in this many parts first.
SALT = 32
_B = T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("count", T.DoubleType())]))
STRUCT = T.StructType([T.StructField("schema", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in ("zero_threshold", "zero_count", "count", "sum")], T.StructField("positive", _B), T.StructField("negative", _B), T.StructField("custom_values", T.ArrayType(T.DoubleType())), T.StructField("hint", T.StringType())])


class Hist:
    """One histogram: schema, zero bucket, count, sum, {index: count} of either sign, custom bounds."""

    __slots__ = ("schema", "zt", "zc", "count", "sum", "pos", "neg", "custom", "hint")

    def __init__(self, d):
        self.schema, self.zt, self.zc, self.count, self.sum = int(d["schema"]), d["zero_threshold"] or 0.0, d["zero_count"] or 0.0, d["count"] or 0.0, d["sum"] if d["sum"] is not None else math.nan
        self.pos, self.neg = ({int(b["index"]): b["count"] for b in (d[k] if d[k] is not None else [])} for k in ("positive", "negative"))
        self.custom = tuple(d["custom_values"] if d["custom_values"] is not None else ())
        self.hint = d["hint"]

    def row(self) -> dict:
        bs = lambda m: [{"index": i, "count": c} for i, c in sorted(m.items())]
        return {"schema": self.schema, "zero_threshold": self.zt, "zero_count": self.zc, "count": self.count, "sum": self.sum, "positive": bs(self.pos), "negative": bs(self.neg), "custom_values": list(self.custom), "hint": self.hint}

    def copy(self) -> Hist:
        return Hist(self.row())

    def coarser(self, schema: int) -> Hist:
        h = self.copy()
        if schema < self.schema and self.schema != CUSTOM:
            step = self.schema - schema
            for name in ("pos", "neg"):
                out: dict[int, float] = {}
                for i, c in getattr(self, name).items():
                    j = ((i - 1) >> step) + 1
                    out[j] = out.get(j, 0.0) + c
                setattr(h, name, out)
            h.schema = schema
        return h

    def widened(self, zt: float) -> Hist:
        """Zero bucket grown to ``zt``: buckets that lie below it move in."""
        h = self.copy()
        if zt <= self.zt:
            return h
        base = 2.0 ** (2.0**-self.schema)
        for name in ("pos", "neg"):
            kept = {}
            for i, c in getattr(self, name).items():
                if base**i <= zt * (1 + 1e-12):
                    h.zc += c
                else:
                    kept[i] = c
            setattr(h, name, kept)
        h.zt = zt
        return h

    def add(self, other: Hist, sign: float = 1.0) -> Hist | None:
        """Sum (or difference) at the coarser schema; None if custom bounds meet exponential ones or differ."""
        if (self.schema == CUSTOM) != (other.schema == CUSTOM) or self.custom != other.custom:
            return None
        schema = min(self.schema, other.schema)
        zt = max(self.zt, other.zt)
        a, b = self.coarser(schema), other.coarser(schema)
        if schema != CUSTOM:
            a, b = a.widened(zt), b.widened(zt)
        a.zc += sign * b.zc
        a.count += sign * b.count
        a.sum += sign * b.sum
        for mine, theirs in ((a.pos, b.pos), (a.neg, b.neg)):
            for i, c in theirs.items():
                mine[i] = mine.get(i, 0.0) + sign * c
        a.hint = "GAUGE" if sign < 0 else a.hint
        return a

    def times(self, x: float) -> Hist:
        h = self.copy()
        h.zc, h.count, h.sum = h.zc * x, h.count * x, h.sum * x
        h.pos, h.neg = {i: c * x for i, c in h.pos.items()}, {i: c * x for i, c in h.neg.items()}
        return h

    def same(self, other: Hist) -> bool:
        clean = lambda m: {i: c for i, c in m.items() if c}
        eq = lambda x, y: x == y or (x != x and y != y)
        return self.schema == other.schema and self.custom == other.custom and self.zt == other.zt and self.zc == other.zc and eq(self.count, other.count) and eq(self.sum, other.sum) and clean(self.pos) == clean(other.pos) and clean(self.neg) == clean(other.neg)

    def reset_from(self, before: Hist) -> bool:
        """Whether a counter histogram was reset between ``before`` and this one."""
        if self.hint == "RESET":
            return True
        if self.count < before.count or self.schema > before.schema or self.custom != before.custom or self.zt < before.zt or self.schema == CUSTOM != before.schema:
            return True
        old = before.coarser(self.schema).widened(self.zt) if self.schema != CUSTOM else before
        return self.zc < old.zc or any(self.pos.get(i, 0.0) < c for i, c in old.pos.items()) or any(self.neg.get(i, 0.0) < c for i, c in old.neg.items())

    def bounds(self, i: int) -> tuple[float, float]:
        if self.schema == CUSTOM:
            n = len(self.custom)
            return (self.custom[i - 1] if 0 < i <= n else -math.inf), (self.custom[i] if i < n else math.inf)
        k = 2.0**-self.schema
        return 2.0 ** ((i - 1) * k), 2.0 ** (i * k)

    def buckets(self) -> list[tuple[float, float, float]]:
        """(lower, upper, count), ascending."""
        out = []
        for i in sorted(self.neg, reverse=True):
            low, high = self.bounds(i)
            out.append((-high, -low, self.neg[i]))
        if self.zc:
            out.append((-self.zt if self.neg or not self.pos else 0.0, self.zt if self.pos or not self.neg else 0.0, self.zc))
        for i in sorted(self.pos):
            low, high = self.bounds(i)
            if self.schema == CUSTOM and i == 0:
                low = 0.0 if self.custom and self.custom[0] > 0 else -math.inf
            out.append((low, high, self.pos[i]))
        return [b for b in out if b[2]]

    def _inside(self, low: float, high: float, share: float) -> float:
        if self.schema == CUSTOM or low <= 0 <= high:
            if math.isinf(low):
                return high
            return low if math.isinf(high) else low + (high - low) * share
        if low > 0:
            return 2.0 ** (math.log2(low) + (math.log2(high) - math.log2(low)) * share)
        return -(2.0 ** (math.log2(-low) + (math.log2(-high) - math.log2(-low)) * share))

    def quantile(self, q: float) -> float:
        if q != q or not self.count:
            return math.nan
        if q < 0 or q > 1:
            return -math.inf if q < 0 else math.inf
        bs = self.buckets()
        if not bs:
            return math.nan
        rank, seen = q * (sum(b[2] for b in bs) if self.sum != self.sum else self.count), 0.0
        for low, high, c in bs:
            seen += c
            if seen >= rank:
                return self._inside(low, high, (rank - (seen - c)) / c)
        return bs[-1][1] if not math.isinf(bs[-1][1]) else bs[-1][0]

    def rank(self, x: float) -> float:
        total = 0.0
        for low, high, c in self.buckets():
            if high <= x:
                total += c
            elif low < x:
                if self.schema == CUSTOM or low <= 0 <= high:
                    share = 1.0 if math.isinf(low) else 0.0 if math.isinf(high) else (x - low) / (high - low)
                elif low > 0:
                    share = (math.log2(x) - math.log2(low)) / (math.log2(high) - math.log2(low))
                else:
                    share = (math.log2(-low) - math.log2(-x)) / (math.log2(-low) - math.log2(-high))
                total += c * share
        return total

    def fraction(self, low: float, high: float) -> float:
        if not self.count or low != low or high != high:
            return math.nan
        return 0.0 if low >= high else (self.rank(high) - self.rank(low)) / self.count

    def stdvar(self) -> float:
        if not self.count:
            return math.nan
        mean, total = self.sum / self.count, 0.0
        for low, high, c in self.buckets():
            if low <= 0 <= high:
                mid = 0.0 if self.schema != CUSTOM else (low + high) / 2
            elif self.schema == CUSTOM:
                mid = high if math.isinf(low) else low if math.isinf(high) else (low + high) / 2
            else:
                mid = math.sqrt(low * high) * (1 if low > 0 else -1)
            total += c * (mid - mean) ** 2
        return total / self.count


def _of(x) -> Hist | None:
    return None if x is None or (isinstance(x, float)) else Hist(x)


def read(name: str, hist: Column, a: float = 0.0, b: float = 0.0) -> Column:
    """histogram_count, _sum and _avg are struct fields; the others need the buckets."""
    count, total = hist["count"], hist["sum"]
    if name == "histogram_count":
        return count
    if name == "histogram_sum":
        return total
    if name == "histogram_avg":
        from skein.functions import ieee

        return ieee.div(total, count)

    @F.pandas_udf(T.DoubleType())
    def run(h: pd.DataFrame) -> pd.Series:
        f = {
            "histogram_stdvar": lambda x: x.stdvar(), "histogram_stddev": lambda x: math.sqrt(x.stdvar()) if x.stdvar() == x.stdvar() else math.nan,
            "histogram_quantile": lambda x: x.quantile(a), "histogram_fraction": lambda x: x.fraction(a, b),
        }[name]
        return pd.Series([f(Hist(r)) for r in h.to_dict("records")], dtype=float)

    return run(hist)


def classic(what: str, a: float, b: float):
    """UDF over sorted bounds and cumulative counts of one label set; null if there is no +Inf bucket."""

    def merged(bounds, counts) -> tuple[list[float], list[float]] | None:
        bs: dict[float, float] = {}
        for x, c in zip(bounds, counts, strict=True):
            bs[float(x)] = bs.get(float(x), 0.0) + float(c)
        xs = sorted(bs)
        if len(xs) < 2 or not math.isinf(xs[-1]):
            return None
        cs, top = [], -math.inf
        for x in xs:
            c = bs[x]
            top = c if top == -math.inf or (c > top and c - top > 1e-12 * abs(c)) else top
            cs.append(top)
        return xs, cs

    def quantile(bounds, counts) -> float | None:
        m = merged(bounds, counts)
        if a != a:
            return math.nan
        if a < 0 or a > 1:
            return -math.inf if a < 0 else math.inf
        if m is None:
            return math.nan
        xs, cs = m
        if not cs[-1]:
            return math.nan
        rank = a * cs[-1]
        i = next((k for k in range(len(xs) - 1) if cs[k] >= rank), len(xs) - 1)
        if i == len(xs) - 1:
            return xs[-2]
        if i == 0 and xs[0] <= 0:
            return xs[0]
        low, before = (xs[i - 1], cs[i - 1]) if i else (0.0, 0.0)
        return low + (xs[i] - low) * ((rank - before) / (cs[i] - before)) if cs[i] > before else xs[i]

    def fraction(bounds, counts) -> float | None:
        m = merged(bounds, counts)
        if m is None or not m[1][-1] or a != a or b != b:
            return math.nan
        if a >= b:
            return 0.0
        xs, cs = m

        def rank(x: float) -> float:
            low, before = (0.0, 0.0) if xs[0] > 0 else (-math.inf, 0.0)
            for k, hi in enumerate(xs):
                if x <= low:
                    return before
                if x < hi:
                    share = 0.0 if math.isinf(hi) else 1.0 if math.isinf(low) else (x - low) / (hi - low)
                    return before + (cs[k] - before) * share
                low, before = hi, cs[k]
            return cs[-1]

        return (rank(b) - rank(a)) / cs[-1]

    f = quantile if what == "quantile" else fraction

    @F.pandas_udf(T.DoubleType())
    def run(bounds: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([f(x, c) for x, c in zip(bounds, counts, strict=True)], dtype=float)

    return run


ROLLUPS = {"rate", "increase", "delta", "irate", "idelta", "sum_over_time", "avg_over_time", "last_over_time", "count_over_time", "present_over_time", "resets", "changes"}


def _window(name: str, hs: list[Hist], ts: list[int], after: list[bool], eff: int, range_ms: int) -> tuple[Hist | None, float | None]:
    """``after``: which histograms follow a float within the window; going from one kind to the other is a change."""
    if name == "count_over_time":
        return None, float(len(hs))
    if name == "present_over_time":
        return None, 1.0
    if name == "last_over_time":
        return hs[-1], None
    if name == "resets":
        return None, float(sum(x or (i > 0 and hs[i].reset_from(hs[i - 1])) for i, x in enumerate(after)))
    if name == "changes":
        return None, float(sum(x or (i > 0 and not hs[i].same(hs[i - 1])) for i, x in enumerate(after)))
    if name in ("sum_over_time", "avg_over_time"):
        total = hs[0]
        for h in hs[1:]:
            total = total.add(h) if total else None
        return (total.times(1 / len(hs)) if total and name == "avg_over_time" else total), None
    if len(hs) < 2:
        return None, None
    if name in ("irate", "idelta"):
        if after[-1]:
            return None, None
        a, b = hs[-2], hs[-1]
        out = b if name == "irate" and b.reset_from(a) else b.add(a, -1.0)
        return (out.times(1000 / (ts[-1] - ts[-2])) if out and name == "irate" else out), None
    out = hs[-1].add(hs[0], -1.0)
    if name != "delta":
        for a, b in zip(hs, hs[1:], strict=False):
            if out and b.reset_from(a):
                out = out.add(a)
    if out is None:
        return None, None
    sampled = (ts[-1] - ts[0]) / 1000
    every = sampled / (len(hs) - 1)
    start, end = (ts[0] - (eff - range_ms)) / 1000, (eff - ts[-1]) / 1000
    start = every / 2 if start >= every * 1.1 else start
    if name != "delta" and out.count > 0 and hs[0].count >= 0:
        start = min(start, sampled * hs[0].count / out.count)
    end = every / 2 if end >= every * 1.1 else end
    factor = (sampled + start + end) / sampled / (range_ms / 1000 if name == "rate" else 1)
    return out.times(factor), None


def rollup(w, name: str, own: list[str]) -> DataFrame | None:
    """labels, step, hist, hvalue, t1, n of windows that hold histograms; the window's array bounds the group."""
    if name not in ROLLUPS:
        return None
    rows = w.df.filter(F.col("hist").isNotNull())
    g = rows.groupBy(*own, "step", "eff").agg(F.array_sort(F.collect_list(F.struct("ts", "hist", F.col("pv").isNotNull().alias("after")))).alias("w"), F.max("ts").alias("t1"))
    kind = T.StructType([T.StructField("hist", STRUCT), T.StructField("value", T.DoubleType())])
    range_ms = w.range_ms

    @F.pandas_udf(kind)
    def run(arr: pd.Series, eff: pd.Series) -> pd.DataFrame:
        out = []
        for items, e in zip(arr, eff, strict=True):
            h, v = _window(name, [Hist(i["hist"]) for i in items], [int(i["ts"]) for i in items], [bool(i["after"]) for i in items], int(e), range_ms)
            out.append((h.row() if h else None, v))
        return pd.DataFrame({"hist": pd.Series([o[0] for o in out], dtype=object), "value": pd.Series([o[1] for o in out], dtype=float)})

    return g.withColumn("o", run("w", "eff")).select(*own, "step", "t1", F.size("w").alias("n"), F.col("o.hist").alias("hist"), F.nanvl(F.col("o.value"), F.lit(None).cast("double")).alias("hvalue"))


def join_rollup(floats: DataFrame, hists: DataFrame | None, name: str, own: list[str]) -> DataFrame:
    """Cells of windows with floats and with histograms. Mixed windows: counts add up, the newest kind wins where one or
    two samples decide, others are absent."""
    none = F.lit(None).cast(HISTOGRAM)
    if "t1" not in floats.columns:
        floats = floats.withColumn("t1", F.lit(None).cast("bigint"))
    if hists is None:
        return floats.filter(F.col("value").isNotNull()).select("labels", "step", "value", none.alias("hist"))
    both = floats.join(hists.withColumnsRenamed({"t1": "t2"}), [*own, "step"], "full_outer")
    if name in ("last_over_time", "irate", "idelta"):
        newer = F.col("t2").isNotNull() & (F.coalesce("t1", F.lit(-(2**62))) < F.col("t2"))
        out = both.select("labels", "step", F.when(~newer, F.col("value")).alias("value"), F.when(newer, F.col("hist")).alias("hist"))
        return out.filter(F.col("value").isNotNull() | F.col("hist").isNotNull())
    if name in ("count_over_time", "resets", "changes"):
        return both.select("labels", "step", (F.coalesce("value", F.lit(0.0)) + F.coalesce("hvalue", F.lit(0.0))).alias("value"), none.alias("hist"))
    if name == "present_over_time":
        return both.select("labels", "step", F.lit(1.0).alias("value"), none.alias("hist"))
    mixed = F.col("value").isNotNull() & F.col("t2").isNotNull()
    kept = both.filter(~mixed & (F.col("value").isNotNull() | F.col("hist").isNotNull()))
    return kept.select("labels", "step", "value", "hist")


def _sum_udf():
    @F.pandas_udf(T.StructType([T.StructField("hist", STRUCT), T.StructField("n", T.LongType())]))
    def run(arr: pd.Series) -> pd.DataFrame:
        out = []
        for items in arr:
            total, n = None, 0
            for k, i in enumerate(items):
                h = _of(i["hist"])
                n += int(i["n"])
                total = h if k == 0 else total.add(h) if total and h else None
            out.append((total.row() if total else None, n))
        return pd.DataFrame({"hist": pd.Series([o[0] for o in out], dtype=object), "n": [o[1] for o in out]})

    return run


def aggregate(floats: DataFrame, hists: DataFrame, op: str) -> DataFrame:
    """sum and avg of histograms per (labels, step), in salted parts; groups with floats and histograms are absent."""
    run = _sum_udf()
    part = F.pmod(F.xxhash64(F.col("hist.count"), F.col("hist.sum"), F.monotonically_increasing_id()), F.lit(SALT))
    one = hists.withColumns({"_p": part, "n": F.lit(1).cast("bigint")})
    parts = one.groupBy("labels", "step", "_p").agg(F.collect_list(F.struct("hist", "n")).alias("w")).withColumn("o", run("w")).select("labels", "step", "o.*")
    whole = parts.groupBy("labels", "step").agg(F.collect_list(F.struct("hist", "n")).alias("w")).withColumn("o", run("w")).select("labels", "step", "o.hist", "o.n")
    if op == "avg":
        whole = scaled(whole.withColumns({"value": F.lit(0.0)}), "/", F.col("n").cast("double"))
    both = floats.drop("hist").join(whole.select("labels", "step", "hist", F.lit(True).alias("_h")), ["labels", "step"], "full_outer")
    kept = both.filter(F.col("value").isNull() | F.col("_h").isNull()).filter(F.col("value").isNotNull() | F.col("hist").isNotNull())
    return kept.select("labels", "step", "value", "hist", F.col("step").alias("src_ts"))


def scaled(df: DataFrame, op: str, by: Column) -> DataFrame:
    @F.pandas_udf(STRUCT)
    def run(h: pd.DataFrame, x: pd.Series) -> pd.DataFrame:
        factor = lambda v: v if op == "*" else (1 / v if v else math.nan)
        return pd.DataFrame([Hist(r).times(factor(v)).row() for r, v in zip(h.to_dict("records"), x, strict=True)], columns=STRUCT.names)

    return df.withColumn("hist", run("hist", by))


def binary(out: DataFrame, both: DataFrame, op: str, as_bool: bool, swapped: bool) -> DataFrame:
    """Adds h + h, h - h, h * s, s * h, h / s, h == h and h != h to the float results; other mixes are absent."""
    a, va, b, vb = (F.col(c) for c in (("_hist", "_value", "hist", "value") if swapped else ("hist", "value", "_hist", "_value")))
    kind = T.StructType([T.StructField("hist", STRUCT), T.StructField("value", T.DoubleType())])

    @F.pandas_udf(kind)
    def run(pairs: pd.Series) -> pd.DataFrame:
        rows = []
        for w in pairs:
            x, y = (_of(i["hist"]) for i in w)
            s, t = (i["value"] for i in w)
            h = v = None
            if x and y:
                if op in ("+", "-"):
                    h = x.add(y, 1.0 if op == "+" else -1.0)
                elif op in ("==", "!="):
                    ok = x.same(y) == (op == "==")
                    h, v = (None, float(ok)) if as_bool else (x if ok else None, None)
            elif op == "*":
                h = x.times(t) if x else y.times(s)
            elif op == "/" and x:
                h = x.times(1 / t if t else math.nan)
            rows.append((h.row() if h else None, v))
        return pd.DataFrame({"hist": pd.Series([r[0] for r in rows], dtype=object), "value": pd.Series([r[1] for r in rows], dtype=float)})

    side = lambda h, v: F.struct(h.alias("hist"), v.alias("value"))
    got = both.withColumn("_o", run(F.array(side(a, va), side(b, vb)))).select("labels", "step", F.nanvl(F.col("_o.value"), F.lit(None).cast("double")).alias("value"), F.col("_o.hist").alias("hist"), F.col("step").alias("src_ts"))
    return out.unionByName(got.filter(F.col("hist").isNotNull() | F.col("value").isNotNull()))
