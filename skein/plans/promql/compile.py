"""PromQL plans: every expression becomes one lazy DataFrame.

Instant vectors are long tables (labels, step, value, hist, src_ts); an absent cell is a missing row. Scalars are
either columns over ``step`` or tables (step, value). Nothing is collected while a query is compiled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein import labels as lab
from skein.functions import histograms as hg
from skein.functions import ieee
from skein.functions.numbers import go_float
from skein.functions.regex import anchored
from skein.plans.promql import parser as p
from skein.plans.promql.parser import QueryError
from skein.plans.windows import Grid, neighbours, visible

LOOKBACK_MS = 300_000
DEFAULT_STEP_MS = 60_000
NAME = "__name__"


@dataclass
class Vector:
    """labels, step, value, hist, src_ts. ``named``: all rows share one __name__, so dropping it can't merge series."""

    df: DataFrame
    named: bool = False
    direct: bool = False
    matchers: list | None = None


@dataclass
class Scalar:
    """A value per step: ``column`` over step, or ``df`` (step, value)."""

    column: Callable[[Column], Column] | None = None
    df: DataFrame | None = None
    literal: float | None = None


@dataclass
class Windowed:
    """Samples with their predecessor and, exploded, the steps that see them."""

    df: DataFrame
    range_ms: int
    named: bool
    shift: int
    pinned: int | None


def column_of(rows: DataFrame, name: str) -> Column:
    """A label, or the plain column that repeats it where there is one."""
    return F.col("namespace") if name == "namespace" and "namespace" in rows.columns else lab.get(F.col("labels"), name)


def matcher(column: Column, op: str, value: str) -> Column:
    if op == "=" and value:
        return column == value  # as it stands, so that it can reach a scan; null is no match
    have = F.coalesce(column, F.lit(""))
    if op in ("=", "!="):
        return (have == value) if op == "=" else (have != value)
    hit = have.rlike(anchored(value))
    return hit if op == "=~" else ~hit


RATES = {"rate", "increase", "delta", "irate", "idelta", "resets", "changes"}
OVER_TIME = {f"{x}_over_time" for x in ("sum", "avg", "min", "max", "count", "last", "stddev", "stdvar", "present", "quantile")}
RANGE_FUNCTIONS = RATES | OVER_TIME | {"deriv", "predict_linear"}
MATH: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "ceil": ieee.ceil, "floor": ieee.floor, "exp": F.exp, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh,
    "acosh": F.acosh, "atanh": F.atanh, "deg": lambda x: x * F.lit(180.0) / F.pi(), "rad": lambda x: x * F.pi() / F.lit(180.0),
    "sgn": lambda x: F.when(F.isnan(x), x).otherwise(F.signum(x)), "ln": lambda x: ieee.log("ln", x), "log2": lambda x: ieee.log("log2", x),
    "log10": lambda x: ieee.log("log10", x),
}
HISTOGRAM_READS = {"histogram_count", "histogram_sum", "histogram_avg", "histogram_stddev", "histogram_stdvar"}


def _date(name: str) -> Callable[[Column], Column]:
    parts = {
        "year": F.year, "month": F.month, "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear, "day_of_week": lambda t: F.dayofweek(t) - 1,
        "hour": None, "minute": None, "days_in_month": lambda t: F.dayofmonth(F.last_day(t)),
    }

    def of(x: Column) -> Column:
        fine = ~F.isnan(x) & (F.abs(x) < 2.0**53 / 1000)
        seconds = F.floor(F.when(fine, x).otherwise(F.lit(0.0)))
        if name in ("hour", "minute"):
            value = F.floor(F.pmod(seconds, F.lit(86_400)) / 3600) if name == "hour" else F.floor(F.pmod(seconds, F.lit(3600)) / 60)
        else:
            value = parts[name](F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")))
        return F.when(fine, value.cast("double")).otherwise(ieee.num(ieee.NAN))

    return of


DATES = {n: _date(n) for n in ("year", "month", "day_of_month", "day_of_year", "day_of_week", "hour", "minute", "days_in_month")}


class Compiler:
    """Compiles queries over ``samples``: labels (canonical), ts_ms, value, stale, and optionally hist.

    A sample is unique per (labels, ts_ms). Windows are left-open: (e - range, e].
    """

    def __init__(self, spark: SparkSession, samples: DataFrame, grid: Grid, lookback_ms: int = LOOKBACK_MS):
        if "hist" not in samples.columns:
            samples = samples.withColumn("hist", F.lit(None).cast(hg.HISTOGRAM))
        self.spark, self.samples, self.grid, self.lookback = spark, samples, grid, lookback_ms
        self.narrow: list[str] | None = None

    # --- evaluation -------------------------------------------------------------------------------------------

    def query(self, text: str) -> DataFrame:
        """labels, step, value, hist of the result; scalars have no labels."""
        node = p.parse(text)
        if isinstance(node, p.String) or (isinstance(node, p.Selector) and node.range_ms) or isinstance(node, p.Subquery):
            raise QueryError("the result must be a scalar or an instant vector")
        descending = isinstance(node, p.Call) and node.name in ("sort", "sort_desc")
        result = self.eval(node)
        if isinstance(result, Scalar):
            return self.as_table(result).select(F.array().cast(lab.LABELS).alias("labels"), "step", "value", F.lit(None).cast(hg.HISTOGRAM).alias("hist"))
        out = result.df.select("labels", "step", "value", "hist")
        if descending and self.grid.count == 1:
            way = F.col("value").desc() if node.name == "sort_desc" else F.col("value").asc()
            return out.orderBy(F.isnan("value"), way, "labels")
        return out

    def eval(self, node) -> Vector | Scalar:
        if isinstance(node, p.Number):
            return Scalar(column=lambda _: ieee.num(node.value), literal=node.value)
        if isinstance(node, p.String):
            raise QueryError("a string is no operand")
        if isinstance(node, p.Selector):
            if node.range_ms:
                raise QueryError("a range vector is no operand")
            return self.instant(node)
        if isinstance(node, p.Subquery):
            raise QueryError("a subquery is no operand")
        if isinstance(node, p.Unary):
            inner = self.eval(node.expr)
            if isinstance(inner, Scalar):
                return self.scalar_map(inner, lambda x: -x, None if inner.literal is None else -inner.literal)
            return self.binary_scalar(inner, Scalar(column=lambda _: ieee.num(-1), literal=-1.0), "*", True, False)
        if isinstance(node, p.Binary):
            return self.binary(node)
        if isinstance(node, p.Aggregate):
            return self.aggregate(node)
        return self.call(node)

    # --- selectors --------------------------------------------------------------------------------------------

    def pin(self, node) -> int | None:
        if node.at in ("start", "end"):
            return self.grid.start if node.at == "start" else self.grid.last
        return node.at

    def selected(self, node: p.Selector, low: int, high: int) -> DataFrame:
        """Samples of the selector in (low, high]: label and time filters reach the scan."""
        narrow, self.narrow = self.narrow, None
        keep = (F.col("ts_ms") > low) & (F.col("ts_ms") <= high)
        for name, op, value in node.matchers:
            keep = keep & matcher(column_of(self.samples, name), op, value)
        rows = self.samples.filter(keep).select("labels", "ts_ms", "value", "stale", "hist")
        if narrow is None or not self.one_name(node):
            return rows
        one, two = lab.key(F.col("labels"))
        return rows.withColumns({"_s1": one, "_s2": two, "labels": lab.keep(F.col("labels"), narrow)})

    @staticmethod
    def identity(df: DataFrame) -> list[str]:
        """The columns that tell series apart: their labels, or a 128-bit key where only some labels are carried along."""
        return ["_s1", "_s2", "labels"] if "_s1" in df.columns else ["labels"]

    @staticmethod
    def one_name(node: p.Selector) -> bool:
        return any(n == NAME and op == "=" for n, op, _ in node.matchers)

    def spread(self, df: DataFrame, pinned: bool) -> DataFrame:
        """A result pinned to one time, repeated at every step."""
        if not pinned or self.grid.count == 1:
            return df
        steps = F.transform(F.sequence(F.lit(0), F.lit(self.grid.count - 1)), lambda i: F.lit(self.grid.start) + i.cast("bigint") * F.lit(max(self.grid.step, 1)))
        return df.drop("step").withColumn("step", F.explode(steps))

    def instant(self, node: p.Selector) -> Vector:
        """The newest sample of (e - lookback, e] per step; absent if that one is a stale marker.

        A sample is the newest from its own time until its successor's, so it is exploded onto just those steps:
        each output cell costs one row and no aggregation.
        """
        pinned = self.pin(node)
        grid = self.grid if pinned is None else Grid(pinned, pinned, 0)
        rows = self.selected(node, grid.start - node.offset_ms - self.lookback, grid.last - node.offset_ms)
        rows = neighbours(rows, self.identity(rows)[:2], "ts_ms", {"ts_ms": "next_ts"}, self.lookback, forward=True)
        until = F.least(F.col("ts_ms") + self.lookback, F.coalesce("next_ts", F.col("ts_ms") + self.lookback))
        seen = rows.filter(~F.col("stale")).withColumn("step", F.explode(visible(grid, node.offset_ms, F.col("ts_ms"), until)))
        df = seen.select("labels", "step", "value", "hist", F.col("ts_ms").alias("src_ts"))
        df = self.spread(df, pinned is not None)
        if pinned is not None and self.grid.count == 1:
            df = df.withColumn("step", F.lit(self.grid.start))
        return Vector(df, self.one_name(node), True, node.matchers)

    def window(self, node) -> Windowed:
        """labels, step, eff, ts, v, hist, pts, pv (predecessor within the window or null)."""
        pinned = self.pin(node)
        grid = self.grid if pinned is None else Grid(pinned, pinned, 0)
        if isinstance(node, p.Selector) and node.range_ms:
            rows = self.selected(node, grid.start - node.offset_ms - node.range_ms, grid.last - node.offset_ms).filter(~F.col("stale"))
            named = self.one_name(node)
        elif isinstance(node, p.Subquery):
            every = node.step_ms or DEFAULT_STEP_MS
            first = (grid.start - node.offset_ms - node.range_ms) // every * every + every
            last = (grid.last - node.offset_ms) // every * every
            inner = Compiler(self.spark, self.samples, Grid(first, max(first, last), every), self.lookback).eval(node.expr)
            if isinstance(inner, Scalar):
                raise QueryError("a subquery needs an instant vector")
            rows = inner.df.select("labels", F.col("step").alias("ts_ms"), "value", F.lit(False).alias("stale"), "hist").filter(F.col("ts_ms") <= last)
            named = inner.named
        else:
            raise QueryError("a range vector is needed")
        rows = neighbours(rows, self.identity(rows)[:2], "ts_ms", {"ts_ms": "pts", "value": "pv"}, node.range_ms)
        seen = rows.withColumn("step", F.explode(visible(grid, node.offset_ms, F.col("ts_ms"), F.col("ts_ms") + node.range_ms)))
        eff = F.col("step") - node.offset_ms
        inside = F.col("pts") > F.col("step") - node.offset_ms - node.range_ms
        df = seen.select(
            *self.identity(seen), "step", eff.alias("eff"), F.col("ts_ms").alias("ts"), F.col("value").alias("v"), "hist",
            F.when(inside, F.col("pts")).alias("pts"), F.when(inside, F.col("pv")).alias("pv"),
        )
        return Windowed(df, node.range_ms, named, node.offset_ms, pinned)

    # --- range functions --------------------------------------------------------------------------------------

    def rollup(self, name: str, node, param: float | None) -> Vector:
        w = self.window(node)
        floats = w.df.filter(F.col("hist").isNull())
        own = self.identity(w.df)
        hists = hg.rollup(w, name, own)
        v, ts, pv = F.col("v"), F.col("ts"), F.col("pv")
        by = floats.groupBy(*own, "step", "eff")
        n = F.count("*")
        seconds = ieee.num(w.range_ms / 1000)
        if name in ("rate", "increase", "delta"):
            counter = name != "delta"
            reset = F.sum(F.when(ieee.comparison("<", v, pv), pv).otherwise(ieee.num(0)))
            g = by.agg(n.alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min_by("v", "ts").alias("v0"), F.max_by("v", "ts").alias("v1"), F.coalesce(reset, ieee.num(0)).alias("resets"))
            change = F.col("v1") - F.col("v0") + (F.col("resets") if counter else ieee.num(0))
            sampled = (F.col("t1") - F.col("t0")) / 1000
            every = sampled / (F.col("n") - 1)
            to_start, to_end = (F.col("t0") - (F.col("eff") - w.range_ms)) / 1000, (F.col("eff") - F.col("t1")) / 1000
            to_start = F.when(to_start >= every * 1.1, every / 2).otherwise(to_start)
            if counter:
                to_zero = sampled * (F.col("v0") / F.when(change > 0, change).otherwise(F.lit(1.0)))
                to_start = F.when((change > 0) & (F.col("v0") >= 0) & (to_zero < to_start), to_zero).otherwise(to_start)
            to_end = F.when(to_end >= every * 1.1, every / 2).otherwise(to_end)
            value = change * ((sampled + to_start + to_end) / sampled) / (seconds if name == "rate" else ieee.num(1))
            df = g.filter(F.col("n") > 1).select(*own, "step", value.alias("value"))
        elif name in ("irate", "idelta"):
            g = by.agg(n.alias("n"), F.max("ts").alias("t1"), F.max_by("v", "ts").alias("v1"), F.max_by("pts", "ts").alias("t0"), F.max_by("pv", "ts").alias("v0"))
            change = F.col("v1") - F.col("v0")
            if name == "irate":
                change = F.when(F.col("v1") < F.col("v0"), F.col("v1")).otherwise(change) / ((F.col("t1") - F.col("t0")) / 1000)
            df = g.select(*own, "step", change.alias("value"), "t1")  # null where the last float follows a histogram, or nothing
        elif name in ("deriv", "predict_linear"):
            x = (ts - F.col("eff")) / 1000
            g = by.agg(n.alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.regr_slope(v, x).alias("slope"), F.avg(v).alias("my"), F.avg(x).alias("mx"))
            steady = (F.col("lo") == F.col("hi")) & ~F.isnan("lo")
            flat = F.when(F.abs("lo") == ieee.INF, ieee.num(ieee.NAN)).otherwise(ieee.num(0))
            slope = F.when(steady, flat).otherwise(F.coalesce("slope", ieee.num(ieee.NAN)))
            value = slope if name == "deriv" else F.when(steady, F.when(F.abs("lo") == ieee.INF, ieee.num(ieee.NAN)).otherwise(F.col("lo"))).otherwise(F.col("my") - slope * F.col("mx") + slope * ieee.num(param))
            df = g.filter(F.col("n") > 1).select(*own, "step", value.alias("value"))
        else:
            both_nan = F.isnan(v) & F.isnan(pv)
            after_histogram = F.col("pts").isNotNull() & pv.isNull()  # the sample before it in the window is of the other kind
            value = {
                "resets": lambda: F.sum(F.when((ieee.comparison("<", v, pv) & pv.isNotNull()) | after_histogram, 1).otherwise(0)).cast("double"),
                "changes": lambda: F.sum(F.when((pv.isNotNull() & ieee.comparison("!=", v, pv) & ~both_nan) | after_histogram, 1).otherwise(0)).cast("double"),
                "sum_over_time": lambda: F.sum("v"), "avg_over_time": lambda: F.avg("v"), "min_over_time": lambda: ieee.minimum(v),
                "max_over_time": lambda: ieee.maximum(v), "count_over_time": lambda: n.cast("double"), "last_over_time": lambda: F.max_by("v", "ts"),
                "stddev_over_time": lambda: F.stddev_pop("v"), "stdvar_over_time": lambda: F.var_pop("v"), "present_over_time": lambda: F.max(F.lit(1.0)),
                "quantile_over_time": lambda: ieee.quantile(param, v),
            }[name]()
            df = by.agg(value.alias("value"), F.max("ts").alias("t1")).select(*own, "step", "value", "t1")
        df = hg.join_rollup(df, hists, name, own)
        df = self.spread(df, w.pinned is not None)
        if w.pinned is not None and self.grid.count == 1:
            df = df.withColumn("step", F.lit(self.grid.start))
        out = Vector(df.withColumn("src_ts", F.col("step")), w.named)
        return out if name == "last_over_time" else self.without_name(out)

    def without_name(self, v: Vector) -> Vector:
        """Drops __name__; series that then share labels at one step are an error."""
        df = v.df.withColumn("labels", lab.drop(F.col("labels"), [NAME]))
        return Vector(df if v.named else self.unique(df), True, False, v.matchers)

    @staticmethod
    def unique(df: DataFrame) -> DataFrame:
        n = F.count("*").over(Window.partitionBy("labels", "step"))
        checked = F.when(n > 1, F.raise_error(F.lit("vector cannot contain metrics with the same labelset")).cast("double")).otherwise(F.col("value"))
        return df.withColumn("value", checked)

    # --- scalars ----------------------------------------------------------------------------------------------

    def as_table(self, s: Scalar) -> DataFrame:
        return s.df if s.df is not None else self.grid.steps(self.spark).select("step", s.column(F.col("step")).alias("value"))

    def scalar_map(self, s: Scalar, f: Callable[[Column], Column], literal: float | None = None) -> Scalar:
        if s.df is not None:
            return Scalar(df=s.df.select("step", f(F.col("value")).alias("value")))
        return Scalar(column=lambda t: f(s.column(t)), literal=literal)

    def to_scalar(self, v: Vector) -> Scalar:
        one = v.df.filter(F.col("hist").isNull()).groupBy("step").agg(F.count("*").alias("n"), F.first("value").alias("value"))
        df = self.grid.steps(self.spark).join(one, "step", "left").select("step", F.when(F.col("n") == 1, F.col("value")).otherwise(ieee.num(ieee.NAN)).alias("value"))
        return Scalar(df=df)

    def with_scalar(self, df: DataFrame, s: Scalar, name: str) -> DataFrame:
        if s.df is not None:
            return df.join(s.df.select("step", F.col("value").alias(name)), "step")
        return df.withColumn(name, s.column(F.col("step")))

    def literal(self, node) -> float:
        value = self.eval(node) if not isinstance(node, p.String) else None
        if not isinstance(value, Scalar) or value.literal is None:
            raise QueryError("a number literal is needed here")
        return value.literal

    # --- functions --------------------------------------------------------------------------------------------

    def vector_arg(self, node) -> Vector:
        v = self.eval(node)
        if isinstance(v, Scalar):
            raise QueryError("an instant vector is needed here")
        return v

    def map_floats(self, v: Vector, f: Callable[[Column], Column]) -> Vector:
        df = v.df.filter(F.col("hist").isNull()).withColumn("value", f(F.col("value")))
        return self.without_name(replace(v, df=df, direct=False))

    def call(self, node: p.Call) -> Vector | Scalar:
        name, args = node.name, node.args

        def arity(low: int, high: int | None = None) -> None:
            if not low <= len(args) <= (high if high is not None else low):
                raise QueryError(f"wrong number of arguments for {name}")

        if name == "time":
            arity(0)
            return Scalar(column=lambda t: t / F.lit(1000.0))
        if name == "pi":
            arity(0)
            return Scalar(column=lambda _: F.pi(), literal=3.141592653589793)
        if name == "scalar":
            arity(1)
            return self.to_scalar(self.vector_arg(args[0]))
        if name == "vector":
            arity(1)
            s = self.eval(args[0])
            if not isinstance(s, Scalar):
                raise QueryError("vector() takes a scalar")
            df = self.as_table(s).select(F.array().cast(lab.LABELS).alias("labels"), "step", "value", F.lit(None).cast(hg.HISTOGRAM).alias("hist"), F.col("step").alias("src_ts"))
            return Vector(df, True)
        if name == "absent_over_time":
            arity(1)
            return self.absent(self.rollup("count_over_time", args[0], None), args[0])
        if name in RANGE_FUNCTIONS:
            arity(2 if name in ("predict_linear", "quantile_over_time") else 1)
            if name == "predict_linear":
                return self.rollup(name, args[0], self.literal(args[1]))
            if name == "quantile_over_time":
                return self.rollup(name, args[1], self.literal(args[0]))
            return self.rollup(name, args[0], None)
        if name in MATH:
            arity(1)
            inner = self.eval(args[0])
            return self.scalar_map(inner, MATH[name]) if isinstance(inner, Scalar) else self.map_floats(inner, MATH[name])
        if name in DATES:
            arity(0, 1)
            inner = self.eval(args[0]) if args else self.call(p.Call("vector", [p.Call("time", [])]))
            return self.scalar_map(inner, DATES[name]) if isinstance(inner, Scalar) else self.map_floats(inner, DATES[name])
        if name == "round":
            arity(1, 2)
            to = self.literal(args[1]) if len(args) > 1 else 1.0
            return self.map_floats(self.vector_arg(args[0]), lambda x: x if to == 0 else ieee.floor(x * ieee.num(1 / to) + 0.5) / ieee.num(1 / to))
        if name in ("clamp", "clamp_min", "clamp_max"):
            arity(3 if name == "clamp" else 2)
            v = self.vector_arg(args[0])
            bounds = [self.literal(a) for a in args[1:]]
            if name == "clamp" and bounds[0] > bounds[1]:
                return Vector(v.df.filter(F.lit(False)), True)
            steps = {"clamp": [ieee.greatest_nan, ieee.least_nan], "clamp_min": [ieee.greatest_nan], "clamp_max": [ieee.least_nan]}[name]

            def clamp(x: Column) -> Column:
                for f, b in zip(steps, bounds, strict=True):
                    x = f(x, ieee.num(b))
                return x

            return self.map_floats(v, clamp)
        if name == "timestamp":
            arity(1)
            v = self.vector_arg(args[0])
            at = F.col("src_ts" if v.direct else "step") / F.lit(1000.0)
            return self.without_name(replace(v, df=v.df.withColumns({"value": at, "hist": F.lit(None).cast(hg.HISTOGRAM)}), direct=False))
        if name in HISTOGRAM_READS:
            arity(1)
            v = self.vector_arg(args[0])
            df = v.df.filter(F.col("hist").isNotNull()).withColumns({"value": hg.read(name, F.col("hist")), "hist": F.lit(None).cast(hg.HISTOGRAM)})
            return self.without_name(replace(v, df=df, direct=False))
        if name == "histogram_quantile":
            arity(2)
            return self.histogram(self.vector_arg(args[1]), "quantile", self.literal(args[0]), 0.0)
        if name == "histogram_fraction":
            arity(3)
            return self.histogram(self.vector_arg(args[2]), "fraction", self.literal(args[0]), self.literal(args[1]))
        if name == "absent":
            arity(1)
            return self.absent(self.vector_arg(args[0]), args[0])
        if name in ("sort", "sort_desc"):
            arity(1)
            v = self.vector_arg(args[0])
            return replace(v, df=v.df.filter(F.col("hist").isNull()))
        if name in ("label_replace", "label_join"):
            return self.relabel(node)
        raise QueryError(f"unknown function {name}")

    def histogram(self, v: Vector, what: str, a: float, b: float) -> Vector:
        """Classic buckets are gathered per label set without le (bounded by the number of buckets)."""
        rest = lab.drop(F.col("labels"), [NAME, "le"])
        le = lab.get(F.col("labels"), "le")
        bound = F.when(F.lower(le).isin("+inf", "inf"), ieee.num(ieee.INF)).otherwise(F.expr("try_cast(_le as double)"))
        classic = v.df.filter(F.col("hist").isNull()).withColumn("_le", le).withColumn("_b", bound).filter(F.col("_b").isNotNull())
        got = classic.groupBy(rest.alias("labels"), "step").agg(F.array_sort(F.collect_list(F.struct("_b", "value"))).alias("buckets"))
        got = got.select("labels", "step", hg.classic(what, a, b)(F.transform("buckets", lambda x: x["_b"]), F.transform("buckets", lambda x: x["value"])).alias("value")).filter(F.col("value").isNotNull())
        native = v.df.filter(F.col("hist").isNotNull()).select(lab.drop(F.col("labels"), [NAME]).alias("labels"), "step", hg.read(f"histogram_{what}", F.col("hist"), a, b).alias("value"))
        df = got.unionByName(native).withColumns({"hist": F.lit(None).cast(hg.HISTOGRAM), "src_ts": F.col("step")})
        return Vector(df if v.named else self.unique(df), True)

    def absent(self, v: Vector, node) -> Vector:
        while isinstance(node, p.Subquery):
            node = node.expr
        names: dict[str, str | None] = {}
        if isinstance(node, p.Selector):
            for n, op, value in node.matchers:
                if n != NAME:
                    names[n] = value if op == "=" and n not in names else None
        pairs = sorted((n, x) for n, x in names.items() if x)
        own = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("value")) for n, x in pairs]).cast(lab.LABELS)
        steps = self.grid.steps(self.spark).join(v.df.select("step").distinct(), "step", "left_anti")
        df = steps.select(own.alias("labels"), "step", ieee.num(1).alias("value"), F.lit(None).cast(hg.HISTOGRAM).alias("hist"), F.col("step").alias("src_ts"))
        return Vector(df, True)

    def relabel(self, node: p.Call) -> Vector:
        v = self.vector_arg(node.args[0])
        texts = [a.value if isinstance(a, p.String) else None for a in node.args[1:]]
        if None in texts or len(texts) < (4 if node.name == "label_replace" else 2):
            raise QueryError(f"{node.name} takes string arguments")
        ls = F.col("labels")
        if node.name == "label_replace":
            dst, template, src, pattern = texts
            new = replaced(F.coalesce(lab.get(ls, src), F.lit("")), pattern, template)
            hit = F.coalesce(lab.get(ls, src), F.lit("")).rlike(anchored(pattern))
            out = F.when(hit, lab.put(ls, dst, new)).otherwise(ls)
        else:
            dst, sep, *src = texts
            out = lab.put(ls, dst, F.concat_ws(sep, *[F.coalesce(lab.get(ls, s), F.lit("")) for s in src]) if src else F.lit(""))
        return Vector(self.unique(v.df.withColumn("labels", out)), v.named and dst != NAME)

    # --- aggregation ------------------------------------------------------------------------------------------

    def group_key(self, node: p.Aggregate) -> Column:
        return lab.drop(F.col("labels"), [*node.labels, NAME]) if node.without else lab.keep(F.col("labels"), node.labels)

    @staticmethod
    def needed(node: p.Aggregate) -> list[str] | None:
        """Labels that suffice below an aggregation ``by`` names over a selector or a range function of one: the selector then
        carries these and a key of the series instead of all labels. None if all are needed."""
        inner = node.expr
        if isinstance(inner, p.Call) and inner.name in RANGE_FUNCTIONS:
            inner = next((a for a in inner.args if isinstance(a, p.Selector)), None)
        plain = isinstance(inner, p.Selector) and not node.without and NAME not in node.labels
        return list(node.labels) if plain and node.op not in ("topk", "bottomk") else None

    def aggregate(self, node: p.Aggregate) -> Vector:
        self.narrow = self.needed(node)
        v = self.vector_arg(node.expr)
        self.narrow = None
        key = self.group_key(node)
        floats = v.df.filter(F.col("hist").isNull())
        x = F.col("value")
        if node.op in ("topk", "bottomk"):
            k = self.eval(node.param)
            if not isinstance(k, Scalar):
                raise QueryError(f"{node.op} needs a scalar")
            ranked = self.with_scalar(floats.withColumn("_g", key), k, "_k")
            way = x.desc() if node.op == "topk" else x.asc()
            w = Window.partitionBy("_g", "step").orderBy(F.isnan(x), way, "labels")
            df = ranked.withColumn("_r", F.row_number().over(w))
            df = df.filter(F.col("_r") <= F.lit(int(k.literal)) if k.literal is not None and abs(k.literal) < 2**31 and k.literal == k.literal else F.col("_r") <= F.col("_k"))
            return replace(v, df=df.drop("_g", "_k", "_r"), direct=False)
        if node.op == "count_values":
            if not isinstance(node.param, p.String):
                raise QueryError("count_values needs a label name")
            labelled = floats.select(key.alias("labels"), "step", go_float(x).alias("_v"))
            g = labelled.groupBy("labels", "step", "_v").agg(F.count("*").cast("double").alias("value"))
            out = g.groupBy(lab.put(F.col("labels"), node.param.value, F.col("_v")).alias("labels"), "step").agg(F.sum("value").alias("value"))
            return Vector(self.shaped(out), True)
        value = {
            "sum": lambda: F.sum(x), "avg": lambda: F.avg(x), "min": lambda: ieee.minimum(x), "max": lambda: ieee.maximum(x), "count": lambda: F.count("*").cast("double"),
            "stddev": lambda: F.stddev_pop(x), "stdvar": lambda: F.var_pop(x), "group": lambda: F.max(ieee.num(1)), "quantile": lambda: ieee.quantile(self.literal(node.param), x),
        }[node.op]()
        if node.op in ("count", "group"):
            floats = v.df
        out = self.shaped(floats.groupBy(key.alias("labels"), "step").agg(value.alias("value")))
        if node.op in ("sum", "avg"):
            out = hg.aggregate(out, v.df.filter(F.col("hist").isNotNull()).select(key.alias("labels"), "step", "hist"), node.op)
        return Vector(out, not (node.grouped and not node.without and NAME in node.labels))

    @staticmethod
    def shaped(df: DataFrame) -> DataFrame:
        return df.withColumns({"hist": F.lit(None).cast(hg.HISTOGRAM), "src_ts": F.col("step")})

    # --- binary operators -------------------------------------------------------------------------------------

    def binary(self, node: p.Binary) -> Vector | Scalar:
        left, right, op = self.eval(node.left), self.eval(node.right), node.op
        if isinstance(left, Scalar) and isinstance(right, Scalar):
            if op in p.SETS:
                raise QueryError("set operators need vectors")
            if op in p.COMPARISONS and not node.bool_:
                raise QueryError("comparisons between scalars must use bool")
            f = self.operator(op, True)
            if left.df is None and right.df is None:
                return Scalar(column=lambda t: f(left.column(t), right.column(t)), literal=fold(op, left.literal, right.literal))
            both = self.as_table(left).join(self.as_table(right).withColumnRenamed("value", "_r"), "step")
            return Scalar(df=both.select("step", f(F.col("value"), F.col("_r")).alias("value")))
        if isinstance(left, Scalar) or isinstance(right, Scalar):
            if op in p.SETS or node.on is not None or node.group:
                raise QueryError("vector matching needs two vectors")
            return self.binary_scalar(right, left, op, False, node.bool_) if isinstance(left, Scalar) else self.binary_scalar(left, right, op, True, node.bool_)
        if op in p.SETS:
            return self.set_operation(left, right, node)
        return self.matched(left, right, node)

    def operator(self, op: str, as_number: bool) -> Callable[[Column, Column], Column]:
        if op in p.COMPARISONS:
            return lambda a, b: ieee.comparison(op, a, b).cast("double") if as_number else ieee.comparison(op, a, b)
        return {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": ieee.div, "%": ieee.mod, "^": ieee.power, "atan2": F.atan2}[op]

    def binary_scalar(self, v: Vector, s: Scalar, op: str, vector_left: bool, bool_: bool) -> Vector:
        df = self.with_scalar(v.df, s, "_s")
        a, b = (F.col("value"), F.col("_s")) if vector_left else (F.col("_s"), F.col("value"))
        floats = df.filter(F.col("hist").isNull())
        if op in p.COMPARISONS and not bool_:
            return replace(v, df=floats.filter(self.operator(op, False)(a, b)).drop("_s"), direct=False)
        out = floats.withColumn("value", self.operator(op, True)(a, b))
        if op in ("*", "/") and (vector_left or op == "*"):
            out = out.unionByName(hg.scaled(df.filter(F.col("hist").isNotNull()), op, F.col("_s")))
        return self.without_name(replace(v, df=out.drop("_s"), direct=False))

    def match_key(self, node: p.Binary) -> Column:
        """__name__ is never part of the key, not even if named in on()."""
        if node.on is not None:
            return lab.keep(F.col("labels"), [n for n in node.on if n != NAME])
        return lab.drop(F.col("labels"), [*(node.ignoring or []), NAME])

    def set_operation(self, left: Vector, right: Vector, node: p.Binary) -> Vector:
        a, b = left.df.withColumn("_m", self.match_key(node)), right.df.withColumn("_m", self.match_key(node))
        if node.op in ("and", "unless"):
            df = a.join(b.select("_m", "step").distinct(), ["_m", "step"], "left_semi" if node.op == "and" else "left_anti")
            return replace(left, df=df.drop("_m"), direct=False)
        extra = b.join(a.select("_m", "step").distinct(), ["_m", "step"], "left_anti")
        return Vector(a.unionByName(extra).drop("_m"), False)

    def matched(self, left: Vector, right: Vector, node: p.Binary) -> Vector:
        """Equi-join on (match key, step). Too many partners raise while the query runs."""
        many, one = (right, left) if node.group == "right" else (left, right)
        a = many.df.select("step", self.match_key(node).alias("_m"), F.col("labels"), F.col("value"), F.col("hist"))
        b = one.df.select("step", self.match_key(node).alias("_m"), F.col("labels").alias("_labels"), F.col("value").alias("_value"), F.col("hist").alias("_hist"))
        w = Window.partitionBy("_m", "step")
        b = b.withColumn("_n", F.count("*").over(w))
        if node.group is None:
            a = a.withColumn("_k", F.count("*").over(w))
        both = a.join(b, ["_m", "step"])
        problem = F.when(F.col("_n") > 1, F.lit("found duplicate series on the one side of a match"))
        if node.group is None:
            problem = problem.when(F.col("_k") > 1, F.lit("multiple matches for labels: many-to-one matching must be explicit"))
        sure = F.when(problem.isNotNull(), F.raise_error(problem).cast("double"))
        mine, other = F.coalesce(sure, F.col("value")), F.col("_value")
        x, y = (other, mine) if node.group == "right" else (mine, other)
        compare = node.op in p.COMPARISONS
        keeps_name = compare and not node.bool_
        labels = F.col("labels") if keeps_name else lab.drop(F.col("labels"), [NAME])
        if node.group is None:
            labels = lab.keep(F.col("labels"), node.on) if node.on is not None else lab.drop(labels, node.ignoring or [])
            if node.on is not None and not keeps_name:
                labels = lab.drop(labels, [NAME])
        for name in node.include:
            labels = lab.put(labels, name, lab.get(F.col("_labels"), name))
        plain = both.filter(F.col("hist").isNull() & F.col("_hist").isNull())
        kept = x if compare and not node.bool_ else self.operator(node.op, True)(x, y)
        if compare and not node.bool_:
            plain = plain.withColumn("_ok", self.operator(node.op, False)(x, y)).filter("_ok")
        out = self.shaped(plain.select(labels.alias("labels"), "step", kept.alias("value")))
        out = hg.binary(out, both.filter(F.col("hist").isNotNull() | F.col("_hist").isNotNull()).withColumn("labels", labels), node.op, node.bool_, node.group == "right")
        named = node.group is None or (many.named and not node.include)
        return Vector(out if named and (many.named or node.group is None) else self.unique(out), True)


def replaced(source: Column, pattern: str, template: str) -> Column:
    """``template`` with $1, ${1}, $name expanded from the anchored match; $$ is a dollar sign."""
    import re

    compiled = re.compile(pattern.replace("(?<", "(?P<") if "(?P<" not in pattern else pattern)
    parts: list[Column] = []
    at = 0
    for m in re.finditer(r"\$\$|\$(?:\{(\w+)\}|(\w+))", template):
        parts.append(F.lit(template[at : m.start()]))
        name = m[1] or m[2]
        if m[0] == "$$":
            parts.append(F.lit("$"))
        else:
            number = int(name) if name.isdigit() else compiled.groupindex.get(name)
            if number is not None and number <= compiled.groups:
                parts.append(F.coalesce(F.regexp_extract(source, anchored(pattern), number), F.lit("")))
        at = m.end()
    parts.append(F.lit(template[at:]))
    return F.concat(*parts)


def fold(op: str, a: float | None, b: float | None) -> float | None:
    if a is None or b is None:
        return None
    import math

    try:
        return {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b), "^": lambda: a**b, "atan2": lambda: math.atan2(a, b),
            "==": lambda: float(a == b), "!=": lambda: float(a != b), "<": lambda: float(a < b), "<=": lambda: float(a <= b), ">": lambda: float(a > b), ">=": lambda: float(a >= b),
        }[op]()
    except (ZeroDivisionError, OverflowError, ValueError):
        if op == "/" and a == a and a != 0:
            return math.copysign(math.inf, a) * math.copysign(1, b)
        return math.inf if op == "^" else math.nan


def evaluate(spark: SparkSession, samples: DataFrame, text: str, start_ms: int, end_ms: int | None = None, step_ms: int = 0, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """An instant query at ``start_ms``, or a range query if ``end_ms`` is given."""
    grid = Grid(start_ms, start_ms if end_ms is None else end_ms, step_ms)
    return Compiler(spark, samples, grid, lookback_ms).query(text)
