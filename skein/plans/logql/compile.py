"""LogQL plans. Log queries give entries, metric queries the long vector tables of the PromQL compiler, which also does
vector matching, sets and broadcasting; this module adds streams, pipelines and range aggregations, and the places
where the two languages differ in numbers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein import labels as lab
from skein.functions import histograms as hg
from skein.functions import ieee
from skein.functions.words import analyse
from skein.plans.logql import parser as q
from skein.plans.logql import stages as st
from skein.plans.promql import compile as pc
from skein.plans.promql.parser import QueryError
from skein.plans.windows import Grid, neighbours, visible

MS = 1_000_000
DEFAULT_LIMIT = 1000
#: Width of the time segments over which full-text statistics are taken.
SEGMENT_NS = 3_600_000_000_000
K1, B = 1.2, 0.75


class Compiler(pc.Compiler):
    """Over ``entries``: labels (canonical), ts_ns, line, metadata, entry_id."""

    def __init__(self, spark: SparkSession, entries: DataFrame, grid: Grid):
        self.spark, self.entries, self.grid = spark, entries, grid

    # --- logs ---------------------------------------------------------------------------------------------------

    def streams(self, node: q.Log, low: int, high: int, left_open: bool) -> DataFrame:
        """Entries of the selector in time, line filters up front applied as columns: they reach the scan."""
        at = F.col("ts_ns")
        keep = ((at > low) & (at <= high)) if left_open else ((at >= low) & (at < high))
        for name, op, value in node.matchers:
            keep = keep & pc.matcher(pc.column_of(self.entries, name), op, value)
        rows = self.entries.filter(keep).select("labels", "ts_ns", "line", "metadata", "entry_id")
        stages = list(node.stages)
        while stages and (c := st.column_filter(stages[0])) is not None:
            rows, stages = rows.filter(c), stages[1:]
        return self.piped(rows, stages)

    @staticmethod
    def piped(rows: DataFrame, stages: list[tuple], unwrapped: str | None = None) -> DataFrame:
        if not stages:
            return rows.withColumns({"value": F.lit(None).cast("double"), "error": F.lit(None).cast("string")})
        unwrapped = next((s[1] for s in stages if s[0] == "unwrap"), None)
        return rows.mapInArrow(st.run_stages(stages, unwrapped), st.SCHEMA)

    def logs(self, node: q.Log, start_ns: int, end_ns: int, limit: int | None, forward: bool) -> DataFrame:
        """Entries of [start, end): equal stream, time, line and metadata count once.

        Newest first unless ``forward``. With a match stage: best score first, then forward order.
        """
        rows = self.streams(node, start_ns, end_ns, False)
        rows = rows.withColumn("_m", F.array_sort(F.map_entries("metadata")))
        rows = rows.groupBy("labels", "ts_ns", "line", "_m").agg(F.min("entry_id").alias("entry_id"), F.any_value("metadata").alias("metadata")).drop("_m")
        terms = sorted({t for s in node.stages if s[0] == "match" for t in analyse(s[1])})
        order = [F.col("ts_ns"), F.col("entry_id")] if forward or terms else [F.col("ts_ns").desc(), F.col("entry_id").desc()]
        if terms:
            rows = self.scored(rows, node, terms, start_ns, end_ns)
            order = [F.col("score").desc(), *order]
        out = rows.select("labels", "ts_ns", "line", "metadata", "entry_id", *(["score"] if terms else []))
        return out.orderBy(*order).limit(DEFAULT_LIMIT if limit is None else limit)

    def scored(self, rows: DataFrame, node: q.Log, terms: list[str], start_ns: int, end_ns: int) -> DataFrame:
        """BM25 with statistics of the stream selection per time segment, aggregated without collecting."""
        segment = F.floor(F.col("ts_ns") / SEGMENT_NS)
        counts = term_counts(terms)
        base = self.streams(q.Log(node.matchers), start_ns, end_ns, False).select(segment.alias("seg"), counts("line").alias("c"))
        stats = base.groupBy("seg").agg(
            F.count("*").alias("n"), F.avg(F.greatest(F.col("c.size"), F.lit(1))).alias("avg"), *[F.sum(F.when(F.get("c.tf", F.lit(i)) > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))]
        )
        score: Column = F.lit(0.0)
        length = F.greatest(F.col("c.size"), F.lit(1)) / F.greatest(F.col("avg"), F.lit(1.0))
        for i in range(len(terms)):
            tf, df = F.get("c.tf", F.lit(i)).cast("double"), F.col(f"df{i}")
            score = score + F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length))
        return rows.withColumns({"seg": segment, "c": counts("line")}).join(stats, "seg").withColumn("score", score)

    # --- metrics --------------------------------------------------------------------------------------------------

    def eval(self, node):
        if isinstance(node, q.Number):
            return pc.Scalar(column=lambda _: ieee.num(node.value), literal=node.value)
        if isinstance(node, q.VectorOf):
            df = self.grid.steps(self.spark).select(F.array().cast(lab.LABELS).alias("labels"), "step", ieee.num(node.value).alias("value"))
            return pc.Vector(self.shaped(df), True)
        if isinstance(node, q.Range):
            return self.range(node)
        if isinstance(node, q.Aggregate):
            return self.vector_aggregate(node)
        if isinstance(node, q.Binary):
            return self.binary(node)
        if isinstance(node, q.Sort):
            return self.eval(node.expr)
        if isinstance(node, q.Replace):
            dst, template, src, pattern = node.args
            v = self.eval(node.expr)
            have = F.coalesce(lab.get(F.col("labels"), src), F.lit(""))
            out = F.when(have.rlike(pc.anchored(pattern)), lab.put(F.col("labels"), dst, pc.replaced(have, pattern, template))).otherwise(F.col("labels"))
            return pc.Vector(self.unique(v.df.withColumn("labels", out)), True)
        raise QueryError("a log query gives no numbers")

    def operator(self, op: str, as_number: bool):
        """Division and remainder by zero are NaN here."""
        if op == "/":
            return lambda a, b: F.when(b == 0, ieee.num(ieee.NAN)).otherwise(ieee.div(a, b))
        return super().operator(op, as_number)

    def without_name(self, v: pc.Vector) -> pc.Vector:
        return v

    @staticmethod
    def shaped(df: DataFrame) -> DataFrame:
        return df.withColumns({"hist": F.lit(None).cast(hg.HISTOGRAM), "src_ts": F.col("step")})

    def range(self, node: q.Range, label_free: bool = False) -> pc.Vector:
        log = node.log
        if not log.range_ns:
            raise QueryError("a range is needed")
        if label_free or node.op == "absent_over_time":
            log = q.Log(log.matchers, self.without_parsers(log.stages), log.range_ns, log.offset_ns)
        grid = Grid(self.grid.start * MS, self.grid.end * MS, self.grid.step * MS)
        rows = self.streams(log, grid.start - log.offset_ns - log.range_ns, grid.last - log.offset_ns, True)
        bad = F.col("error").isNotNull() & lab.get(F.col("labels"), "__preserve_error__").isNull()
        fail = F.raise_error(F.concat(F.lit("pipeline error: "), F.col("error"))).cast("boolean")
        unwraps = any(s[0] == "unwrap" for s in log.stages)
        key = F.col("labels")
        if node.labels is not None:
            key = lab.drop(key, node.labels) if node.without else lab.keep(key, node.labels)
        plain = {"count_over_time": F.lit(1.0), "bytes_over_time": F.octet_length("line").cast("double"), "bytes_rate": F.octet_length("line").cast("double"), "absent_over_time": F.lit(1.0)}
        value = plain.get(node.op, F.col("value") if unwraps else F.lit(1.0))
        if node.op == "approx_count_distinct":
            value = F.lit(1.0)
        extra = [F.coalesce(lab.get(F.col("labels"), node.param), F.element_at("metadata", node.param)).alias("field")] if node.op == "approx_count_distinct" else []
        rows = rows.withColumn("v", F.when(bad, F.when(fail, ieee.num(0))).otherwise(value)).filter(F.col("v").isNotNull())
        rows = rows.select(key.alias("labels"), "ts_ns", "v", "entry_id", *extra)
        if node.op == "rate_counter":
            rows = neighbours(rows, ["labels"], "ts_ns", {"ts_ns": "pts", "v": "pv"}, log.range_ns, block=6 * 3_600_000 * MS)
        seen = rows.withColumn("step", F.explode(visible(grid, log.offset_ns, F.col("ts_ns"), F.col("ts_ns") + log.range_ns)))
        seen = seen.withColumn("step", (F.col("step") / MS).cast("bigint"))
        seconds = ieee.num(log.range_ns / 1e9)
        by, v = seen.groupBy("labels", "step"), F.col("v")
        if node.op == "absent_over_time":
            return self.absent_streams(seen, log)
        if node.op == "rate_counter":
            return pc.Vector(self.shaped(self.counter(seen, log)), True)
        if node.op == "approx_count_distinct":
            value = F.count_distinct("field").cast("double")
            return pc.Vector(self.shaped(seen.filter(F.col("field").isNotNull()).groupBy("labels", "step").agg(value.alias("value"))), True)
        first, last = F.struct("ts_ns", "entry_id"), F.struct("ts_ns", "entry_id")
        value = {
            "count_over_time": lambda: F.sum(v), "bytes_over_time": lambda: F.sum(v), "rate": lambda: F.sum(v) / seconds, "bytes_rate": lambda: F.sum(v) / seconds, "avg_over_time": lambda: F.avg(v),
            "sum_over_time": lambda: F.sum(v), "min_over_time": lambda: ieee.minimum(v), "max_over_time": lambda: ieee.maximum(v), "stddev_over_time": lambda: F.stddev_pop(v),
            "stdvar_over_time": lambda: F.var_pop(v), "quantile_over_time": lambda: ieee.quantile(node.param, v, -ieee.INF), "first_over_time": lambda: F.min_by(v, first), "last_over_time": lambda: F.max_by(v, last),
        }[node.op]()
        return pc.Vector(self.shaped(by.agg(value.alias("value"))), True)

    def counter(self, seen: DataFrame, log: q.Log) -> DataFrame:
        v, ts = F.col("v"), F.col("ts_ns")
        eff = F.col("step") * MS - log.offset_ns
        pv = F.when(F.col("pts") > eff - log.range_ns, F.col("pv"))
        g = seen.withColumn("_r", F.when(ieee.comparison("<", v, pv), pv).otherwise(0.0)).groupBy("labels", "step").agg(
            F.count("*").alias("n"), F.min("ts_ns").alias("t0"), F.max("ts_ns").alias("t1"), F.min_by("v", ts).alias("v0"), F.max_by("v", ts).alias("v1"), F.sum("_r").alias("r")
        )
        sampled = (F.col("t1") - F.col("t0")) / 1e9
        some = F.when(sampled > 0, sampled).otherwise(1.0)
        every = some / F.greatest(F.col("n") - 1, F.lit(1))
        change = F.col("v1") - F.col("v0") + F.col("r")
        start, end = (F.col("t0") - (eff - log.range_ns)) / 1e9, (eff - F.col("t1")) / 1e9
        start = F.when(start >= every * 1.1, every / 2).otherwise(start)
        zero = some * (F.col("v0") / F.when(change > 0, change).otherwise(1.0))
        start = F.when((change > 0) & (F.col("v0") >= 0) & (zero < start), zero).otherwise(start)
        end = F.when(end >= every * 1.1, every / 2).otherwise(end)
        rate = change * ((some + start + end) / some) / (log.range_ns / 1e9)
        return g.select("labels", "step", F.when((F.col("n") < 2) | (sampled <= 0), ieee.num(0)).otherwise(rate).alias("value"))

    def absent_streams(self, seen: DataFrame, log: q.Log) -> pc.Vector:
        names = [n for n, _, _ in log.matchers]
        pairs = sorted((n, v) for n, op, v in log.matchers if op == "=" and v and names.count(n) == 1)
        own = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in pairs]).cast(lab.LABELS)
        steps = self.grid.steps(self.spark).join(seen.select("step").distinct(), "step", "left_anti")
        return pc.Vector(self.shaped(steps.select(own.alias("labels"), "step", ieee.num(1).alias("value"))), True)

    @staticmethod
    def without_parsers(stages: list[tuple]) -> list[tuple]:
        """Parsers are skipped, errors and all, where nothing reads labels."""
        free = all(s[0] in ("line", "json", "logfmt", "regexp", "pattern", "decolorize", "drop", "keep") for s in stages)
        return [s for s in stages if s[0] in ("line", "decolorize")] if free else stages

    def vector_aggregate(self, node: q.Aggregate) -> pc.Vector:
        inner = node.expr
        grouped = node.without or bool(node.labels)
        free = node.op == "sum" and not grouped and isinstance(inner, q.Range) and inner.op in ("count_over_time", "rate", "bytes_over_time", "bytes_rate") and not any(s[0] == "unwrap" for s in inner.log.stages)
        v = self.range(inner, True) if free else self.eval(inner)
        if isinstance(v, pc.Scalar):
            raise QueryError("a vector is needed")
        key = lab.drop(F.col("labels"), node.labels) if node.without else lab.keep(F.col("labels"), node.labels)
        x = F.col("value")
        if node.op in q.WITH_PARAM:
            if node.op == "approx_topk" and self.grid.count > 1:
                raise QueryError("approx_topk is for instant queries")
            way = x.asc() if node.op == "bottomk" else x.desc()
            w = Window.partitionBy("_g", "step").orderBy(F.isnan(x), way, "labels")
            df = v.df.withColumn("_g", key).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= int(node.param))
            return pc.Vector(df.drop("_g", "_r"), True)
        value = {"sum": lambda: F.sum(x), "avg": lambda: F.avg(x), "min": lambda: ieee.minimum(x), "max": lambda: ieee.maximum(x), "count": lambda: F.count("*").cast("double"), "stddev": lambda: F.stddev_pop(x), "stdvar": lambda: F.var_pop(x)}[node.op]()
        return pc.Vector(self.shaped(v.df.groupBy(key.alias("labels"), "step").agg(value.alias("value"))), True)

    def binary(self, node: q.Binary):
        left, right = self.eval(node.left), self.eval(node.right)
        if isinstance(left, pc.Scalar) and isinstance(right, pc.Scalar):
            f = self.operator(node.op, True)
            return pc.Scalar(column=lambda t: f(left.column(t), right.column(t)), literal=pc.fold(node.op, left.literal, right.literal))
        if isinstance(left, pc.Scalar) or isinstance(right, pc.Scalar):
            if node.op in q.SETS:
                raise QueryError("set operators need vectors")
            return self.binary_scalar(right, left, node.op, False, node.bool_) if isinstance(left, pc.Scalar) else self.binary_scalar(left, right, node.op, True, node.bool_)
        return self.set_operation(left, right, node) if node.op in q.SETS else self.matched(left, right, node)

    def numbers(self, node) -> DataFrame:
        v = self.eval(node)
        if isinstance(v, pc.Scalar):
            return self.as_table(v).select(F.array().cast(lab.LABELS).alias("labels"), "step", "value")
        out = v.df.select("labels", "step", "value")
        if isinstance(node, q.Sort) and self.grid.count == 1:
            return out.orderBy(F.isnan("value"), F.col("value").desc() if node.descending else F.col("value").asc(), "labels")
        return out


def term_counts(terms: list[str]):
    kind = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("tf", T.ArrayType(T.IntegerType()))])

    @F.pandas_udf(kind)
    def run(lines: pd.Series) -> pd.DataFrame:
        out = [analyse(x or "") for x in lines]
        return pd.DataFrame({"size": [len(w) for w in out], "tf": [[w.count(t) for t in terms] for w in out]})

    return run


def query_logs(spark: SparkSession, entries: DataFrame, text: str, start_ns: int, end_ns: int, limit: int | None = None, forward: bool = False) -> DataFrame:
    node = q.parse(text)
    if not isinstance(node, q.Log):
        raise QueryError("this is a metric query")
    return Compiler(spark, entries, Grid(0, 0, 0)).logs(node, start_ns, end_ns, limit, forward)


def query_metric(spark: SparkSession, entries: DataFrame, text: str, start_ms: int, end_ms: int | None = None, step_ms: int = 0, align: bool = False) -> DataFrame:
    """labels, step, value. ``align`` rounds the bounds to multiples of the step, as a dashboard's front end does."""
    node = q.parse(text)
    if isinstance(node, q.Log):
        raise QueryError("this is a log query")
    if align and end_ms is not None and step_ms:
        start_ms, end_ms = start_ms // step_ms * step_ms, -(-end_ms // step_ms) * step_ms
    return Compiler(spark, entries, Grid(start_ms, start_ms if end_ms is None else end_ms, step_ms)).numbers(node)
