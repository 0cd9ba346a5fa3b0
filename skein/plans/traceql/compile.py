"""TraceQL plans over one row per span: filters are columns, structure is joins on (trace_id, parent).

A value is a bundle of columns, one per type, at most one of them not null; all null means missing. Missing operands
make every comparison false. Ancestor and descendant relations run by pointer doubling, others as one semi-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.regex import to_java
from skein.operators import hierarchy
from skein.plans.promql.parser import QueryError
from skein.plans.traceql import parser as p

DEFAULT_LIMIT = 20
ID = ["trace_id", "span_id"]
TOP, BOTTOM = 2.0**63 - 1024, -(2.0**63)


@dataclass
class Value:
    """num with its class (int, float or duration) by ``whole`` and ``span_of_time``; text, flag."""

    num: Column
    text: Column
    flag: Column
    whole: Column
    period: bool = False

    @property
    def there(self) -> Column:
        return self.num.isNotNull() | self.text.isNotNull() | self.flag.isNotNull()


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def number(c: Column, whole: bool | Column = False, period: bool = False) -> Value:
    return Value(c.cast("double"), none("string"), none("boolean"), whole if isinstance(whole, Column) else F.lit(whole), period)


def text(c: Column) -> Value:
    return Value(none("double"), c, none("boolean"), F.lit(False))


def flag(c: Column) -> Value:
    return Value(none("double"), none("string"), c, F.lit(False))


# Columns of the intrinsics, with a prefix that keeps status and kind apart from strings.
PLAIN = {
    "name": ("name", ""), "statusMessage": ("status_message", ""), "status": ("status", "status:"), "kind": ("kind", "kind:"), "trace:id": ("trace_id", ""), "span:id": ("span_id", ""),
    "span:parentID": ("parent_span_id", ""), "scopeName": ("scope_name", ""), "scopeVersion": ("scope_version", ""), "rootName": ("_root_name", ""), "rootService": ("_root_service", ""),
}
DERIVED = {"rootName", "rootService", "traceDuration", "childCount", "nestedSetLeft", "nestedSetRight", "nestedSetParent"}
COUNTED = {"traceDuration": "_trace_duration", "childCount": "_children", "nestedSetLeft": "_left", "nestedSetRight": "_right", "nestedSetParent": "_above"}


def attribute(e: p.Field) -> Value:
    maps = {"span": ["span_attrs"], "resource": ["resource_attrs"], "instrumentation": ["scope_attrs"], "": ["span_attrs", "resource_attrs"]}[e.scope]
    got = F.coalesce(*[F.try_element_at(F.col(m), F.lit(e.name)) for m in maps])
    return Value(F.coalesce(got["i"].cast("double"), got["d"]), got["s"], got["b"], got["i"].isNotNull())


def value(e) -> Value:
    if isinstance(e, p.Static):
        if e.kind in ("int", "float", "duration"):
            return number(F.lit(float(e.value)), e.kind != "float", e.kind == "duration")
        if e.kind == "bool":
            return flag(F.lit(e.value))
        if e.kind == "nil":
            return text(none("string"))
        return text(F.lit(e.value if e.kind == "string" else f"{e.kind}:{e.value}"))
    if isinstance(e, p.Field):
        if e.scope != "intrinsic":
            return attribute(e)
        if e.name == "duration":
            return number(F.col("end_ns") - F.col("start_ns"), True, True)
        if e.name in COUNTED:
            return number(F.col(COUNTED[e.name]), True, e.name == "traceDuration")
        name, prefix = PLAIN[e.name]
        return text(F.concat(F.lit(prefix), F.col(name)) if prefix else F.col(name))
    if e.op in p.COMPARISONS or e.op in ("&&", "||", "not"):
        return flag(truth(e))
    if e.op == "neg":
        v = value(e.args[0])
        return Value(-v.num, none("string"), none("boolean"), v.whole, v.period)
    return arithmetic(e.op, *map(value, e.args))


def arithmetic(op: str, a: Value, b: Value) -> Value:
    """Whole numbers saturate and have no quotient by zero; periods add only to periods; all else is floating."""
    x, y, whole = a.num, b.num, a.whole & b.whole
    safe = F.when(y != 0, y).otherwise(F.lit(1.0))
    raw = {"+": x + y, "-": x - y, "*": x * y, "/": x / safe, "%": x % safe, "^": F.pow(x, y)}[op]
    if op in ("+", "-") and a.period != b.period:
        return number(none("double"))
    if op == "/":
        raw = F.when(whole, F.when(raw < 0, F.ceil(raw)).otherwise(F.floor(raw)).cast("double")).otherwise(raw)
    kept = F.greatest(F.least(raw, F.lit(TOP)), F.lit(BOTTOM))
    out = F.when(whole, kept).otherwise(raw)
    if op in ("/", "%"):
        nan = F.lit(float("nan"))
        if op == "/":
            nan = F.when((x != 0) & ~F.isnan(x), F.signum(x) * F.lit(float("inf"))).otherwise(nan)
        out = F.when(y == 0, F.when(~whole, nan)).otherwise(out)
    return number(out, whole, a.period or b.period)


def truth(e) -> Column:
    """Never null."""
    if isinstance(e, p.Op) and e.op == "&&":
        return truth(e.args[0]) & truth(e.args[1])
    if isinstance(e, p.Op) and e.op == "||":
        return truth(e.args[0]) | truth(e.args[1])
    if isinstance(e, p.Op) and e.op == "not":
        inner = value(e.args[0]).flag if not isinstance(e.args[0], p.Op) else truth(e.args[0])
        return F.coalesce(~inner, F.lit(False))
    if isinstance(e, p.Op) and e.op in p.COMPARISONS:
        return comparison(e)
    return F.coalesce(value(e).flag, F.lit(False))


def comparison(e: p.Op) -> Column:
    a, b = e.args
    nils = [isinstance(x, p.Static) and x.kind == "nil" for x in (a, b)]
    if any(nils):
        if e.op not in ("=", "!="):
            return F.lit(False)
        there = value(a if nils[1] else b).there
        return ~there if e.op == "=" else there
    x, y = value(a), value(b)
    if e.op in ("=~", "!~"):
        if not isinstance(b, p.Static) or b.kind != "string":
            raise QueryError("a regular expression must be a string")
        import re

        try:
            re.compile(b.value)
            hit = x.text.rlike(to_java(b.value))
        except (re.error, ValueError):
            return F.lit(False)
        return F.coalesce(hit if e.op == "=~" else ~hit, F.lit(False))
    no = F.lit(False)
    f = {"=": lambda l, r: l == r, "<": lambda l, r: l < r, "<=": lambda l, r: l <= r, ">": lambda l, r: l > r, ">=": lambda l, r: l >= r}
    if e.op == "!=":
        same = F.coalesce(x.num == y.num, no) | F.coalesce(x.text == y.text, no) | F.coalesce(x.flag == y.flag, no)
        return x.there & y.there & ~same
    hits = [F.coalesce(f[e.op](x.num, y.num) & ~F.isnan(x.num) & ~F.isnan(y.num), no), F.coalesce(f[e.op](x.text, y.text), no)]
    if e.op == "=":
        hits.append(F.coalesce(x.flag == y.flag, no))
    out = no
    for h in hits:
        out = out | h
    return out


def fields(e) -> set[str]:
    if isinstance(e, p.Field):
        return {e.name} if e.scope == "intrinsic" else set()
    return set().union(*map(fields, e.args)) if isinstance(e, p.Op) else set()


def used(query: p.Query) -> set[str]:
    def of(node) -> set[str]:
        if isinstance(node, p.Filter):
            return fields(node.expr) if node.expr is not None else set()
        return of(node.left) | of(node.right)

    out = of(query.spans)
    for stage in query.stages:
        for part in stage[1:]:
            for e in part if isinstance(part, list) else [part]:
                if not isinstance(e, (str, type(None))):
                    out |= fields(e)
    return out


class Compiler:
    def __init__(self, spans: DataFrame):
        self.spans = spans

    # --- derived columns ------------------------------------------------------------------------------------------

    def links(self, rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(F.col("trace_id").alias("tree"), F.col("span_id").alias("node"), F.when(F.col("parent_span_id") != "", F.col("parent_span_id")).alias("parent"), *columns)

    def roots(self) -> DataFrame:
        """Per trace: root span (without a parent in the trace; the earliest, then smallest id), start and duration."""
        s = self.spans
        ids = s.select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_p"))
        service = F.try_element_at("resource_attrs", F.lit("service.name"))["s"]
        rows = s.select(*ID, "parent_span_id", "name", service.alias("service"), "start_ns", "end_ns").join(ids, ["trace_id", "parent_span_id"], "left")
        top = F.when(F.col("_p").isNull(), F.struct("start_ns", "span_id", "name", "service"))
        return rows.groupBy("trace_id").agg(F.min(top).alias("r"), F.min("start_ns").alias("trace_start_ns"), (F.max("end_ns") - F.min("start_ns")).alias("_trace_duration")).select(
            "trace_id", F.col("r.name").alias("_root_name"), F.col("r.service").alias("_root_service"), "trace_start_ns", "_trace_duration"
        )

    def nested_sets(self) -> DataFrame:
        """nestedSet numbers; siblings go by (start, id). Spans that no parentless root reaches have 0; a root's parent is -1."""
        numbers = hierarchy.nested_sets(self.links(self.spans, "start_ns"), "start_ns")
        return numbers.select(F.col("tree").alias("trace_id"), F.col("node").alias("span_id"), *[F.col(c).alias(f"_{c}") for c in ("left", "right", "above")])

    def prepared(self, query: p.Query) -> DataFrame:
        need, rows = used(query), self.spans
        if need & {"rootName", "rootService", "traceDuration"}:
            rows = rows.join(self.roots().drop("trace_start_ns"), "trace_id")
        if "childCount" in need:
            n = self.spans.filter(F.col("parent_span_id").isNotNull()).groupBy("trace_id", F.col("parent_span_id").alias("span_id")).agg(F.count("*").alias("_n"))
            rows = rows.join(n, ID, "left").withColumn("_children", F.coalesce("_n", F.lit(0))).drop("_n")
        if need & {"nestedSetLeft", "nestedSetRight", "nestedSetParent"}:
            rows = rows.join(self.nested_sets(), ID)
        return rows

    # --- spansets -------------------------------------------------------------------------------------------------

    def spanset(self, node, base: DataFrame) -> DataFrame:
        if isinstance(node, p.Filter):
            return base if node.expr is None else base.filter(truth(node.expr))
        if node.op == "||" and isinstance(node.left, p.Filter) and isinstance(node.right, p.Filter):
            conditions = [F.lit(True) if f.expr is None else truth(f.expr) for f in (node.left, node.right)]
            return base.filter(conditions[0] | conditions[1])
        left, right = self.spanset(node.left, base), self.spanset(node.right, base)
        if node.op == "||":
            return self.both(base, left, right)
        if node.op == "&&":
            traces = left.select("trace_id").distinct().join(right.select("trace_id").distinct(), "trace_id", "left_semi")
            return self.both(base, left, right).join(traces, "trace_id", "left_semi")
        mark, op = (node.op[0], node.op[1:]) if node.op[0] in "!&" else ("", node.op)
        hit = self.related(left, right, op)
        if mark == "!":
            return right.join(hit.select(*ID), ID, "left_anti")
        if mark == "&":
            back = {">": "<", "<": ">", ">>": "<<", "<<": ">>", "~": "~"}[op]
            return self.both(base, hit, self.related(hit, left, back))
        return hit

    @staticmethod
    def both(base: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
        keys = a.select(*ID).unionByName(b.select(*ID)).distinct()
        return base.join(keys, ID, "left_semi")

    def related(self, left: DataFrame, right: DataFrame, op: str) -> DataFrame:
        """Spans of ``right`` that stand in the relation to some span of ``left``."""
        if op == ">":
            parents = left.select("trace_id", F.col("span_id").alias("parent_span_id")).distinct()
            return right.join(parents, ["trace_id", "parent_span_id"], "left_semi")
        if op == "<":
            parents = left.filter(F.col("parent_span_id") != "").select("trace_id", F.col("parent_span_id").alias("span_id")).distinct()
            return right.join(parents, ID, "left_semi")
        if op == "~":
            family = left.filter(F.col("parent_span_id") != "").groupBy("trace_id", "parent_span_id").agg(F.min("span_id").alias("_a"), F.max("span_id").alias("_b"))
            joined = right.join(family, ["trace_id", "parent_span_id"])
            return joined.filter((F.col("_a") != F.col("span_id")) | (F.col("_b") != F.col("span_id"))).select(*right.columns)
        marks = left.select(F.col("trace_id").alias("tree"), F.col("span_id").alias("node"), F.lit(True).alias("_in")).distinct()
        traces = left.select("trace_id").distinct().join(right.select("trace_id").distinct(), "trace_id", "left_semi")
        rows = self.links(self.spans.join(traces, "trace_id", "left_semi")).join(marks, ["tree", "node"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
        reached = hierarchy.reach(rows, "_in").filter(F.col("above" if op == ">>" else "below"))
        return right.join(reached.select(F.col("tree").alias("trace_id"), F.col("node").alias("span_id")), ID, "left_semi")

    # --- pipeline -------------------------------------------------------------------------------------------------

    def matched(self, query: p.Query) -> DataFrame:
        """Matched spans: the span's columns, ``spanset`` (null but after by()) and selected fields."""
        rows = self.spanset(query.spans, self.prepared(query)).withColumn("spanset", F.lit(None).cast("string"))
        for stage in query.stages:
            if stage[0] == "filter":
                rows = rows if stage[1] is None else rows.filter(truth(stage[1]))
            elif stage[0] == "by":
                rows = rows.withColumn("spanset", shown(value(stage[1][0])))
            elif stage[0] == "coalesce":
                rows = rows.withColumn("spanset", F.lit(None).cast("string"))
            elif stage[0] == "select":
                rows = rows.withColumns({label(f): shown(value(f)) for f in stage[1]})
            else:
                rows = self.scalar_filter(rows, *stage[1:])
        return rows

    def scalar_filter(self, rows: DataFrame, op: str, left, right) -> DataFrame:
        """Keeps the spansets whose aggregates satisfy the comparison; one partial aggregation per stage."""
        aggs: list[Column] = []

        def build(e) -> Value:
            if isinstance(e, p.Static):
                return value(e)
            if e.op in p.AGGREGATES:
                v = value(e.args[0]).num if e.args else None
                c = {"count": lambda: F.count("*"), "min": lambda: F.min(v), "max": lambda: F.max(v), "avg": lambda: F.avg(v), "sum": lambda: F.sum(v)}[e.op]()
                aggs.append(c.cast("double").alias(name := f"_a{len(aggs)}"))
                return number(F.col(name), e.op == "count", bool(e.args) and value(e.args[0]).period)
            if e.op == "neg":
                v = build(e.args[0])
                return number(-v.num, v.whole, v.period)
            return arithmetic(e.op, build(e.args[0]), build(e.args[1]))

        a, b = build(left).num, build(right).num
        test = {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        key = F.coalesce(F.concat(F.lit("v"), "spanset"), F.lit(""))
        keyed = rows.withColumn("_set", key)
        kept = keyed.groupBy("trace_id", "_set").agg(*(aggs or [F.count("*").alias("_a0")])).filter(F.coalesce(test, F.lit(False))).select("trace_id", "_set")
        return keyed.join(kept, ["trace_id", "_set"], "left_semi").drop("_set")

    def search(self, query: p.Query, limit: int | None = None) -> DataFrame:
        """trace_id, root_service, root_name, start_ns, duration_ns, matched, ordered by (start, id)."""
        counted = self.matched(query).groupBy("trace_id").agg(F.count("*").alias("matched"))
        out = counted.join(self.roots(), "trace_id").select(
            "trace_id", F.col("_root_service").alias("root_service"), F.col("_root_name").alias("root_name"), F.col("trace_start_ns").alias("start_ns"), F.col("_trace_duration").alias("duration_ns"), "matched"
        )
        return out.orderBy("start_ns", "trace_id").limit(DEFAULT_LIMIT if limit is None else limit)


def shown(v: Value) -> Column:
    whole = F.when(v.whole, v.num.cast("bigint").cast("string")).otherwise(v.num.cast("string"))
    return F.coalesce(v.text, v.flag.cast("string"), whole)


def label(e) -> str:
    if isinstance(e, p.Field):
        return e.name if e.scope == "intrinsic" else f"{e.scope}.{e.name}"
    return "expr"


def legacy_tags(tags: str) -> str:
    """The query of a tags=... search: logfmt pairs become conditions on unscoped attributes."""
    from skein.plans.logql.stages import logfmt_pairs

    pairs = logfmt_pairs(tags)
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    return "{ " + " && ".join(f".{k} = {quote(v)}" for k, v in pairs.items()) + " }"


def search(spans: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    return Compiler(spans).search(p.parse(text), limit)


def matched_spans(spans: DataFrame, text: str) -> DataFrame:
    return Compiler(spans).matched(p.parse(text))
