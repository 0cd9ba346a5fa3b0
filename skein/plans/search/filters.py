"""Attribute filters of ranked search: a tree of conditions as one two-valued column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.regex import like
from skein.plans.promql.parser import QueryError

# Operators by their operand.
SINGLE = {"Eq", "NotEq", "Lt", "Lte", "Gt", "Gte"}
MANY = {"In", "NotIn", "ContainsAny", "NotContainsAny"}
ELEMENT = {"Contains", "NotContains"}
GLOBS = {"Glob", "NotGlob", "IGlob", "NotIGlob"}
NEGATED = {"NotEq": "Eq", "NotIn": "In", "NotContains": "Contains", "NotContainsAny": "ContainsAny", "NotGlob": "Glob", "NotIGlob": "IGlob", "NotExists": "Exists"}


def _fits(kind: T.DataType, operand) -> bool:
    if isinstance(operand, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(operand, str):
        return isinstance(kind, T.StringType)
    if isinstance(operand, int):
        return isinstance(kind, (T.IntegralType, T.FractionalType))
    return isinstance(operand, float) and isinstance(kind, T.FractionalType)


def compile_filter(schema: T.StructType, tree) -> Column:
    """``tree``: ["And" | "Or", [trees]], ["Not", tree], [attribute, operator, operand] or [attribute, "Exists" | "NotExists"].

    Never null: an absent attribute fails every condition but the negated ones. Array attributes match by element.
    """
    if not isinstance(tree, (list, tuple)) or not tree:
        raise QueryError(f"bad filter {tree!r}")
    if tree[0] in ("And", "Or") and isinstance(tree[1], (list, tuple)):
        out = F.lit(tree[0] == "And")
        for t in tree[1]:
            c = compile_filter(schema, t)
            out = out & c if tree[0] == "And" else out | c
        return out
    if tree[0] == "Not" and len(tree) == 2:
        return ~compile_filter(schema, tree[1])
    name, op, *rest = tree
    if op in NEGATED:
        return ~compile_filter(schema, [name, NEGATED[op], *rest])
    known = {f.name: f.dataType for f in schema}
    if op == "Exists":
        return F.col(name).isNotNull() if name in known else F.lit(False)
    if len(rest) != 1 or rest[0] is None:
        raise QueryError(f"{op} needs an operand")
    operand = rest[0]
    if op not in SINGLE | MANY | ELEMENT | GLOBS:
        raise QueryError(f"unknown operator {op!r}")
    if op in MANY and not isinstance(operand, (list, tuple)) or op not in MANY and isinstance(operand, (list, tuple, dict)):
        raise QueryError(f"bad operand of {op}")
    if name not in known:
        return F.lit(False)
    kind, array = known[name], isinstance(known[name], T.ArrayType)
    element = kind.elementType if array else kind
    for x in operand if op in MANY else [operand]:
        if not _fits(element, x) or op in GLOBS and not isinstance(x, str):
            raise QueryError(f"{x!r} doesn't fit the type of {name}")
    if (op in ELEMENT or op == "ContainsAny") and not array:
        raise QueryError(f"{op} needs an array attribute")

    def one(x: Column) -> Column:
        if op in GLOBS:
            return F.lower(x).rlike(like(operand.lower())) if op == "IGlob" else x.rlike(like(operand))
        if op in MANY:
            return x.isin(*operand) if operand else F.lit(False)
        return {"Eq": x == operand, "Contains": x == operand, "Lt": x < operand, "Lte": x <= operand, "Gt": x > operand, "Gte": x >= operand}[op]

    hit = F.exists(F.col(name), one) if array else one(F.col(name))
    return F.coalesce(hit, F.lit(False))


def check_schema(schema: T.StructType) -> None:
    """Rules of an attribute schema: names of 1 to 128 bytes, none reserved, only storable types."""
    good = (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.FloatType, T.BooleanType)
    for f in schema:
        if f.name in ("id", "vector"):
            continue
        if not 1 <= len(f.name.encode()) <= 128 or f.name.startswith("$"):
            raise QueryError(f"bad attribute name {f.name!r}")
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if not isinstance(inner, good):
            raise QueryError(f"the type of {f.name} can't be stored")


def apply(rows: DataFrame, tree) -> DataFrame:
    return rows if tree is None else rows.filter(compile_filter(rows.schema, tree))
