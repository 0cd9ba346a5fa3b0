"""At-least-once deliveries to exactly-once rows (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_id(column: Column) -> Column:
    """Identifier without surrounding white space, in lower case; blank becomes null."""
    trimmed = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(trimmed != "", trimmed)


#: Name of the key column while a plan runs; no column of a table should be called so.
KEY = "__skein_request"


def _rank(order: list[tuple[str, str]]) -> Column:
    """Struct whose smallest value is the copy that stays. ``order``: (column, 'asc' | 'desc'), null last in either."""
    parts = []
    for i, (name, way) in enumerate(order):
        value = F.col(name)
        parts += [value.isNull().alias(f"n{i}"), (-value if way == "desc" else value).alias(f"v{i}")]
    return F.struct(*parts)


def survivors(df: DataFrame, scope: list[str], request_id: str, order: list[tuple[str, str]], carry: list[str]) -> DataFrame:
    """The copy of each request that stays, as columns ``carry``.

    One hash aggregation with min_by over an order struct: partial aggregation on the map side leaves at most one
    row per request and task, however hot a request is. Rows with a null or blank identifier are no requests and
    don't appear. ``order`` must end in a unique column; among exactly repeated rows one value comes out.
    """
    keyed = df.withColumn(KEY, normal_id(F.col(request_id))).filter(F.col(KEY).isNotNull())
    best = F.min_by(F.struct(*carry), _rank(order)).alias("__skein_best")
    return keyed.groupBy(*scope, KEY).agg(best).select("__skein_best.*")


def exactly_once(df: DataFrame, scope: list[str], request_id: str, order: list[tuple[str, str]]) -> DataFrame:
    """All columns of ``df`` with one row per request; rows that are never the same request stay as they are.

    Null, blank: kept each. Repeated whole rows of one request: one stays. An empty table gives an empty table.
    """
    blank = df.filter(normal_id(F.col(request_id)).isNull())
    return survivors(df, scope, request_id, order, df.columns).unionByName(blank)


def redelivered(df: DataFrame, scope: list[str], request_id: str, order: list[tuple[str, str]], delivery: str) -> DataFrame:
    """The unique ids (``delivery``) of the rows to remove.

    The anti-join runs on the unique delivery id, not on the request, so a request with a third of all rows
    spreads over all tasks.
    """
    kept = survivors(df, scope, request_id, order, [delivery])
    named = df.filter(normal_id(F.col(request_id)).isNotNull()).select(delivery)
    return named.join(kept, delivery, "left_anti")
