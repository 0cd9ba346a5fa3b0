"""Label sets as canonical arrays: sorted by name, without empty values.

The canonical array serves as group, join and window key; maps cannot be keys in Spark.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = "array<struct<name:string,value:string>>"


def canonical(labels: Column, extra: dict[str, Column] | None = None) -> Column:
    """Sorted distinct labels with non-empty name and value; null becomes the empty set.

    ``extra`` labels take the place of those of equal name. One pass over the array, sorted by native order.
    """
    extra = extra or {}
    labels = F.coalesce(labels.cast(LABELS), F.array().cast(LABELS))
    keep = lambda x: (x["value"] != "") & (x["name"] != "")
    if not extra:
        return F.sort_array(F.array_distinct(F.filter(labels, keep)))
    own = F.filter(labels, lambda x: keep(x) & ~x["name"].isin(*extra))
    new = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in extra.items()]), keep)
    return F.sort_array(F.array_distinct(F.concat(own, new)))


def get(labels: Column, name: str) -> Column:
    """Value of one label, null if absent."""
    return F.get(F.filter(labels, lambda x: (x["name"] == name) & (x["value"] != "")), F.lit(0))["value"]


def keep(labels: Column, names: list[str]) -> Column:
    return F.filter(labels, lambda x: x["name"].isin(*names)) if names else F.array().cast(LABELS)


def drop(labels: Column, names: list[str]) -> Column:
    return F.filter(labels, lambda x: ~x["name"].isin(*names)) if names else labels


def put(labels: Column, name: str, value: Column) -> Column:
    """Set a label; an empty or null value removes it. ``labels`` is evaluated once."""
    new = F.filter(F.array(F.struct(F.lit(name).alias("name"), value.alias("value"))), lambda x: x["value"] != "")
    return F.sort_array(F.concat(F.filter(labels, lambda x: x["name"] != name), new))


def from_map(m: Column) -> Column:
    pairs = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return canonical(pairs)


def to_map(labels: Column) -> Column:
    return F.map_from_entries(labels)


def key(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns: a compact 128-bit shuffle key."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("b"), *reversed(columns))]
