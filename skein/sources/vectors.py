"""Writes to the ranked store as a log of rows (id, seq, deleted, vector, attributes), and passages of documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.plans.search import filters
from skein.plans.search.rank import latest

#: Characters of a passage, and how many of them the next one repeats.
MAX_CHARS, OVERLAP = 1000, 100


def upsert(log: DataFrame, rows: DataFrame, seq: int) -> DataFrame:
    """Adds whole rows; new attributes extend the schema, a changed type is refused."""
    known = {f.name: f.dataType for f in log.schema}
    for f in rows.schema:
        if f.name in known and known[f.name] != f.dataType:
            raise ValueError(f"the type of {f.name} can't change")
    filters.check_schema(T.StructType([f for f in rows.schema if f.name not in ("seq", "deleted")]))
    return log.unionByName(rows.withColumns({"seq": F.lit(seq).cast("bigint"), "deleted": F.lit(False)}), allowMissingColumns=True)


def patch(log: DataFrame, rows: DataFrame, seq: int) -> DataFrame:
    """Sets the given attributes of rows that exist; their other attributes stay. Others are ignored."""
    changed = [c for c in rows.columns if c != "id"]
    current = latest(log).drop(*changed)
    return upsert(log, current.join(rows, "id"), seq)


def delete(log: DataFrame, ids: DataFrame, seq: int) -> DataFrame:
    gone = ids.select("id").distinct().withColumns({"seq": F.lit(seq).cast("bigint"), "deleted": F.lit(True)})
    return log.unionByName(gone, allowMissingColumns=True)


def delete_by_filter(log: DataFrame, where, seq: int) -> DataFrame:
    return delete(log, filters.apply(latest(log), where), seq)


def apply_batch(log: DataFrame, seq: int, *, where=None, delete_documents: list[str] = (), documents: DataFrame | None = None, rows: DataFrame | None = None, patches: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:  # type: ignore[assignment]
    """One write request: its parts in their fixed order, each with the next seq."""
    if where is not None:
        log = delete_by_filter(log, where, seq)
    if delete_documents:
        gone = latest(log).filter(F.col("`$doc_id`").isin(*delete_documents))
        log = delete(log, gone, seq + 1)
    if documents is not None:
        log = upsert(log, passages(documents), seq + 2)
    if rows is not None:
        log = upsert(log, rows, seq + 3)
    if patches is not None:
        log = patch(log, patches, seq + 4)
    return log if deletes is None else delete(log, deletes, seq + 5)


def compact(log: DataFrame) -> DataFrame:
    """The log with one row per id: its last write, deletions left out."""
    body = [c for c in log.columns if c != "id"]
    one = log.groupBy("id").agg(F.max_by(F.struct(*body), "seq").alias("b")).select("id", "b.*")
    return one.filter(~F.coalesce("deleted", F.lit(False))).select(*log.columns)


def split_passages(text: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """Passages of at most max_chars: whole paragraphs if they fit, else lines, else sentences, else pieces of them.

    A passage starts with the last ``overlap`` characters of the one before, cut at a word.
    """

    def units(part: str, level: int) -> list[str]:
        if len(part) <= max_chars - overlap:
            return [part]
        if level == 3:
            width = max(1, max_chars - overlap)
            return [part[i : i + width] for i in range(0, len(part), width)]
        pieces = re.split((r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?])(?=\s)")[level], part)
        return [u for p in pieces if p for u in units(p, level + 1)]

    out, current = [], ""
    for unit in units(text or "", 0):
        if current.strip() and len(current) + len(unit) > max_chars:
            out.append(current.strip())
            tail = current[-overlap:] if overlap else ""
            current = tail[tail.find(" ") + 1 :] if " " in tail else ""
        current += unit
    if current.strip():
        out.append(current.strip())
    return out


def passages(documents: DataFrame, text: str = "text", max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """id '{document}#{number}', $doc_id, $passage (number), text, and the document's other attributes."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_passages(t, max_chars, overlap))

    rest = [c for c in documents.columns if c not in ("id", text)]
    rows = documents.select(F.col("id").alias("$doc_id"), *rest, F.posexplode(run(text)).alias("$passage", text))
    return rows.withColumn("id", F.concat_ws("#", F.col("`$doc_id`"), F.col("`$passage`")))
