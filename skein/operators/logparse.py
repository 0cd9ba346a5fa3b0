"""Semi-structured log lines into fields (problem 3): entries, then iterative partitioning into templates."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein import labels as lab
from skein.functions import logtokens as lt
from skein.runtime import cut, join_checked

#: Ids per window partition: bounds what one task sorts, however many entries a stream has.
CHUNK_IDS = 1 << 17
#: A value splits a partition if this share of its lines has it (and two lines); a position whose splitting values cover
#: less than COVERED of the lines is a variable.
SUPPORT, COVERED = 0.02, 0.5
#: Rows of an object that is cut off: an opening or closing sign or a string, or a bare value.
OBJECT_ROW = re.compile(r'\s*(?:["{}\[\]]|(?:-?\d[\d.eE+-]*|true|false|null)\s*,?\s*$)')
#: Between the masked tokens of a line; part of no token.
SEPARATOR = "\x02"
_decoder = json.JSONDecoder(strict=False)


def entries(logs: DataFrame) -> DataFrame:
    """One row per entry: entry_id, last_entry_id, line (first row), timestamp_ns, component_label, rest (its further
    rows, in order), json (whether the first row begins a JSON object written over several).

    A row belongs to the last opening row before it in its stream (namespace, labels with a value). The look-back
    runs in windows over (stream, block of ids); what a block inherits comes from a window over one row per block,
    so a stream with a third of all rows spreads over tasks. Rows before the first opening row of their stream
    belong to no entry and don't appear; null and blank rows neither. Redelivered rows count once.
    """
    bare = F.regexp_replace("line", lt.COLOUR, "")
    labels = lab.canonical(F.col("labels"))
    rows = (
        logs.filter(F.col("line").isNotNull() & F.col("entry_id").isNotNull())
        .select("entry_id", "namespace", labels.alias("_ls"), "line", "timestamp_ns", bare.alias("_bare"))
        .filter(F.col("_bare").rlike(r"(?U)\S"))
    )
    one, two = lab.key(F.coalesce("namespace", F.lit("")), F.col("_ls"))
    opens = F.col("_bare").rlike(lt.OPENS)
    is_json = F.col("_bare").startswith("{") & ~F.col("_bare").rlike(r"\}\s*$")
    rows = rows.select(
        one.alias("_s1"), two.alias("_s2"), F.floor(F.col("entry_id") / CHUNK_IDS).alias("_block"), "entry_id", "line", "timestamp_ns",
        lab.get(F.col("_ls"), "component").alias("component_label"), opens.alias("_opens"), F.when(opens, F.struct("entry_id", is_json.alias("json"))).alias("_open"),
    )
    stream = ["_s1", "_s2"]
    within = Window.partitionBy(*stream, "_block").orderBy("entry_id")
    rows = cut(rows.withColumn("_own", F.last("_open", ignorenulls=True).over(within)))  # read twice; lines are matched once
    blocks = rows.groupBy(*stream, "_block").agg(F.max("_open").alias("_end"))
    earlier = Window.partitionBy(*stream).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*stream, "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    rows = rows.join(carried, [*stream, "_block"], "left").withColumn("_own", F.coalesce("_own", "_carry")).filter(F.col("_own").isNotNull())
    head = F.when(F.col("_opens"), F.struct("line", "timestamp_ns", "component_label"))
    further = F.array_sort(F.collect_set(F.when(F.col("entry_id") > F.col("_own.entry_id"), F.struct("entry_id", "line"))))
    return (
        rows.groupBy(F.col("_own.entry_id").alias("entry_id"))
        .agg(F.max("entry_id").alias("last_entry_id"), F.max(head).alias("_h"), F.max("_own.json").alias("json"), further.alias("_f"))
        .select("entry_id", "last_entry_id", "_h.line", "_h.timestamp_ns", "_h.component_label", F.transform("_f", lambda p: p["line"]).alias("rest"), "json")
    )


def _object_end(text: str) -> int | None:
    try:
        return _decoder.raw_decode(text)[1]
    except (ValueError, RecursionError):
        return None


def _parts(line: str, rest: list[str], is_json: bool) -> tuple[str, str]:
    """(text that states the fields, what follows it) of an entry; the text is its first row or its JSON object."""
    if not is_json:
        return line, "\n".join(map(lt.plain, rest))
    whole = lt.plain("\n".join([line, *rest]))
    if (end := _object_end(whole)) is not None:
        return whole[:end], whole[end:]
    inside = [OBJECT_ROW.match(r) is not None for r in rest]
    return "\n".join([line, *[r for r, x in zip(rest, inside, strict=True) if x]]), "\n".join(r for r, x in zip(rest, inside, strict=True) if not x)


def _masks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        kinds, masks, texts, tails = [], [], [], []
        for first, rest, is_json in zip(b["line"], b["rest"], b["json"], strict=True):
            text, tail = _parts(first, list(rest), bool(is_json))
            texts.append(text)
            tails.append(tail)
            line = lt.plain(text)
            kinds.append(kind := lt.layout(line))
            masks.append(SEPARATOR.join([lt.mask(k, w).replace(SEPARATOR, " ") for k, w in lt.fields(line, kind)]))
        yield b.drop(columns=["line", "rest", "json"]).assign(text=texts, tail=tails, kind=kinds, masks=masks)


def _shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        masks = [m.split(SEPARATOR) if m else [] for m in b["masks"]]
        yield b.assign(masks=masks, shapes=[[lt.shape(m) for m in ms] for ms in masks])


def _width(base: DataFrame, group: list[str]) -> DataFrame:
    """group, pos, values, tokens, most: the positions that can split a partition, and the values that do.

    At most 1 / SUPPORT values of a position have support, so the lists are bounded, whatever the vocabulary.
    """
    lines = cut(base.groupBy(*group).agg(F.count("*").alias("lines")))
    counted = base.select(*group, F.posexplode("masks").alias("pos", "token")).groupBy(*group, "pos", "token").agg(F.count("*").alias("c"))
    some = join_checked(counted, lines, group).filter((F.col("c") > 1) & (F.col("c") >= F.col("lines") * SUPPORT))
    width = some.groupBy(*group, "pos").agg(
        F.count("*").alias("values"), F.sum("c").alias("covered"), F.max("lines").alias("lines"), F.collect_set("token").alias("tokens"), F.max_by("token", F.struct("c", "token")).alias("most")
    )
    return width.filter((F.col("values") > 1) & (F.col("covered") >= F.col("lines") * COVERED)).drop("covered", "lines")


def templates(distinct: DataFrame) -> DataFrame:
    """mask_key, kind, masks, shapes, leaf of every distinct masked line (columns mask_key, kind, masks, shapes).

    Three partitioning steps over *distinct* masked lines: by layout and token count; by the position with the fewest
    values above one; by a bijection between the two positions whose number of values is the most common one:
    lines split on the side that maps one-to-one or one-to-many, and stay together where many map to many. Only values
    with support split; a line with another value at the splitting position goes with the most frequent one, where
    ``slots`` finds out whether it belongs. What is joined back is one row per partition, or per value of a chosen
    position: broadcast only after it is counted.
    """
    base = distinct.withColumn("n", F.size("masks"))
    first = ["kind", "n"]
    best = F.min_by(F.struct("pos", "tokens", "most"), F.struct("values", "pos")).alias("s")
    narrow = cut(_width(base, first).groupBy(*first).agg(best).select(*first, "s.*"))
    own = F.get("masks", F.col("pos"))
    second = join_checked(base, narrow, first, "left").withColumn("k2", F.coalesce(F.when(F.array_contains("tokens", own), own).otherwise(F.col("most")), F.lit(""))).drop("pos", "tokens", "most")
    group = [*first, "k2"]
    common = cut(
        _width(second, group).groupBy(*group, "values").agg(F.count("*").alias("times"), F.array_sort(F.collect_set("pos")).alias("at"))  # bounded by a line's tokens
        .filter(F.col("times") > 1)
        .groupBy(*group).agg(F.max(F.struct("times", -F.col("values"), "at"))["at"].alias("at"))
        .select(*group, F.get("at", F.lit(0)).alias("pa"), F.get("at", F.lit(1)).alias("pb"))
    )
    third = join_checked(second, common, group, "left").withColumns({"a": F.get("masks", F.col("pa")), "b": F.get("masks", F.col("pb"))}).drop("pa", "pb")
    both = third.filter(F.col("a").isNotNull())
    one = lambda c: F.min(F.xxhash64(c)) == F.max(F.xxhash64(c))
    of_a = cut(both.groupBy(*group, "a").agg(one("b").alias("to_one")).filter("to_one"))
    of_b = cut(both.groupBy(*group, "b").agg(one("a").alias("from_one")).filter("from_one"))
    split = join_checked(join_checked(third, of_a, [*group, "a"], "left"), of_b, [*group, "b"], "left")
    k3 = F.when(F.col("from_one"), F.concat(F.lit("a:"), "a")).when(F.col("to_one"), F.concat(F.lit("b:"), "b")).otherwise("")
    return split.select("mask_key", "kind", "masks", "shapes", F.xxhash64("kind", "n", "k2", k3).alias("leaf"))


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slots of each line: those of its leaf, or its own where its header is built otherwise."""
    for b in batches:
        out, own = [], []
        for kind, shapes, common in zip(b["kind"], b["shapes"], b["common"], strict=True):
            shapes = tuple(shapes)
            common = shapes if common is None else tuple(common)
            fits = lt.fits(shapes, common, kind)
            role = lt.roles_of(common if fits else shapes, kind)
            out.append(" ".join(f"{k}={v}" for k, v in role.items()))
            own.append("" if fits else " ".join(shapes[: 1 + max(role.values(), default=0)]))
        yield pd.DataFrame({"mask_key": b["mask_key"], "leaf": b["leaf"], "own": own, "role": out})


def slots(leaves: DataFrame) -> DataFrame:
    """(mask_key, leaf, role): which token states time, level and component, and where the message begins.

    The leaf decides: of each position the class that most of its distinct lines have there makes up the leaf's
    template, and the header grammar reads the template, not the line. A line whose header differs from the template
    only in an unknown word that stands for its time or its level takes the template's slots nevertheless; one that is built otherwise becomes a leaf of its own, as does a leaf's single line.
    """
    positions = leaves.select("leaf", F.posexplode("shapes").alias("pos", "shape"))
    voted = positions.groupBy("leaf", "pos").agg(F.mode("shape", True).alias("shape"))
    common = cut(voted.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "shape"))).alias("p")).select("leaf", F.transform("p", lambda x: x["shape"]).alias("common")))
    rows = join_checked(leaves.select("mask_key", "leaf", "kind", "shapes"), common, "leaf", "left").select("mask_key", "leaf", "kind", "shapes", "common")
    fitted = rows.mapInPandas(_fitted, "mask_key string, leaf long, own string, role string")
    return fitted.select("mask_key", F.when(F.col("own") == "", F.col("leaf")).otherwise(F.xxhash64("leaf", "own")).alias("leaf"), "role")


@lru_cache(1 << 16)
def _role(text: str) -> dict[str, int]:
    return {k: int(v) for k, v in (x.split("=") for x in text.split())}


def _message(line: str, kind: str, message: str, tail: str) -> str:
    """The header's message, then the entry's further lines: of the same row behind keyed fields, and its further rows."""
    parts = [message]
    if kind != "words" and message != line and "\n" in line:
        end = _object_end(line) if kind == "json" else line.index("\n")
        parts.append(line[end:] if end is not None else "")
    parts.append(lt.plain(tail))
    return "\n".join(p for p in (parts[0], *(x.strip("\r\n") for x in parts[1:])) if p.strip())


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        years = pd.to_datetime(b["timestamp_ns"].fillna(0), unit="ns").dt.year.tolist()
        for text, tail, year, kind, role in zip(b["text"], b["tail"], years, b["kind"], b["role"], strict=True):
            line = lt.plain(text)
            role = _role(role)
            tokens = lt.head(line, 1 + max(role.values(), default=0)) if kind == "words" else lt.fields(line, kind)
            *found, message = lt.extract(line, tokens, role, year)
            out.append((*found, _message(line, kind, message, tail)))
        event, level, name, message = (list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [])
        yield pd.DataFrame({
            "entry_id": b["entry_id"], "last_entry_id": b["last_entry_id"], "timestamp_ns": b["timestamp_ns"], "component_label": b["component_label"],
            "event": pd.array(event, dtype="Int64"), "level": level, "name": name, "message": message, "template": b["leaf"],
        })


def parse(logs: DataFrame) -> DataFrame:
    """entry_id, last_entry_id, event_ms, level, component, message, template: one row per entry.

    ``template`` identifies the leaf whose slots gave the fields. event_ms falls back to the row's timestamp_ns,
    level to 'unknown', component to the stream's label ``component`` (null if it has none). Lines are read whole; ``message`` goes on with the further rows of the entry.
    """
    found = entries(logs)
    kept = [f for f in found.schema if f.name not in ("line", "rest", "json")]
    texts = [T.StructField(n, T.StringType()) for n in ("text", "tail", "kind")]
    masked = found.mapInPandas(_masks, T.StructType([*kept, *texts, T.StructField("masks", T.StringType())]))
    masked = cut(masked.withColumn("mask_key", F.md5(F.concat_ws("\x01", "kind", "masks"))))
    distinct = masked.groupBy("mask_key").agg(F.any_value(F.struct("kind", "masks")).alias("m")).select("mask_key", "m.*")
    shaped = cut(distinct.mapInPandas(_shapes, "mask_key string, kind string, masks array<string>, shapes array<string>"))
    leaves = cut(templates(shaped))
    rows = join_checked(masked.drop("masks"), cut(slots(leaves)), "mask_key")
    fields = rows.mapInPandas(
        _extract, "entry_id long, last_entry_id long, timestamp_ns long, component_label string, event long, level string, name string, message string, template long"
    )
    return fields.select(
        "entry_id", "last_entry_id",
        F.coalesce("event", F.floor(F.col("timestamp_ns") / 1_000_000).cast("bigint")).alias("event_ms"),
        F.coalesce("level", F.lit("unknown")).alias("level"), F.coalesce("name", "component_label").alias("component"), "message", "template",
    )
