"""Long exact spans shared between records (problem 10)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.runtime import is_small, shared_folder

#: Least length of a shared span, and length of the fingerprinted windows, in code points.
SPAN, GRAM = 160, 64
#: Code points that are fingerprinted at a time; a longer text goes in pieces that overlap by SPAN - 1.
PIECE = 1 << 20
#: Runs of one level that are compacted into one run of the next.
FAN_IN = 2
#: Batches in which a whole table enters a new index.
BATCHES = 3
#: Keys of documents with candidates are broadcast, to keep other texts out of the shuffle, if there are at most so many.
FILTER_DOCS = 1 << 20

# Multiplier of the rolling hash with its inverse modulo 2^64, and a public 64-bit mixer's constants.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
MIX_ADD, MIX_1, MIX_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
POSITION = np.uint64((1 << 24) - 1)
#: Bits of an anchor's offset and number of windows in a packed spot; both are less than the span.
SPOT_BITS = 12


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the multiplier and of its inverse, as far as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_powers = _Powers()


def anchors(points: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: (text, first window, offset of the anchor in it, number of windows, hash).

    Every window of ``span`` code points within a text has one anchor: the gram in it whose hash is smallest, the
    leftmost of equals. That choice depends on the window alone, so equal windows of different texts have the same
    anchor hash at the same offset. Neighbouring windows with one anchor form one row.
    """
    n = len(points)
    if n < span:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    up, down = _powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(points.astype(np.uint64) * MIX_ADD + MIX_ADD) * up[:n], out=sums[1:])
    grams = _mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    best = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    width, reach = 1, span - gram + 1
    while width < reach:
        step = min(width, reach - width)
        best = np.minimum(best[: len(best) - step], best[step:])
        width += step
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(best)]
    first = np.nonzero(np.arange(len(best)) + span <= ends[text])[0]
    if not len(first):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    at, text = (best[first] & POSITION).astype(np.int64), text[first]
    new = np.ones(len(first), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    head = np.nonzero(new)[0]
    count = np.diff(head, append=len(first))
    begin = np.concatenate([[0], ends[:-1]])[text[head]]
    return text[head], first[head] - begin, at[head] - first[head], count, grams[at[head]]


def _settled(run: np.ndarray, hashed: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows whose hash two other documents of the same run have in these rows already: candidates beyond doubt."""
    order = np.lexsort((doc, hashed, run))
    r, h, d = run[order], hashed[order], doc[order]
    group = np.ones(len(r), bool)
    group[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    other = np.cumsum(group | np.concatenate([[True], d[1:] != d[:-1]])[: len(d)])  # numbers the (run, hash, doc)
    first = other[np.maximum.accumulate(np.where(group, np.arange(len(r)), 0))]
    out = np.zeros(len(r), bool)
    out[order] = other - first >= 2
    return out


def _anchor_rows(span: int, gram: int):
    """Anchor rows of texts: input doc, text, run.

    ``slot`` is the hash, by which runs are bucketed and sorted. Of the rows of a block of texts that share a hash those of
    two documents keep it; the others are settled as candidates (``hot`` holds their hash) and get slots of their own, so
    a passage in a third of all texts fills no bucket. ``spot`` packs first window, offset of the anchor and number of windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pieces: list[tuple[int, int, str]], keys: np.ndarray, runs: np.ndarray) -> pa.RecordBatch:
            points = np.frombuffer("".join(p[2] for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
            text, first, offset, count, hashed = anchors(points, np.cumsum([len(p[2]) for p in pieces]), span, gram)
            row, shift = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
            doc, batch, settled = keys[row[text]], runs[row[text]], np.zeros(len(text), bool)
            if len(text):
                settled = _settled(batch, hashed, doc)
            slot = np.where(settled, _mix(hashed ^ _mix(doc.astype(np.uint64))), hashed).view(np.int64)
            spot = (first + shift[text]) << 2 * SPOT_BITS | offset << SPOT_BITS | count
            columns = [pa.array(slot), pa.array(hashed.view(np.int64), mask=~settled), pa.array(doc), pa.array(spot)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(batch.astype(np.int32))], SCHEMA.names)

        for batch in batches:
            keys, runs = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            pieces, size = [], 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                for at in range(0, max(1, len(t) - span + 1), PIECE):
                    part = t[at : at + PIECE + span - 1]
                    if size and size + len(part) > PIECE + span:
                        yield out(pieces, keys, runs)
                        pieces, size = [], 0
                    pieces.append((i, at, part))
                    size += len(part)
            if pieces:
                yield out(pieces, keys, runs)

    return run


_FIELDS = (("slot", T.LongType()), ("hot", T.LongType()), ("doc", T.LongType()), ("spot", T.LongType()), ("run", T.IntegerType()))
SCHEMA = T.StructType([T.StructField(n, k) for n, k in _FIELDS])


def keyed(docs: DataFrame, doc_id: str, text: str, span: int = SPAN) -> DataFrame:
    """doc (40-bit key of id and text), doc_id and text of the rows that can hold a span at all.

    Two texts may have one key: then spots of one are also cut out of the other, where they are compared by their
    characters like all others, so the result stays the same.
    """
    return docs.filter((F.char_length(text) >= span) & F.col(doc_id).isNotNull()).select(F.shiftrightunsigned(F.xxhash64(doc_id, text), 24).alias("doc"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))


class FingerprintIndex:
    """Log-structured index: immutable runs of anchor rows in the shared folder, bucketed and sorted by hash.

    All runs are partitions of one table with the same buckets, so what is joined or merged by hash lies in the same
    task already: a batch shuffles its own rows once, as they are written, and the history never. ``add`` writes the
    runs of one or more batches; ``matches`` merge-joins the hashes of a run with those of all runs up to it;
    ``compact`` merges FAN_IN runs of a level into one run of the next. The list of runs lives in the driver (one entry a
    run); the rows never do. ``buckets`` (the session's shuffle partitions if not given) must suit the history.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, span: int = SPAN, gram: int = GRAM, buckets: int | None = None):
        if span >= 1 << SPOT_BITS:
            raise ValueError(f"spans must be shorter than {1 << SPOT_BITS}")
        self.spark, self.span, self.gram = spark, span, gram
        name = f"fingerprints_{uuid.uuid4().hex}"
        self.folder, self.table = folder or f"{shared_folder(spark).rstrip('/')}/{name}", name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, int]] = []
        self.next = 0

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 1) -> list[int]:
        """Fingerprints ``docs`` as so many batches (by a hash of the id), each a run of level 0, in one pass."""
        run = (F.lit(self.next) + F.pmod(F.xxhash64("doc_id"), F.lit(batches))).cast("int")
        rows = keyed(docs, doc_id, text, self.span).select("doc", "text", run.alias("run")).mapInArrow(_anchor_rows(self.span, self.gram), SCHEMA)
        new = list(range(self.next, self.next + batches))
        self._write(rows.repartition(self.buckets, "slot"), 0)
        self.runs += [(0, r) for r in new]
        self.next += batches
        return new

    def _write(self, rows: DataFrame, level: int) -> None:
        writer = rows.select(*[f.name for f in SCHEMA if f.name != "run"], F.lit(level).alias("level"), "run").write.mode("append").format("parquet").partitionBy("level", "run").bucketBy(self.buckets, "slot").sortBy("slot")
        writer.option("compression", "zstd").option("path", self.folder).saveAsTable(self.table)

    def rows(self, runs: list[int] | None = None) -> DataFrame:
        """Rows of the runs, with their hash as ``h``."""
        kept = [(v, r) for v, r in self.runs if runs is None or r in runs]
        chosen = F.lit(False)
        for v, r in kept:
            chosen = chosen | ((F.col("level") == v) & (F.col("run") == r))
        return self.spark.table(self.table).filter(chosen).select("slot", F.coalesce("hot", "slot").alias("h"), "hot", "doc", "spot", "run")

    def matches(self, run: int) -> DataFrame:
        """Rows of the runs up to ``run`` whose hash occurs in it and in two documents of all: candidates, to be verified."""
        rows = self.rows([r for _, r in self.runs if r <= run])
        plain = rows.filter(F.col("hot").isNull())
        hashes = plain.groupBy("slot").agg(F.min("doc").alias("one"), F.max("doc").alias("other"), F.max("run").alias("newest")).filter((F.col("one") != F.col("other")) & (F.col("newest") == run)).select("slot")
        settled = rows.filter(F.col("hot").isNotNull() & (F.col("run") == run))
        return plain.join(hashes.hint("merge"), "slot").select(CANDIDATE).unionByName(settled.select(CANDIDATE))

    def compact(self, upto: int | None = None) -> None:
        """Merges full levels of the runs up to ``upto`` (of all). The merged run takes the highest number of its parts."""
        for level in sorted({v for v, _ in self.runs}):
            own = [r for v, r in self.runs if v == level and (upto is None or r <= upto)]
            if len(own) < FAN_IN:
                continue
            conf, key = self.spark.conf, "spark.sql.sources.bucketing.autoBucketedScan.enabled"
            before = conf.get(key)
            conf.set(key, "false")  # one task a bucket, so that each bucket becomes one file
            try:
                rows = self.spark.table(self.table).filter((F.col("level") == level) & F.col("run").isin(own))
                self._write(rows.withColumn("run", F.lit(max(own))), level + 1)
            finally:
                conf.set(key, before)
            self.runs = [x for x in self.runs if x[0] != level or x[1] not in own] + [(level + 1, max(own))]
            for r in own:
                _delete(self.spark, f"{self.folder}/level={level}/run={r}")
            self.spark.catalog.refreshTable(self.table)


CANDIDATE = ["h", "doc", "spot"]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _written(rows: DataFrame) -> DataFrame:
    """The rows as a compressed table in the shared folder: read three times, recomputed never."""
    path = f"{shared_folder(rows.sparkSession).rstrip('/')}/cuts-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _strong(value: Column) -> list[Column]:
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


def shared_windows(candidates: DataFrame, docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, doc, first, last: stretches of windows (by their start) that another doc_id holds too, verified.

    ``candidates``: anchor rows; ``docs``: doc, doc_id, text. Each candidate row is cut out of its text; rows with
    one hash and equal characters form a class. A class of two documents is shared as a whole. Where a hash has
    several classes, their single windows are compared by a 96-bit key of their characters. Both are hash
    aggregations with map-side partials: a passage in a third of all texts collapses before the shuffle, and no
    pairs are formed.
    """
    low = (1 << SPOT_BITS) - 1
    first, windows = F.shiftright("spot", 2 * SPOT_BITS).cast("int").alias("first"), F.col("spot").bitwiseAND(F.lit(low)).cast("int").alias("windows")
    spots = candidates.select("doc", "h", first, windows).groupBy("doc").agg(F.collect_set(F.struct("h", "first", "windows")).alias("spots"))  # bounded by one text
    named = candidates.select("doc").distinct()
    held = docs.join(F.broadcast(named), "doc", "left_semi") if is_small(named, FILTER_DOCS) else docs
    cuts = held.join(spots, "doc").select(
        "doc", "doc_id",
        F.explode(F.expr(f"transform(spots, s -> struct(s.h as h, s.first as first, s.windows as windows, substring(text, s.first + 1, s.windows + {span - 1}) as piece))")).alias("s"),
    ).select("doc", "doc_id", "s.*").filter(F.char_length("piece") == F.col("windows") + span - 1)
    one, two = _strong(F.col("piece"))
    number = F.monotonically_increasing_id().alias("cut")
    cuts = _written(cuts.select("doc", "doc_id", "h", "first", "windows", one.alias("c1"), two.alias("c2"), "piece", number))
    classes = cuts.groupBy("h", "c1", "c2", "piece", "windows").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("cut").alias("cut"))
    whole = classes.filter(F.col("lo") != F.col("hi")).select("c1", "c2", F.array(F.struct(F.lit(0).alias("a"), (F.col("windows") - 1).cast("int").alias("b"))).alias("parts"))
    several = classes.groupBy("h").agg(F.count("*").alias("k"), F.min("lo").alias("l"), F.max("hi").alias("u")).filter((F.col("k") > 1) & (F.col("l") != F.col("u"))).select("h")
    window = F.expr(f"substring(piece, i + 1, {span})")
    windows = classes.join(several, "h").select("cut", "piece", "lo", "hi", F.explode(F.sequence(F.lit(0), F.col("windows").cast("int") - 1)).alias("i"))
    windows = windows.select("cut", "lo", "hi", "i", F.xxhash64(window).alias("w1"), F.hash(window).alias("w2"))
    common = windows.groupBy("w1", "w2").agg(F.min("lo").alias("l"), F.max("hi").alias("u")).filter(F.col("l") != F.col("u")).select("w1", "w2")
    loose = windows.filter(F.col("lo") == F.col("hi")).select("cut", F.col("i").cast("int"), "w1", "w2").join(common, ["w1", "w2"])
    partly = loose.groupBy("cut").agg(F.array_sort(F.collect_set(F.struct(F.col("i").alias("a"), F.col("i").alias("b")))).alias("parts"))
    found = whole.unionByName(classes.select("cut", "c1", "c2").join(partly, "cut").drop("cut"))
    return cuts.select("doc", "doc_id", "first", "c1", "c2").join(found, ["c1", "c2"]).select("doc_id", "doc", "first", F.explode("parts").alias("p")).select(
        "doc_id", "doc", (F.col("first") + F.col("p.a")).alias("first"), (F.col("first") + F.col("p.b")).alias("last")
    )


def shared_chars(windows: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, shared_chars: code points under at least one shared window, each once."""
    ordered = F.array_sort(F.collect_set(F.struct("first", (F.col("last") + span).alias("end"))))  # bounded by one text
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("to"))
    grow = lambda s, x: F.struct(
        (s["sum"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["first"]))).cast("long").alias("sum"), F.greatest(s["to"], x["end"]).alias("to")
    )
    per = windows.groupBy("doc_id", "doc").agg(ordered.alias("w")).select("doc_id", F.aggregate("w", zero, grow)["sum"].alias("n"))
    return per.groupBy("doc_id").agg(F.sum("n").alias("shared_chars"))


def spans(windows: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, start, length: the maximal stretches of shared characters (0-based code points)."""
    ordered = F.array_sort(F.collect_set(F.struct("first", (F.col("last") + span).alias("end"))))
    start = F.array().cast("array<struct<first:int,end:int>>")
    grow = lambda s, x: F.when(
        (F.size(s) > 0) & (F.element_at(s, -1)["end"] >= x["first"]),
        F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(F.element_at(s, -1)["first"].alias("first"), F.greatest(F.element_at(s, -1)["end"], x["end"]).alias("end")))),
    ).otherwise(F.concat(s, F.array(x)))
    per = windows.groupBy("doc_id", "doc").agg(ordered.alias("w")).select("doc_id", F.explode(F.aggregate("w", start, grow)).alias("s"))
    return per.select("doc_id", F.col("s.first").alias("start"), (F.col("s.end") - F.col("s.first")).alias("length"))


def shared_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """Shared windows of a whole table, which enters a new index in ``batches`` batches.

    Each batch is merge-joined with all runs before it and with itself, and full levels are compacted on the way; the
    candidates of all batches are verified together. Null, empty and short texts share nothing, nor do rows without
    an id. The same text under one doc_id twice is no sharing; exact copies under two ids share everything. An empty table
    gives an empty result.
    """
    index = FingerprintIndex(docs.sparkSession, span=span, gram=gram)
    found = f"{index.folder}-found"
    for run in index.add(docs, doc_id, text, batches):
        index.matches(run).write.mode("append").option("compression", "zstd").parquet(found)
        index.compact(run)
    schema = T.StructType([T.StructField("h", T.LongType()), *[f for f in SCHEMA if f.name in CANDIDATE]])
    rows = docs.sparkSession.read.schema(schema).parquet(found)
    return shared_windows(rows, keyed(docs, doc_id, text, span), span)
