"""Filling containers of fixed capacity with texts (problem 9)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import tokens
from skein.llm.tokens import _encoder, slices

#: Items that a task packs together; bounds its memory, and is large against the bins left open at the end.
BLOCK_ITEMS = 1 << 17
#: Capacities are a table of a few rows; more than this is refused rather than collected.
MOST_SIZES = 1000


def pieces(tokens_of: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, part, size): an item over the capacity gives full parts and a rest, any other is one part."""
    n = np.maximum(1, -(-tokens_of // capacity))
    item = np.repeat(np.arange(len(tokens_of)), n)
    part = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
    return item, part, np.minimum(capacity, tokens_of[item] - part * capacity)


class _Stock:
    """Items by size, to take the largest that fits."""

    def __init__(self, size: np.ndarray):
        items = np.arange(len(size))
        order = np.lexsort((items, size))
        self.sizes, first = np.unique(size[order], return_index=True)
        self.lists = [x.tolist()[::-1] for x in np.split(items[order], first[1:])] if len(items) else []
        self.sizes = self.sizes.tolist()

    def take(self, room: int) -> int | None:
        k = bisect_right(self.sizes, room) - 1
        if k < 0:
            return None
        item = self.lists[k].pop()
        if not self.lists[k]:
            del self.lists[k], self.sizes[k]
        return item

    def above(self, size: int) -> int:
        """How many items are larger than ``size``."""
        return sum(map(len, self.lists[bisect_right(self.sizes, size) :]))


def harmonic(size: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece (sizes from 1 to capacity).

    A piece of class j has a size in (capacity / (j + 1), capacity / j], and a bin of class j takes j of them, so
    every worker fills bins of a class alone. The room that such a bin keeps goes to pieces of later classes, the
    largest that fits first. Pieces that don't make up a whole bin of their class share bins at the end, first fit by
    falling size: their number is less than that of the classes' squares, whatever the number of pieces.
    """
    bin_of = np.full(len(size), -1, np.int64)
    stock, n_bins, left = _Stock(size), 0, []
    while stock.sizes:
        j = capacity // stock.sizes[-1]
        low = capacity // (j + 1)
        have = stock.above(low)
        while have >= j:
            room = capacity
            for _ in range(j):
                item = stock.take(capacity // j)
                bin_of[item] = n_bins
                room -= int(size[item])
            have -= j
            while (item := stock.take(min(room, low))) is not None:
                bin_of[item] = n_bins
                room -= int(size[item])
            n_bins += 1
        left += [stock.take(capacity) for _ in range(have)]
    rooms: list[int] = []
    for item in sorted(left, key=lambda i: (-size[i], i)):
        k = next((i for i, room in enumerate(rooms) if room >= size[item]), len(rooms))
        if k == len(rooms):
            rooms.append(capacity)
        rooms[k] -= int(size[item])
        bin_of[item] = n_bins + k
    return bin_of


def pack(docs: DataFrame, capacities: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """size_name, bin, doc_id, part, first_token, n_tokens: which tokens of which text lie in which container.

    Every text with at least one token is placed whole in one container of each size, or, if it exceeds the
    capacity, in full containers and one rest. Null and empty texts take no part. Repeated rows are placed each.
    Sizes without a name or a positive capacity are left out. A bin's name holds the task and block that filled it, so
    tasks need no word of one another and nothing is shuffled; a repeated task refills all its bins.
    """
    rows = capacities.filter((F.col("capacity_tokens") > 0) & F.col("size_name").isNotNull()).select("size_name", "capacity_tokens").distinct().limit(MOST_SIZES + 1).collect()
    if len(rows) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} container sizes")
    sizes = sorted((int(r.capacity_tokens), r.size_name) for r in rows)
    at = tokens.lexicon_of(docs, text, ranks)
    out = ["size_name", "bin", key, "part", "first_token", "n_tokens"]

    def fill(keys: list, counts: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        names = pa.array(keys)
        for capacity, name in sizes:
            item, part, size = pieces(counts, capacity)
            number = np.empty(len(size), np.int64)
            full = size == capacity
            number[full] = np.arange(int(full.sum()))
            number[~full] = harmonic(size[~full], capacity) + int(full.sum())
            bins = pa.array([f"{name}-{task}-{block}-{b}" for b in number.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(size), pa.string()), bins, names.take(pa.array(item)), pa.array(part, pa.int32()), pa.array(part * capacity, pa.int64()), pa.array(size, pa.int64())], out
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(at)
        keys: list = []
        counts: list[int] = []
        block = 0
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names = batch.column(0).to_pylist()
            for a, b in slices(texts):
                for k, n in zip(names[a:b], enc.encode(texts[a:b])[1].tolist(), strict=True):
                    if n:
                        keys.append(k)
                        counts.append(n)
            if len(keys) >= BLOCK_ITEMS:
                yield from fill(keys, np.array(counts), block)
                keys, counts, block = [], [], block + 1
        if keys:
            yield from fill(keys, np.array(counts), block)

    source = docs.select(key, text)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"size_name string, bin string, {key} {kind}, part int, first_token long, n_tokens long")


def fill_rates(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per size: items, bins, tokens and the share of the bins' capacity that is filled."""
    per = packed.groupBy("size_name").agg(F.count("*").alias("pieces"), F.count_distinct("bin").alias("bins"), F.sum("n_tokens").alias("tokens"))
    return per.join(capacities.select("size_name", "capacity_tokens"), "size_name").select(
        "size_name", "pieces", "bins", "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("filled")
    )
