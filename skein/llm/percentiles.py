"""Percentiles with bounded relative rank error from mergeable sketches (problem 6).

A sketch is a stack of relative compactors. Level h holds items of weight 2^h. A full level is sorted and only its
part away from the protected tail is compacted: every second item, odd or even by a coin, moves up with doubled
weight. How much stays follows the number of trailing ones of a per-level counter, so items nearer to the tail are
compacted exponentially more rarely. Ranks near the protected tail are exact or off by a small share of their
distance from that tail; sketches of tasks, files or days merge level by level with the same guarantee.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Section size; the relative rank error is about 1.5 / K at the protected tail and 3 / K at most elsewhere.
K = 64
#: Items that a task keeps in all its sketches before it hands them on.
TASK_ITEMS = 1 << 21
#: Merge fan-in is split over this many parts per group before the last merge.
MERGE_PARTS = 16


class Sketch:
    """Relative-error quantile sketch; ``high`` says which tail is protected."""

    def __init__(self, k: int = K, high: bool = True, seed: int = 1):
        self.k, self.high, self.n, self.low_value, self.top_value = k, high, 0, np.inf, -np.inf
        self.rng = np.random.default_rng(seed)
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.states, self.sections, self.sizes = [0], [3], [float(k)]

    def _capacity(self, h: int) -> int:
        return 2 * self.sections[h] * self._size(h)

    def _size(self, h: int) -> int:
        return max(4, int(round(self.sizes[h] / 2)) * 2)

    def _grow(self) -> None:
        self.levels.append(np.zeros(0))
        self.states.append(0)
        self.sections.append(3)
        self.sizes.append(float(self.k))

    def add(self, values: np.ndarray) -> None:
        """Finite or infinite numbers; NaN must be left out before."""
        if not len(values):
            return
        self.n += len(values)
        self.low_value, self.top_value = min(self.low_value, float(values.min())), max(self.top_value, float(values.max()))
        at = 0
        while at < len(values):
            room = max(1, self._capacity(0) - len(self.levels[0]))
            self.levels[0] = np.concatenate([self.levels[0], values[at : at + room]])
            at += room
            self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            if len(self.levels[h]) >= self._capacity(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        items = np.sort(self.levels[h])
        if not self.high:
            items = items[::-1]
        ones = (~self.states[h] & (self.states[h] + 1)).bit_length() - 1  # trailing ones
        spare = self._capacity(h) // 2 + max(0, self.sections[h] - 1 - ones) * self._size(h)
        n = (len(items) - spare) // 2 * 2
        if n < 2:
            n = len(items) // 4 * 2
        if h + 1 == len(self.levels):
            self._grow()
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], items[int(self.rng.integers(2)) : n : 2]])
        self.levels[h] = items[n:]
        self.states[h] += 1
        if self.states[h] >= 1 << (self.sections[h] - 1) and self.sizes[h] / np.sqrt(2) >= 4:
            self.sections[h] *= 2
            self.sizes[h] /= np.sqrt(2)

    def merge(self, other: Sketch) -> Sketch:
        if other.n == 0:
            return self
        self.n += other.n
        self.low_value, self.top_value = min(self.low_value, other.low_value), max(self.top_value, other.top_value)
        while len(self.levels) < len(other.levels):
            self._grow()
        for h, items in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], items])
            self.states[h] |= other.states[h]
            if other.sections[h] > self.sections[h]:
                self.sections[h], self.sizes[h] = other.sections[h], other.sizes[h]
        self._compress()
        return self

    def quantiles(self, shares: list[float]) -> list[float | None]:
        """Of each share q the smallest item whose rank reaches q * n; the extremes are exact."""
        if not self.n:
            return [None] * len(shares)
        items = np.concatenate(self.levels)
        weight = np.concatenate([np.full(len(x), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        items, upto = items[order], np.cumsum(weight[order])
        out = []
        for q in shares:
            at = int(np.searchsorted(upto, np.ceil(q * upto[-1]), "left"))
            out.append(self.low_value if q <= 0 else self.top_value if q >= 1 else float(items[min(at, len(items) - 1)]))
        return out

    @property
    def kept(self) -> int:
        return sum(map(len, self.levels))

    def to_bytes(self) -> bytes:
        head = struct.pack("<iqBddi", self.k, self.n, self.high, self.low_value, self.top_value, len(self.levels))
        body = [struct.pack("<qidi", s, c, z, len(x)) + x.astype("<f8").tobytes() for x, s, c, z in zip(self.levels, self.states, self.sections, self.sizes, strict=True)]
        return head + b"".join(body)

    @classmethod
    def from_bytes(cls, data: bytes, seed: int = 1) -> Sketch:
        k, n, high, low, top, levels = struct.unpack_from("<iqBddi", data)
        s = cls(k, bool(high), seed)
        s.n, s.low_value, s.top_value = n, low, top
        s.levels, s.states, s.sections, s.sizes = [], [], [], []
        at = struct.calcsize("<iqBddi")
        for _ in range(levels):
            state, sections, size, count = struct.unpack_from("<qidi", data, at)
            at += struct.calcsize("<qidi")
            s.levels.append(np.frombuffer(data, "<f8", count, at).copy())
            at += 8 * count
            s.states.append(state)
            s.sections.append(sections)
            s.sizes.append(size)
        return s


class Ends:
    """Two sketches of the same values, one protecting each tail; as long as nothing was compacted one holds them all.

    Shares below one half are read from the sketch that protects the low tail.
    """

    def __init__(self, k: int = K, seed: int = 1):
        self.low, self.high = Sketch(k, False, seed), Sketch(k, True, seed + 1)

    def add(self, values: np.ndarray) -> None:
        self.low.add(values)
        self.high.add(values)

    @property
    def n(self) -> int:
        return self.high.n

    @property
    def kept(self) -> int:
        return self.low.kept + self.high.kept

    def merge(self, other: Ends) -> Ends:
        self.low.merge(other.low)
        self.high.merge(other.high)
        return self

    def quantiles(self, shares: list[float]) -> list[float | None]:
        low, high = self.low.quantiles(shares), self.high.quantiles(shares)
        return [a if q < 0.5 else b for q, a, b in zip(shares, low, high, strict=True)]

    def to_bytes(self) -> bytes:
        high = self.high.to_bytes()
        return struct.pack("<i", len(high)) + high + (self.low.to_bytes() if len(self.high.levels) > 1 or len(self.low.levels) > 1 else b"")

    @classmethod
    def from_bytes(cls, data: bytes, seed: int = 1) -> Ends:
        size = struct.unpack_from("<i", data)[0]
        ends = cls.__new__(cls)
        ends.high = Sketch.from_bytes(data[4 : 4 + size], seed + 1)
        ends.low = Sketch.from_bytes(data[4 + size :] if len(data) > 4 + size else data[4 : 4 + size], seed)
        ends.low.high = False
        return ends


def _seed(*parts: object) -> int:
    """Of the task and the group, so that the coins of different sketches are independent and errors cancel out."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=7).digest(), "little")


def sketches(df: DataFrame, keys: list[str], value: Column, k: int = K) -> DataFrame:
    """keys, part, n, sketch: partial sketches per group, made in one pass over each partition, without a shuffle.

    Null and NaN values don't count; infinite ones do. Null keys are a group of their own. Repeated rows count each.
    A task holds values by the numbers of their groups, up to TASK_ITEMS of them, then sorts them by group and gives each
    sketch its values at once; when the sketches hold TASK_ITEMS items they are handed on, so many groups don't grow
    its memory. ``part`` spreads the sketches of a group over the first merge.
    """
    rows = df.select(*keys, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        numbers: dict[tuple, int] = {}
        held: dict[int, Ends] = {}
        codes: list[np.ndarray] = []
        values: list[np.ndarray] = []
        types: list[pa.DataType] = []

        def settle() -> None:
            code, value = np.concatenate(codes), np.concatenate(values)
            codes.clear(), values.clear()
            order = np.argsort(code, kind="stable")
            code, value = code[order], value[order]
            cuts = np.nonzero(code[1:] != code[:-1])[0] + 1
            for group, part in zip(code[np.concatenate([[0], cuts])].tolist(), np.split(value, cuts), strict=True):
                if group not in held:
                    held[group] = Ends(k, _seed(task, group))
                held[group].add(part)

        def out() -> pa.RecordBatch:
            names = list(numbers)
            columns = [pa.array([names[g][i] for g in held], t) for i, t in enumerate(types)]
            counts = [pa.array([task % MERGE_PARTS] * len(held), pa.int32()), pa.array([s.n for s in held.values()], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *counts, pa.array([s.to_bytes() for s in held.values()], pa.binary())], [*keys, "part", "n", "sketch"])

        for b in batches:
            if not len(b):
                continue
            types = [b.column(i).type for i in range(len(keys))]
            coded = [b.column(i).dictionary_encode(null_encoding="encode") for i in range(len(keys))]
            code, names = np.zeros(len(b), np.int64), [c.dictionary.to_pylist() for c in coded]
            for c, own in zip(coded, names, strict=True):
                code = code * len(own) + c.indices.to_numpy()
            groups, local = np.unique(code, return_inverse=True)
            own_numbers = np.zeros(len(groups), np.int64)
            for at, g in enumerate(groups.tolist()):
                key = []
                for own in reversed(names):
                    g, i = divmod(g, len(own))
                    key.append(own[i])
                own_numbers[at] = numbers.setdefault(tuple(reversed(key)), len(numbers))
            codes.append(own_numbers[local])
            values.append(b.column(len(keys)).to_numpy())
            if sum(map(len, values)) >= TASK_ITEMS:
                settle()
                if sum(s.kept for s in held.values()) > TASK_ITEMS or len(numbers) > TASK_ITEMS:
                    yield out()
                    held.clear(), numbers.clear()
        if values:
            settle()
        if held:
            yield out()

    return rows.mapInArrow(run, f"{kinds}, part int, n long, sketch binary")


def merged(parts: DataFrame, keys: list[str], keep_part: bool = False) -> DataFrame:
    """One sketch per group (and part): merges those of tasks, files or days, which lie side by side in a sorted task."""
    by = [*keys, "part"] if keep_part else keys
    rows = parts.select(*by, "n", "sketch")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole, done, schema = None, None, [], None

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k, _ in done], schema.types[i]) for i in range(len(by))]
            both = [pa.array([s.n for _, s in done], pa.int64()), pa.array([s.to_bytes() for _, s in done], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, *both], schema.names)

        for b in batches:
            schema = b.schema
            for *own, data in zip(*[b.column(i).to_pylist() for i in range(len(by))], b.column(len(by) + 1).to_pylist(), strict=True):
                if whole is not None and own == key:
                    whole.merge(Ends.from_bytes(data))
                    continue
                if whole is not None:
                    done.append((key, whole))
                key, whole = own, Ends.from_bytes(data, _seed(own, len(by)))
            if len(done) >= 256:
                yield out()
                done = []
        if whole is not None:
            done.append((key, whole))
            yield out()

    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, kinds)


def combined(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Merge in two steps, so that a group that occurs in every task isn't merged by one task alone."""
    return merged(merged(parts, keys, keep_part=True), keys)


def read_out(sketched: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Replaces the sketch by a column per share."""
    kept = [f for f in sketched.schema if f.name not in ("sketch", "part")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [Ends.from_bytes(x).quantiles(list(shares.values())) for x in b.column(b.num_columns - 1).to_pylist()]
            columns = [pa.array([v[i] for v in values], pa.float64()) for i in range(len(shares))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *columns], [f.name for f in kept] + list(shares))

    return sketched.select(*[f.name for f in kept], "sketch").mapInArrow(run, kinds + "".join(f", `{s}` double" for s in shares))
