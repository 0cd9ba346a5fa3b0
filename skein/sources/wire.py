"""Remote-write bodies: raw Snappy blocks holding protobuf messages, read without generated code."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skein.functions.histograms import HISTOGRAM
from skein.labels import LABELS

#: Bit pattern of the float that marks the end of a series.
STALE_BITS = 0x7FF0000000000002
SNAPPY = pa.Codec("snappy")
#: No element of a Snappy block stands for more than 64 bytes by 3 of its own, so a longer length is a broken one.
SNAPPY_GROWTH = 22
#: Rows of a batch that is handed on, and label sets that are kept between batches.
BATCH_ROWS, KEPT_SETS = 10_000, 20_000
DOUBLE = struct.Struct("<d")
ONE_BYTE = [bytes([n]) for n in range(128)]
SCHEMA = f"labels {LABELS}, ts_ms long, value double, stale boolean, hist {HISTOGRAM}"


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def unsnappy(data: bytes) -> bytes:
    """Raw Snappy: a length, then literals and back references."""
    size, _ = varint(data, 0)
    if size > SNAPPY_GROWTH * len(data):
        raise ValueError("bad Snappy length")
    try:
        return SNAPPY.decompress(data, size, asbytes=True)
    except OSError as e:
        raise ValueError("bad Snappy block") from e


def scan(data: bytes, at: int, end: int) -> list[tuple[int, int, int, int]]:
    """(field number, wire type, start, stop) of each field of the message in data[at:end]; a varint's value is at start."""
    out = []
    while at < end:
        key = data[at]
        at += 1
        if key > 127:
            key, at = varint(data, at - 1)
        kind = key & 7
        if kind == 2:
            n = data[at]
            at += 1
            if n > 127:
                n, at = varint(data, at - 1)
            out.append((key >> 3, kind, at, at + n))
            at += n
        elif kind == 0:
            value, at = varint(data, at)
            out.append((key >> 3, kind, value, at))
        elif kind == 1 or kind == 5:
            n = 8 if kind == 1 else 4
            out.append((key >> 3, kind, at, at + n))
            at += n
        else:
            raise ValueError("bad protobuf wire type")
    if at > end:
        raise ValueError("protobuf field beyond its message")
    return out


def message(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value): ints for varints and fixed widths as raw bytes, bytes for nested fields."""
    for field, kind, start, stop in scan(data, 0, len(data)):
        yield field, data[start:stop] if kind else start


def signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def zigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def packed(value, kind: str) -> list:
    if not isinstance(value, (bytes, bytearray)):
        return [zigzag(value) if kind == "zigzag" else value]
    if kind == "double":
        return list(struct.unpack(f"<{len(value) // 8}d", value))
    out, at = [], 0
    while at < len(value):
        v, at = varint(value, at)
        out.append(zigzag(v) if kind == "zigzag" else v)
    return out


def double(raw) -> float:
    return DOUBLE.unpack(raw)[0]


def _buckets(spans: list[tuple[int, int]], deltas: list, counts: list) -> list[dict]:
    out, index, total, k = [], 0, 0, 0
    for offset, length in spans:
        index += offset
        for _ in range(length):
            if counts:
                value = counts[k]
            else:
                total += deltas[k]
                value = float(total)
            out.append({"index": index, "count": value})
            index += 1
            k += 1
    return out


def histogram(data: bytes) -> tuple[int, dict]:
    h = {"schema": 0, "zero_threshold": 0.0, "zero_count": 0.0, "count": 0.0, "sum": 0.0, "custom_values": [], "hint": "UNKNOWN"}
    parts: dict[int, list] = {8: [], 9: [], 10: [], 11: [], 12: [], 13: []}
    ts = 0
    for field, v in message(data):
        if field in (1, 6):
            h["count" if field == 1 else "zero_count"] = float(v)
        elif field in (2, 7):
            h["count" if field == 2 else "zero_count"] = double(v)
        elif field == 3:
            h["sum"] = double(v)
        elif field == 4:
            h["schema"] = zigzag(v)
        elif field == 5:
            h["zero_threshold"] = double(v)
        elif field in (8, 11):
            span = dict(message(v))
            parts[field].append((zigzag(span.get(1, 0)), span.get(2, 0)))
        elif field in (9, 12):
            parts[field] += packed(v, "zigzag")
        elif field in (10, 13):
            parts[field] += packed(v, "double")
        elif field == 14:
            h["hint"] = ["UNKNOWN", "RESET", "NO_RESET", "GAUGE"][v if v < 4 else 0]
        elif field == 15:
            ts = signed(v)
        elif field == 16:
            h["custom_values"] = packed(v, "double")
    return ts, h | {"negative": _buckets(parts[8], parts[9], parts[10]), "positive": _buckets(parts[11], parts[12], parts[13])}


class Rows:
    """Rows of write requests of version 1 (labels inline) or 2 (labels as references into a symbol table).

    A label set is decoded once for all series that repeat its bytes; rows hold its number."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema = schema
        self.forget()
        self.clear()

    def forget(self) -> None:
        self.inline: dict[tuple, int] = {}
        self.pairs: dict[tuple, int] = {}
        self.labels: dict[bytes, tuple[str, str] | None] = {}
        self.sets = pa.array([], self.schema.field("labels").type)
        self.clear_new()

    def clear_new(self) -> None:
        self.names: list[str] = []
        self.values: list[str] = []
        self.ends = [0]

    def clear(self) -> None:
        self.of, self.ts, self.value, self.stale, self.hist, self.any_hist = [], [], [], [], [], False

    def number(self, labels: list[tuple[str, str]]) -> int:
        """Number of a set that was not seen before."""
        labels.sort(key=itemgetter(0))
        for name, value in labels:
            self.names.append(name)
            self.values.append(value)
        self.ends.append(len(self.names))
        return len(self.sets) + len(self.ends) - 2

    def by_pairs(self, flat: tuple[bytes, ...]) -> int:
        """Number of the set with these names and values in turn."""
        n = self.pairs.get(flat)
        if n is None:
            n = self.pairs[flat] = self.number([(a.decode(), b.decode()) for a, b in zip(flat[::2], flat[1::2], strict=True) if b])
        return n

    def by_inline(self, parts: tuple[bytes, ...]) -> int:
        """Number of the set of these Label messages. Labels repeat in sets that are new."""
        n = self.inline.get(parts)
        if n is None:
            known, labels = self.labels, []
            for x in parts:
                if x not in known:
                    pair = dict(message(x))
                    known[x] = (pair.get(1, b"").decode(), pair[2].decode()) if pair.get(2) else None
                if label := known[x]:
                    labels.append(label)
            n = self.inline[parts] = self.number(labels)
        return n

    def add(self, body: bytes) -> None:
        top = scan(body, 0, len(body))
        symbols = [body[start:stop] for field, _, start, stop in top if field == 4]
        for field, _, start, stop in top:
            if field == 5:
                self.add_series(body, scan(body, start, stop), symbols)
            elif field == 1:
                self.add_series(body, scan(body, start, stop), None)

    def add_series(self, body: bytes, parts: list[tuple[int, int, int, int]], symbols: list[bytes] | None) -> None:
        second = symbols is not None
        if second:
            refs: list[int] = []
            for field, kind, start, stop in parts:
                if field == 1:
                    raw = body[start:stop] if kind else start
                    refs += raw if kind and raw.isascii() else packed(raw, "varint")  # ASCII: each byte is a number
            of = self.by_pairs(tuple([symbols[x] for x in refs]))
        else:
            of = self.by_inline(tuple([body[start:stop] for field, _, start, stop in parts if field == 1]))
        hist = 3 if second else 4
        for field, _, start, stop in parts:
            if field == 2:
                ts, value, stale = 0, 0.0, False
                for inner, _, at, till in scan(body, start, stop):
                    if inner == 1:
                        (value,) = DOUBLE.unpack_from(body, at)
                        stale = value != value and int.from_bytes(body[at:till], "little") == STALE_BITS
                    elif inner == 2:
                        ts = signed(at)
                self.put(of, ts, math.nan if stale else value, stale, None)
            elif field == hist:
                ts, h = histogram(body[start:stop])
                self.put(of, ts, None, False, h)
                self.any_hist = True

    def put(self, of: int, ts: int, value: float | None, stale: bool, hist: dict | None) -> None:
        self.of.append(of)
        self.ts.append(ts)
        self.value.append(value)
        self.stale.append(stale)
        self.hist.append(hist)

    def batch(self) -> pa.RecordBatch:
        """The rows so far, which are given up with it."""
        labels, _, _, _, hist = self.schema.types
        if len(self.ends) > 1:
            pairs = pa.StructArray.from_arrays([pa.array(self.names, pa.string()), pa.array(self.values, pa.string())], fields=list(labels.value_type))
            self.sets = pa.concat_arrays([self.sets, pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pairs, type=labels)])
            self.clear_new()
        out = pa.RecordBatch.from_arrays([
            self.sets.take(pa.array(self.of, pa.int32())), pa.array(self.ts, pa.int64()), pa.array(self.value, pa.float64()), pa.array(self.stale, pa.bool_()),
            pa.array(self.hist, hist) if self.any_hist else pa.nulls(len(self.ts), hist),
        ], schema=self.schema)
        self.clear()
        if len(self.sets) > KEPT_SETS:
            self.forget()
        return out


def remote_write(bodies: DataFrame, column: str = "content") -> DataFrame:
    """Samples of landed remote-write bodies (as of ``spark.read.format('binaryFile')``); a broken body fails its row set."""

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(schema)
        for b in batches:
            for body in b.column(0):
                rows.add(unsnappy(body.as_py()))
                if len(rows.ts) >= BATCH_ROWS:
                    yield rows.batch()
        if rows.ts:
            yield rows.batch()

    return bodies.select(column).mapInArrow(run, SCHEMA)


# --- bodies of our own, to hand samples on ----------------------------------------------------------------------------


def _put_varint(n: int) -> bytes:
    if 0 <= n < 128:
        return ONE_BYTE[n]
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, data: bytes) -> bytes:
    return _put_varint(number << 3 | 2) + _put_varint(len(data)) + data


def snappy(data: bytes) -> bytes:
    """A block of literals only."""
    out = [_put_varint(len(data))]
    for at in range(0, len(data), 1 << 16):
        part = data[at : at + (1 << 16)]
        out += [bytes([61 << 2]), (len(part) - 1).to_bytes(2, "little"), part]
    return b"".join(out)


def _labels_part(labels: list[tuple[bytes, bytes]], version: int) -> tuple[bytes, bytes]:
    """What labels give to a write request of one series: the symbol table before the series, and the head of the series."""
    if version == 1:
        return b"", b"".join(_field(1, _field(1, n) + _field(2, v)) for n, v in labels)
    symbols = {x: i for i, x in enumerate(dict.fromkeys([b"", *(x for pair in labels for x in pair)]))}
    return b"".join(_field(4, x) for x in symbols), _field(1, b"".join(_put_varint(symbols[x]) for pair in labels for x in pair))


def _request(part: tuple[bytes, bytes], samples: list[tuple[int, float]], version: int) -> bytes:
    points = b"".join([_field(2, b"\x09" + DOUBLE.pack(v) + b"\x10" + _put_varint(ts)) for ts, v in samples])
    return snappy(part[0] + _field(1 if version == 1 else 5, part[1] + points))


def body(labels: list[tuple[str, str]], samples: list[tuple[int, float]], version: int = 1) -> bytes:
    """A write request of one series."""
    return _request(_labels_part([(n.encode(), v.encode()) for n, v in labels], version), samples, version)


def encoded(rows: DataFrame, version: int = 1) -> DataFrame:
    """content: a write request per row of labels, timestamp_ms and value."""

    @F.arrow_udf("binary")
    def run(labels: pa.Array, ts: pa.Array, value: pa.Array) -> pa.Array:
        ends, flat = labels.value_lengths().fill_null(0).to_numpy().cumsum(), labels.flatten()
        names, values = (pc.cast(flat.field(i), pa.binary()).dictionary_encode("encode") for i in (0, 1))
        many = max(1, len(values.dictionary))
        codes = names.indices.to_numpy().astype(np.int64) * many + values.indices.to_numpy()
        names, values, raw = names.dictionary.to_pylist(), values.dictionary.to_pylist(), codes.tobytes()
        parts: dict[bytes, tuple[bytes, bytes]] = {}
        out, at = [], 0
        for end, t, v in zip((8 * ends).tolist(), ts.to_pylist(), value.to_pylist(), strict=True):
            part = parts.get(key := raw[at:end])
            if part is None:
                part = parts[key] = _labels_part([(names[c // many], values[c % many]) for c in codes[at // 8 : end // 8].tolist()], version)
            out.append(_request(part, [(t, v)], version))
            at = end
        return pa.array(out, pa.binary())

    value = F.coalesce(F.col("value").cast("double"), F.lit(math.nan))
    return rows.select(run("labels", F.col("timestamp_ms").cast("bigint"), value).alias("content"))
