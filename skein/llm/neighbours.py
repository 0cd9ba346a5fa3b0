"""The most similar vectors of every vector, by multi-probe p-stable hashing (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.runtime import cut

#: Rows and queries of a bucket beyond this number are met in blocks.
BLOCK = 2048
#: Bounded samples that fit the hashing: queries that are compared with all rows, and rows that show the buckets' sizes.
FIT_QUERIES, FIT_ROWS = 256, 4096
#: What the fit may choose from: functions a table, cell widths in units of the sample's median distance to the k-th
#: neighbour, tables, and most buckets that a query visits in a table.
FUNCTIONS, WIDTHS, TABLES, PROBES = (1, 2, 3, 4, 5, 6, 8, 10, 12, 14, 16), (2.0, 3.0, 4.0, 6.0, 8.0, 12.0), 4, (1, 2, 4, 8, 16)
#: A query meets at most this share of all rows, or LEAST_MET rows where that is more.
MET_SHARE, LEAST_MET = 0.03, 256
#: Costs in comparisons: of carrying a vector to a bucket, and of losing all neighbours of a query.
VISIT, LOSS = 150.0, 400_000.0
#: The fit takes neighbours to be farther away by this factor, which makes the sample's recall a careful estimate.
STRETCH = 1.25
#: Hashed rounds; queries that still have too few finds then are met with all rows, in blocks.
ROUNDS = 3
#: Similarities closer than this are ties, which go to the smaller id.
TIE_DIGITS = 12


def live_vectors(writes: DataFrame, dims: int = 64) -> DataFrame:
    """id, vector (binary, float32) of the rows in their last state: not deleted, ``dims`` finite numbers, not all zero.

    Of several rows with the highest seq of an id (repeated rows) the one that is deleted, else any, counts.
    """
    last = writes.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct("deleted", "vector"), F.struct("seq", F.coalesce("deleted", F.lit(False)))).alias("s"))
    return last.select("id", "s.*").filter(~F.coalesce("deleted", F.lit(False)) & sound(dims)).select("id", "vector")


def sound(dims: int) -> Column:
    """Whether ``vector`` has ``dims`` finite numbers, not all zero; never null."""
    fine = (F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return F.coalesce(fine, F.lit(False))


def _unit(data: pa.Array, dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(data.to_pylist()), "<f4").reshape(-1, dims).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _to_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.column(1)
        if len(b):
            flat = rows.flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(len(b), -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], ["id", "v"])


def top_k(query: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and similarities of the k best rows of each query; of equals the earlier row. Rows are in id order."""
    sims = np.round(query @ rows.T, TIE_DIGITS)
    k = min(k, rows.shape[0])
    if rows.shape[0] > 8 * k:
        least = -np.partition(-sims, k - 1, axis=1)[:, k - 1]
        kept = sims >= least[:, None]
        if int(kept.sum(axis=1).max()) <= 4 * k:
            width = int(kept.sum(axis=1).max())
            at = np.argsort(~kept, axis=1, kind="stable")[:, :width]
            values = np.where(np.take_along_axis(kept, at, 1), np.take_along_axis(sims, at, 1), -2.0)
            order = np.argsort(-values, axis=1, kind="stable")[:, :k]
            return np.take_along_axis(at, order, 1), np.take_along_axis(values, order, 1)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(sims, order, 1)


def _directions(dims: int, count: int, table: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, table, count])
    return rng.standard_normal((dims, count)), rng.random(count)


@lru_cache(8)
def _border_sets(best: int) -> np.ndarray:
    """All sets of up to three of ``best`` borders, as rows of places in their order, padded with ``best``."""
    return np.array([[*c, *[best] * (3 - len(c))] for size in range(4) for c in combinations(range(best), size)])


def probes(place: np.ndarray, width: float, scale: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells (query, probe, function) that queries visit in the order of their estimated success, and which are worth it.

    ``place``: coordinates in units of cells. The home cell comes first. A neighbour at ``scale`` lies across a border
    at distance x with a chance that falls as exp(-(x / scale)^2), and a set of borders multiplies, so sets of up to
    three of the nearest borders are ranked by the sum of squares; sets beyond a fixed sum aren't visited.
    """
    cells = np.floor(place).astype(np.int64)
    n, m = cells.shape
    near = (np.concatenate([place - cells, 1 - (place - cells)], axis=1) * (width / scale)) ** 2
    best = min(2 * m, 6)
    order = np.argsort(near, axis=1, kind="stable")[:, :best]
    score = np.concatenate([np.take_along_axis(near, order, 1), np.zeros((n, 1))], axis=1)
    function = np.concatenate([order % m, np.full((n, 1), -1)], axis=1)
    sets = _border_sets(best)
    total = score[:, sets].sum(axis=2)
    for a, b in ((0, 1), (0, 2), (1, 2)):  # both borders of one function can't be crossed
        f, g = function[:, sets[:, a]], function[:, sets[:, b]]
        total[(f == g) & (f >= 0)] = np.inf
    rank = np.argsort(total, axis=1, kind="stable")[:, :most]
    worth = np.take_along_axis(total, rank, 1) < 12.0
    worth[:, 0] = True
    moved = np.repeat(cells[:, None, :], rank.shape[1], axis=1)
    row, probe = np.indices(rank.shape)
    step = np.concatenate([np.where(order < m, -1, 1), np.zeros((n, 1), np.int64)], axis=1)
    for e in range(3):
        border = sets[rank, e]
        moved[row, probe, np.maximum(function[row, border], 0)] += step[row, border]
    return moved, worth


def _hash_rows(cells: np.ndarray, table: int) -> np.ndarray:
    """One 64-bit key of the last axis."""
    key = np.full(cells.shape[:-1], table + 1, np.uint64)
    for i in range(cells.shape[-1]):
        key = (key ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


@dataclass(frozen=True)
class Layout:
    """How a round hashes. ``recall`` and ``met`` (rows a query meets) are the sample's; ``reach``: the distance up to
    which the sample's neighbours are found. No functions: one bucket holds all."""

    functions: int = 0
    width: float = 1.0
    scale: float = 1.0
    tables: int = 1
    probes: int = 1
    recall: float = 1.0
    met: float = 0.0
    reach: float = 2.0


def choose(query: np.ndarray, near: np.ndarray, far: np.ndarray, rows: np.ndarray, n: int, asked: int, seed: int) -> Layout:
    """The layout with the least cost on the sample among those in which a query meets few enough rows.

    ``near`` (query, neighbour, dims) and ``far``: the true neighbours of each query and their distances (inf if
    there are fewer); ``rows``: sample of all ``n`` rows; ``asked``: how many queries there are in all. Cost:
    rows met, vectors carried to buckets, and neighbours lost.
    """
    real = np.isfinite(far)
    if not real.any():
        return Layout(1, 2.0, 1.0, 1, PROBES[-1], 0.0, float(n), 0.0)
    last = np.where(real, far, -1.0).max(axis=1)
    scale = float(max(np.median(last), 1e-3))
    best, least = None, np.inf
    fallback, fewest = None, np.inf
    for m in FUNCTIONS:
        for w in WIDTHS:
            width = w * scale
            hit, plain = (np.zeros((len(PROBES), *far.shape), bool) for _ in range(2))  # of the neighbours farther away, and as they are
            met, visits = np.zeros(len(PROBES)), np.zeros(len(PROBES))
            for table in range(TABLES):
                a, shift = _directions(query.shape[1], m, table, seed)
                at = query @ a / width + shift
                cells, worth = probes(at, width, scale, PROBES[-1])
                keys = _hash_rows(cells, table)
                others = np.sort(_hash_rows(np.floor(rows @ a / width + shift).astype(np.int64), table))
                sizes = np.where(worth, np.searchsorted(others, keys, "right") - np.searchsorted(others, keys, "left"), 0).mean(axis=0)
                away = near @ a / width + shift - at[:, None, :]
                same = []
                for by in (STRETCH, 1.0):
                    own = _hash_rows(np.floor(at[:, None, :] + by * away).astype(np.int64), table)
                    same.append((own[:, :, None] == keys[:, None, :]) & worth[:, None, :])
                for i, most in enumerate(PROBES):
                    hit[i] |= same[0][:, :, :most].any(axis=2)
                    plain[i] |= same[1][:, :, :most].any(axis=2)
                    met[i] += sizes[:most].sum() * n / len(rows)
                    visits[i] += worth[:, :most].sum() / len(query)
                    recall = float(hit[i][real].mean())
                    cost = met[i] + VISIT * (visits[i] + (table + 1) * n / max(asked, 1)) + LOSS * (1 - recall)
                    if met[i] < fewest:
                        fallback, fewest = (m, width, table + 1, most, recall, met[i], plain[i].copy()), met[i]
                    if met[i] <= max(LEAST_MET, MET_SHARE * n) and cost < least:
                        best, least = (m, width, table + 1, most, recall, met[i], plain[i].copy()), cost
    m, width, tables, most, recall, met_rows, found = best or fallback
    recall = float(found[real].mean())
    order = np.argsort(far[real], kind="stable")
    distance, ok = far[real][order], found[real][order]
    reach, band = 0.0, max(1, len(ok) // 10)
    for end in range(len(ok), 0, -band):  # the farthest tenth of the neighbours that is found to nine tenths
        if ok[max(0, end - band) : end].mean() >= 0.9:
            reach = float(distance[end - 1])
            break
    return Layout(m, width, scale, tables, most, recall, float(met_rows), reach)


def _keys(rows: DataFrame, dims: int, layout: Layout, seed: int, queries: bool) -> DataFrame:
    """bucket, id, v per table: of index rows the home bucket, of queries every bucket they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _unit(b.column(1), dims)
            for table in range(layout.tables):
                take = np.arange(len(x))
                if not layout.functions:
                    bucket = np.full(len(x), table, np.int64)
                else:
                    a, shift = _directions(dims, layout.functions, table, seed)
                    place = x @ a / layout.width + shift
                    if queries:
                        cells, worth = probes(place, layout.width, layout.scale, layout.probes)
                        bucket, take = _hash_rows(cells, table)[worth], np.repeat(take, worth.sum(axis=1))
                    else:
                        bucket = _hash_rows(np.floor(place).astype(np.int64), table)
                index = pa.array(take)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), b.column(0).take(index), b.column(1).take(index)], ["bucket", "id", "v"])

    return rows.select("id", "v").mapInArrow(run, "bucket long, id string, v binary")


def _search(dims: int, k: int):
    """Top k of every query within its bucket block; input sorted by bucket, block, kind (0: rows, 1: queries), id."""

    def block(part: pa.Table) -> pa.RecordBatch | None:
        kind = part.column("kind").to_numpy()
        n = int((kind == 0).sum())
        if not n or n == len(kind):
            return None
        ids, v = part.column("id").combine_chunks(), part.column("v").combine_chunks()
        rows, out = _unit(v.slice(0, n), dims), []
        for at in range(n, len(kind), BLOCK):
            size = min(BLOCK, len(kind) - at)
            best, sims = top_k(_unit(v.slice(at, size), dims), rows, k)
            q = np.repeat(np.arange(at, at + size), best.shape[1])
            out.append((ids.take(pa.array(q)), ids.take(pa.array(best.ravel())), pa.array(sims.ravel())))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([o[i] for o in out]) for i in range(3)], ["id", "other", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            bucket, part = table.column("bucket").to_numpy(), table.column("block").to_numpy()
            cuts = np.nonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]))[0] + 1
            edges = [0, *cuts.tolist(), len(bucket)]
            for a, b in zip(edges[:-1] if last else edges[:-2], edges[1:], strict=False):
                if (found := block(table.slice(a, b - a))) is not None:
                    yield found
            held = [] if last else table.slice(edges[-2]).to_batches()

        for b in batches:
            if len(b):
                held.append(b)
                if sum(len(h) for h in held) >= 2 * BLOCK:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def _round(index: DataFrame, queries: DataFrame, dims: int, k: int, layout: Layout, seed: int, stats: list | None = None) -> DataFrame:
    """id, other, sim: the k best of every query over the buckets it visits.

    Buckets are counted first. A bucket of more than BLOCK rows or queries is split into blocks of both: its rows lie
    in one block column each, its queries are met with every column, so no task holds a hot bucket as a whole.
    """
    rows = cut(_keys(index, dims, layout, seed, False))
    asks = cut(_keys(queries, dims, layout, seed, True))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    asked = asks.groupBy("bucket").agg(F.count("*").alias("m"))
    grid = sizes.join(asked, "bucket").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("across"), F.ceil(F.col("m") / BLOCK).cast("int").alias("down"))
    if stats is not None:
        pairs = sizes.join(asked, "bucket").agg(F.sum(F.col("n") * F.col("m")).alias("pairs"), F.max("n").alias("largest")).first()
        stats.append({"layout": layout, "pairs": int(pairs.pairs or 0), "largest": int(pairs.largest or 0)})
    hot = grid.filter((F.col("across") > 1) | (F.col("down") > 1))
    live = asks.join(sizes.select("bucket"), "bucket", "left_semi")
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    one = F.coalesce(F.col("across"), F.lit(1)), F.coalesce(F.col("down"), F.lit(1))
    left = rows.join(hot, "bucket", "left").select("bucket", place(one[0]).alias("x"), every(one[1]).alias("y"), "id", "v", F.lit(0).alias("kind"))
    right = live.join(hot, "bucket", "left").select("bucket", every(one[0]).alias("x"), place(one[1]).alias("y"), "id", "v", F.lit(1).alias("kind"))
    both = left.unionByName(right).withColumn("block", F.col("x") * F.lit(1 << 16) + F.col("y")).drop("x", "y")
    placed = both.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "kind", "id")
    found = placed.mapInArrow(_search(dims, k), "id string, other string, sim double")
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best (sim, then smaller id) of each id; candidates of several tables are merged. Groups are bounded."""
    ranked = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("sim")).alias("far"), "other"))), 1, k)
    return found.groupBy("id").agg(ranked.alias("near")).select("id", F.explode("near").alias("n")).select("id", "n.other", (-F.col("n.far")).alias("sim"))


def _matrix(vectors: list, dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(bytes(v) for v in vectors), "<f4").reshape(-1, dims).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(index: DataFrame, queries: DataFrame, dims: int, k: int, n: int, asked: int, seed: int) -> Layout:
    """The layout that ``choose`` finds for FIT_QUERIES of the queries (smallest hashes of their ids).

    Each of them is compared with all rows, so its true neighbours are known; every task keeps k of them, and
    salted partial merges keep what is gathered for a query bounded. FIT_ROWS rows show how large buckets are.
    """
    sample = lambda df, size: [r.v for r in df.orderBy(F.xxhash64("id"), "id").limit(size).select("v").collect()]
    query, rows = _matrix(sample(queries, FIT_QUERIES), dims), _matrix(sample(index, FIT_ROWS), dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = np.full((len(query), k), -2.0), np.zeros((len(query), k, dims), "<f4")
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.column(1).slice(at, BLOCK)
                raw = np.frombuffer(b"".join(part.to_pylist()), "<f4").reshape(-1, dims)
                sims = np.concatenate([best, query @ _unit(part, dims).T], axis=1)
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                both = np.concatenate([held, raw[np.maximum(top - k, 0)]], axis=1)
                take = np.where(top < k, top, k + np.arange(k))
                best, held = np.take_along_axis(sims, top, 1), np.take_along_axis(both, take[:, :, None], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(query)), k)), pa.array(best.ravel()), pa.array([h.tobytes() for h in held.reshape(-1, dims)], pa.binary())], ["q", "sim", "v"])

    tops = index.select("id", "v").mapInArrow(run, "q long, sim double, v binary").filter(F.col("sim") > -2)
    best = F.slice(F.sort_array(F.collect_list(F.struct("sim", "v")), asc=False), 1, k)
    some = tops.groupBy("q", F.pmod(F.spark_partition_id(), F.lit(64)).alias("part")).agg(best.alias("s")).select("q", F.explode("s").alias("s")).select("q", "s.*")
    near, far = np.zeros((len(query), k, dims)), np.full((len(query), k), np.inf)
    for r in some.groupBy("q").agg(best.alias("s")).collect():  # FIT_QUERIES rows
        near[r.q, : len(r.s)] = _matrix([x.v for x in r.s], dims)
        far[r.q, : len(r.s)] = np.sqrt(np.maximum(0.0, 2 - 2 * np.array([x.sim for x in r.s])))
    return choose(query, near[:, 1:], far[:, 1:], rows, n, asked, seed)  # the first is the query itself


def nearest(vectors: DataFrame, k: int = 5, dims: int = 64, seed: int = 7, stats: list | None = None) -> DataFrame:
    """id, other, sim: the k rows most similar by cosine to every row, itself left out; ties go to the smaller id.

    ``vectors``: id (unique), vector. Rows without an id, or without ``dims`` finite numbers that aren't all zero, take
    no part. Exact copies are hashed once: of each distinct vector the k + 1 smallest ids enter the index, which is
    all that a ranking with ties by id can use.

    A round hashes unit vectors with random projections cut into cells. Queries visit their own bucket and, in
    order of estimated success, those across the nearest borders; what they meet is compared exactly. Functions,
    cell width, tables and probes are fitted together to a bounded sample (``fit``), alike at every size: those of
    least cost, among those in which a query meets at most MET_SHARE of the rows (or LEAST_MET). Queries that find
    too few rows, or whose k-th find lies farther than the sample's neighbours are found, go to another round, fitted to
    a sample of themselves. Queries with too few finds after ROUNDS are met with all rows in blocks: nobody ends with
    fewer than there are. Fewer than k other rows: all of them. An empty table gives an empty result. ``stats``
    receives layout, compared pairs and largest bucket of each round.
    """
    packed = vectors.filter(F.col("id").isNotNull() & sound(dims)).select("id", "vector").mapInArrow(_to_binary, "id string, v binary")
    copies = cut(packed)
    least = copies.groupBy("v").agg(F.min("id").alias("rep"))
    members = cut(copies.join(least, "v").select("rep", "id", "v"))
    index = cut(_smallest(members, k + 1))
    n = index.count()
    if not n:
        return index.select("id", F.col("id").alias("other"), F.lit(0.0).alias("sim"))
    todo, found = members.filter(F.col("rep") == F.col("id")).select("id", "v"), None
    want, counted = min(k + 1, n), F.count("*").alias("n")
    for attempt in range(ROUNDS + 1):
        asked = todo.count()
        if not asked:
            break
        layout = Layout() if attempt == ROUNDS else fit(index, todo, dims, k + 1, n, asked, seed + attempt)
        hits = cut(_round(index, todo, dims, k + 1, layout, seed + attempt, stats))
        found = hits if found is None else found.unionByName(hits)
        if attempt < ROUNDS:
            enough = hits.groupBy("id").agg(counted, F.min("sim").alias("least")).filter(F.col("n") >= want)
            if attempt < ROUNDS - 1:
                enough = enough.filter(F.col("least") >= 1 - layout.reach**2 / 2 - 1e-9)
            todo = cut(todo.join(enough, "id", "left_anti"))
    near = _best(found, k + 1).withColumnRenamed("id", "rep")
    own = members.select("rep", "id").join(near, "rep").filter(F.col("id") != F.col("other"))
    return _best(own.select("id", "other", "sim"), k)


def _smallest(members: DataFrame, k: int) -> DataFrame:
    """Of every distinct vector the ``k`` smallest ids: each batch keeps its k smallest, and these lists merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: dict[str, list[int]] = {}
            ids = b.column(1).to_pylist()
            for i in sorted(range(len(ids)), key=ids.__getitem__):
                own = held.setdefault(b.column(0)[i].as_py(), [])
                if len(own) < k:
                    own.append(i)
            yield b.take(pa.array([i for own in held.values() for i in own], pa.int64()))

    first = members.mapInArrow(run, "rep string, id string, v binary")
    ids = F.slice(F.array_sort(F.collect_set("id")), 1, k)
    return first.groupBy("rep").agg(F.any_value("v").alias("v"), ids.alias("ids")).select(F.explode("ids").alias("id"), "v")


def pairs(near: DataFrame) -> DataFrame:
    """id_lo, id_hi: the unordered pairs in which one is among the nearest of the other."""
    return near.select(F.least("id", "other").alias("id_lo"), F.greatest("id", "other").alias("id_hi")).distinct()
