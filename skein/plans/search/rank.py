"""Ranked retrieval: exact nearest neighbours, centroid-pruned search, BM25, order by attribute, fusion and collapse."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.functions.words import analyse
from skein.plans.promql.parser import QueryError
from skein.plans.search import filters
from skein.runtime import cut, is_small

DEFAULT_TOP_K, MOST_ROWS = 10, 10_000
K1, B, RRF_K = 1.2, 0.75, 60
#: Filtered sets up to this size are searched exactly.
EXACT_ROWS = 2048
#: Rows that the centroids are fitted on (by hash of the id), and rounds of the fit.
FIT_ROWS, FIT_ROUNDS = 20_000, 8


def distance(metric: str, query: list[float]):
    """Arrow UDF over vectors: squared L2, cosine distance (half the squared L2 of unit vectors), or negated dot."""
    q = np.asarray(query, np.float64)
    if metric == "cosine":
        q = q / (np.linalg.norm(q) or 1.0)

    @F.pandas_udf(T.DoubleType())
    def run(vectors: pd.Series) -> pd.Series:
        fits = vectors.map(lambda v: v is not None and len(v) == len(q)).to_numpy(bool)
        out = np.full(len(vectors), np.nan)
        if fits.any():
            x = np.stack(vectors[fits].to_list()).astype(np.float64)
            if metric == "cosine":
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(n == 0, 1, n)
            out[fits] = -(x @ q) if metric == "dot" else ((x - q) ** 2).sum(axis=1) / (2 if metric == "cosine" else 1)
        return pd.Series(out)

    return run


def _top(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    if not 1 <= limit <= MOST_ROWS:
        raise QueryError(f"the limit must be 1 to {MOST_ROWS}")
    return rows.orderBy(*order).limit(limit)


def knn(rows: DataFrame, query: list[float], top_k: int = DEFAULT_TOP_K, metric: str = "cosine", where=None) -> DataFrame:
    """Every filtered row scored; the top_k by (distance, id) as $dist. Rows without a fitting vector don't rank."""
    scored = filters.apply(rows, where).withColumn("$dist", distance(metric, query)("vector")).filter(F.col("`$dist`").isNotNull() & ~F.isnan("`$dist`"))
    return _top(scored, [F.col("`$dist`"), F.col("id")], top_k)


class Centroids:
    """Inverted lists: rows assigned to the nearest of ``lists`` centroids, fitted on a bounded sample; all rows are indexed."""

    def __init__(self, rows: DataFrame, lists: int, metric: str = "cosine", seed: int = 3):
        self.metric = metric
        good = rows.filter(F.col("vector").isNotNull())
        sample = good.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vector").collect()  # at most FIT_ROWS
        size = max((len(r.vector) for r in sample), default=0)
        x = np.array([r.vector for r in sample if len(r.vector) == size], np.float64).reshape(-1, size)
        x = self._unit(x[np.isfinite(x).all(1)])
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)] if len(x) else np.zeros((1, size))
        for _ in range(FIT_ROUNDS):
            own = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
            c = np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(len(c))])
        self.centroids = c
        metric_unit = self._unit

        @F.pandas_udf("list int, away double")
        def assign(vectors: pd.Series) -> pd.DataFrame:
            fits = vectors.map(lambda v: v is not None and len(v) == c.shape[1]).to_numpy(bool)
            out, away = np.full(len(vectors), -1), np.full(len(vectors), np.nan)
            if fits.any():
                v = metric_unit(np.stack(vectors[fits].to_list()).astype(np.float64))
                out[fits] = np.argmin((c**2).sum(1) - 2 * v @ c.T, axis=1)
                away[fits] = np.sqrt(((v - c[out[fits]]) ** 2).sum(1))
            return pd.DataFrame({"list": out, "away": away})

        self.rows = rows.withColumn("_near", assign("vector"))
        self._radii: dict[int, float] | None = None

    def radii(self) -> dict[int, float]:
        """The distance of each list's farthest row from its centroid, over all rows. Rows that are NaN don't rank."""
        if self._radii is None:
            near = self.rows.select(F.col("_near.list").alias("k"), F.col("_near.away").alias("r")).filter((F.col("k") >= 0) & ~F.isnan("r"))
            self._radii = {x.k: x.r for x in near.groupBy("k").agg(F.max("r").alias("r")).collect()}  # one row a list
        return self._radii

    def _least(self, q: np.ndarray, k: int) -> float:
        """No row of list ``k`` has a smaller $dist from ``q``, by the triangle inequality."""
        c, r = self.centroids[k], self.radii().get(k)
        if r is None:
            return np.inf
        if self.metric == "dot":
            return -float(c @ q) - r * float(np.linalg.norm(q))
        return max(float(np.linalg.norm(c - q)) - r, 0.0) ** 2 / (2 if self.metric == "cosine" else 1)

    def _unit(self, x: np.ndarray) -> np.ndarray:
        if self.metric != "cosine":
            return x
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    def search(self, query: list[float], top_k: int = DEFAULT_TOP_K, probes: int = 8, epsilon: float = 0.2, where=None) -> DataFrame:
        """The top rows of all lists, exactly. First come the ``probes`` nearest lists that lie within (1 + epsilon) of
        the nearest centroid's distance; then every other list that by its radius can hold a row as near as the last
        of those found.

        A small filtered set is searched whole; if the lists hold too few rows, four times as many are probed.
        """
        chosen = filters.apply(self.rows, where)
        if where is not None and is_small(chosen.select("id"), EXACT_ROWS):
            return knn(chosen.drop("_near"), query, top_k, self.metric)
        q = self._unit(np.asarray([query], np.float64))[0]
        d = ((self.centroids - q) ** 2).sum(1)
        order = np.argsort(d, kind="stable")
        within = lambda lists: knn(chosen.filter(F.col("_near.list").isin(*lists)).drop("_near"), query, top_k, self.metric)
        while True:
            near = [int(k) for k in order[:probes] if d[k] <= d[order[0]] * (1 + epsilon) ** 2 or probes >= len(order)]
            if probes >= len(order):
                return within(near)
            found = [r["$dist"] for r in within(near).select("`$dist`").collect()]  # at most top_k rows
            if len(found) >= top_k:
                last = max(found)
                others = [k for k in range(len(order)) if k not in near and not self._least(q, k) > last + 1e-9 * (1 + abs(last))]
                return within(near + others)
            probes *= 4
            epsilon *= 2


def quantised(length: Column) -> Column:
    """Lengths as a byte keeps them: exact below 64, then the top four bits."""
    bits = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double")))
    unit = F.pow(F.lit(2.0), bits - 3)
    return F.when(length < 64, length.cast("double")).otherwise(F.floor(length / unit) * unit)


def word_list(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: analyse(t or ""))


def bm25(rows: DataFrame, query: str, top_k: int = DEFAULT_TOP_K, text: str = "text", where=None) -> DataFrame:
    """Rows with at least one query word, by BM25 as $score, then id. Statistics cover all rows with a text.

    Two aggregations over (length, counts of the query's words): words of the corpus aren't shuffled.
    """
    terms = sorted(set(analyse(query)))
    if not terms:
        raise QueryError("the query has no words")
    kind = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("tf", T.ArrayType(T.IntegerType()))])

    @F.pandas_udf(kind)
    def counts(texts: pd.Series) -> pd.DataFrame:
        words = [analyse(t or "") for t in texts]
        return pd.DataFrame({"size": [len(w) for w in words], "tf": [[w.count(t) for t in terms] for w in words]})

    scanned = rows.filter(F.col(text).isNotNull()).withColumn("_c", counts(text))
    has = [F.sum(F.when(F.get("_c.tf", F.lit(i)) > 0, 1).otherwise(0)).alias(f"_df{i}") for i in range(len(terms))]
    stats = scanned.agg(F.count("*").alias("_n"), F.avg("_c.size").alias("_avg"), *has)  # one row
    score: Column = F.lit(0.0)
    any_hit = F.lit(False)
    for i in range(len(terms)):
        tf, df = F.get("_c.tf", F.lit(i)).cast("double"), F.col(f"_df{i}")
        norm = K1 * (1 - B + B * quantised(F.col("_c.size")) / F.greatest(F.col("_avg"), F.lit(1.0)))
        score = score + (F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + norm)).cast("float").cast("double")
        any_hit = any_hit | (tf > 0)
    matched = filters.apply(scanned, where).filter(any_hit).join(F.broadcast(stats))
    scored = matched.withColumn("$score", score).select(*rows.columns, "$score")
    return _top(scored, [F.col("`$score`").desc(), F.col("id")], top_k)


def order_by(rows: DataFrame, attribute: str, descending: bool = False, limit: int = DEFAULT_TOP_K, where=None) -> DataFrame:
    """By an attribute; absent last, ties by id; arrays count by their smallest (or, descending, largest) element."""
    kept = filters.apply(rows, where)
    if attribute == "id":
        if descending:
            raise QueryError("id orders ascending only")
        return _top(kept, [F.col("id")], limit)
    c = F.col(attribute)
    if isinstance(rows.schema[attribute].dataType, T.ArrayType):
        c = F.array_max(c) if descending else F.array_min(c)
    return _top(kept, [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("id")], limit)


def unranked(rows: DataFrame, limit: int = DEFAULT_TOP_K, where=None) -> DataFrame:
    return _top(filters.apply(rows, where), [F.col("id")], limit)


def count(rows: DataFrame, where=None) -> DataFrame:
    return filters.apply(rows, where).agg(F.count("*").alias("count"))


def collapse(ranked: DataFrame, order: list[Column], attributes: list[str], per: int, limit: int) -> DataFrame:
    """At most ``per`` rows of each combination of attribute values, in rank order."""
    w = Window.partitionBy(*attributes).orderBy(*order)
    kept = ranked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per).drop("_r")
    return _top(kept, order, limit)


def fuse(results: list[tuple[DataFrame, list[Column]]], k: int = RRF_K, limit: int = DEFAULT_TOP_K) -> DataFrame:
    """id, $score: reciprocal rank fusion, the sum of 1 / (k + rank). Inputs are top lists of at most MOST_ROWS rows."""
    parts = []
    for df, order in results:
        rank = F.row_number().over(Window.orderBy(*order))
        top = df.orderBy(*order).limit(MOST_ROWS)  # the first in rank order
        parts.append(top.select("id", (1.0 / (k + rank)).alias("s")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return _top(both.groupBy("id").agg(F.sum("s").alias("$score")), [F.col("`$score`").desc(), F.col("id")], limit)


def project(result: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """id, $dist or $score and attributes; the vector only if asked for."""
    fixed = [c for c in result.columns if c == "id" or c.startswith("$")]
    rest = [c for c in result.columns if c not in fixed and (c in include if include is not None else c != "vector") and c not in (exclude or [])]
    return result.select(*[F.col(f"`{c}`") for c in fixed + rest])


def multi(rows: DataFrame, requests: list[Callable[[DataFrame], DataFrame]]) -> list[DataFrame]:
    """Results of several requests, all over one state of the rows, which is written once."""
    state = cut(rows)
    return [request(state) for request in requests]


def get(rows: DataFrame, row_id: str) -> DataFrame:
    return rows.filter(F.col("id") == row_id)


def latest(writes: DataFrame) -> DataFrame:
    """Current rows of a write log (id, seq, deleted, attributes): the highest seq of an id, unless it deletes."""
    body = [c for c in writes.columns if c != "id"]
    one = writes.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*body), "seq").alias("b")).select("id", "b.*")
    return one.filter(~F.coalesce("deleted", F.lit(False))).drop("seq", "deleted")
