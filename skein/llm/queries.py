"""Queries of the problems tagged llm, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import labels as lab
from skein.llm import neighbours, packing, passages, percentiles, tokens
from skein.runtime import table

SHARES = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99, "p999": 0.999, "maximum": 1.0}


def _p6_rows(spark: SparkSession, d: str) -> DataFrame:
    """src, k1, k2, day, value of all three tables."""
    day = lambda c: F.floor(c / 86_400_000).cast("bigint").alias("day")
    name = lab.get(F.col("labels"), "__name__")
    spans = table(spark, d, "spans").select(
        F.lit("span").alias("src"), F.col("service_name").alias("k1"), F.col("operation_name").alias("k2"),
        F.datediff("start_time", F.lit("1970-01-01").cast("date")).cast("bigint").alias("day"), F.col("duration").cast("double").alias("value"),
    )
    hists = table(spark, d, "histograms").select(F.lit("histogram").alias("src"), F.col("namespace").alias("k1"), name.alias("k2"), day(F.col("timestamp_ms")), F.col("hist_count").alias("value"))
    samples = table(spark, d, "samples").filter(~F.coalesce("stale", F.lit(False))).select(F.lit("sample").alias("src"), name.alias("k1"), F.lit(None).cast("string").alias("k2"), day(F.col("timestamp_ms")), "value")
    return spans.unionByName(hists).unionByName(samples)


GROUP = ["src", "k1", "k2"]


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per group from sketches of single days, merged; whole tables.

    Merged by (group, day, part), then by (group, part), then by group: no task meets all sketches of a hot group.
    """
    days = percentiles.merged(percentiles.sketches(_p6_rows(spark, d), [*GROUP, "day"], F.col("value")), [*GROUP, "day"], keep_part=True)
    return percentiles.read_out(percentiles.combined(days, GROUP), SHARES)


def p6_within(spark: SparkSession, d: str) -> DataFrame:
    """src, k1, k2, share, n, within: whether each percentile's exact rank lies within 5 % of the share's distance from
    the nearer tail (or one row, where that is less)."""
    share = F.create_map(*[F.lit(x) for pair in SHARES.items() for x in pair])
    long = p6_percentiles(spark, d).select(*GROUP, F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.col(s).alias("x")) for s in SHARES])).alias("p")).select(*GROUP, "p.*")
    rows = _p6_rows(spark, d).filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*GROUP, "value").agg(F.count("*").alias("c"))
    key = F.xxhash64(*GROUP).alias("g")
    counted = rows.select(key, "value", "c").join(long.select(key, *GROUP, "share", "x"), "g").groupBy(*GROUP, "share", "x").agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("value") < F.col("x"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("value") <= F.col("x"), F.col("c")).otherwise(0)).alias("upto")
    )
    at = share[F.col("share")] * F.col("n")
    slack = F.greatest(F.lit(1.0), 0.05 * F.least(at, F.col("n") - at))
    return counted.select(*GROUP, "share", "n", ((F.col("below") <= at + slack) & (F.col("upto") >= at - slack)).alias("within"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(neighbours.nearest(neighbours.live_vectors(table(spark, d, "vectors"))))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id")


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text_md5: of the text that the ids of p8_ids give back."""
    docs = table(spark, d, "documents")
    return tokens.decode(tokens.encode(docs, "doc_id"), "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "context_sizes"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_rates(p9_packed(spark, d), table(spark, d, "context_sizes"))


def p9_broken(spark: SparkSession, d: str) -> DataFrame:
    """size_name, texts, and how many rules are broken: bins over the capacity, texts that are split without need, texts
    whose pieces are not exactly their tokens."""
    packed, sizes = p9_packed(spark, d), table(spark, d, "context_sizes").select("size_name", "capacity_tokens")
    bins = packed.groupBy("size_name", "bin").agg(F.sum("n_tokens").alias("n")).join(sizes, "size_name")
    over = bins.groupBy("size_name").agg(F.sum(F.when(F.col("n") > F.col("capacity_tokens"), 1).otherwise(0)).alias("over_capacity"))
    texts = packed.groupBy("size_name", "doc_id").agg(
        F.count("*").alias("parts"), F.sum("n_tokens").alias("n"), F.max("part").alias("last"), F.count_distinct("part").alias("kinds"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end")
    )
    ids = tokens.encode(table(spark, d, "documents"), "doc_id").select("doc_id", F.size("ids").alias("tokens"))
    of = texts.join(ids, "doc_id").join(sizes, "size_name")
    n = lambda bad: F.sum(F.when(bad, 1).otherwise(0))
    whole = of.groupBy("size_name").agg(
        F.count("*").alias("texts"), n(F.col("parts") != F.ceil(F.col("tokens") / F.col("capacity_tokens"))).alias("split_without_need"),
        n((F.col("n") != F.col("tokens")) | (F.col("end") != F.col("tokens")) | (F.col("kinds") != F.col("parts")) | (F.col("last") + 1 != F.col("parts"))).alias("not_whole"),
    )
    return whole.join(over, "size_name")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return passages.shared_chars(passages.shared_passages(table(spark, d, "documents"))).filter(F.col("shared_chars") > 0)


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    return passages.spans(passages.shared_passages(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p6_percentiles, p6_within, p7_found, p8_ids, p8_texts, p9_packed, p9_fill, p9_broken, p10_found, p10_spans)}

_P10 = """
WITH w AS (SELECT doc_id, i, substr(text, i, 160) AS s FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 159)) AS i
  FROM (SELECT doc_id, text FROM documents WHERE length(text) >= 160)) q),
g AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM w SEMI JOIN g USING (s))
"""
ORACLES = {
    "p6_within": f"""
WITH v AS (SELECT 'span' AS src, service_name AS k1, operation_name AS k2, duration::DOUBLE AS value FROM spans
  UNION ALL SELECT 'histogram', namespace, list_filter(labels, lambda x: x.name = '__name__' AND x.value <> '')[1].value, hist_count FROM histograms
  UNION ALL SELECT 'sample', list_filter(labels, lambda x: x.name = '__name__' AND x.value <> '')[1].value, NULL, value FROM samples WHERE NOT coalesce(stale, false))
SELECT src, k1, k2, share, count(*) AS n, true AS within FROM v, (SELECT unnest({list(SHARES)}) AS share) WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY ALL""",
    "p8_texts": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p9_broken": """SELECT size_name, (SELECT count(*) FROM documents WHERE text <> '') AS texts, 0::BIGINT AS over_capacity, 0::BIGINT AS split_without_need, 0::BIGINT AS not_whole
  FROM context_sizes""",
    "p7_found": """
WITH s AS (SELECT id, arg_max(deleted, seq) AS deleted, arg_max(vector, seq) AS v FROM
    (SELECT id, seq, deleted, coalesce(vector, []) AS vector FROM vectors) GROUP BY id),
l AS (SELECT id, v::DOUBLE[] AS v FROM s WHERE NOT deleted AND len(v) = 64
  AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.id) AS k
  FROM l a JOIN l b ON a.id <> b.id)
SELECT DISTINCT least(a, b) AS id_lo, greatest(a, b) AS id_hi FROM p WHERE k <= 5""",
    "p10_found": _P10 + "SELECT doc_id, sum(least(160, coalesce(nx - i, 160)))::BIGINT AS shared_chars FROM h GROUP BY 1",
}
