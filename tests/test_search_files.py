import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.words import analyse
from skein.plans import files as fs
from skein.plans.promql.parser import QueryError
from skein.plans.search import filters, rank
from skein.sources import vectors as vs

ROWS = [("a", [1.0, 0.0], "x", 1, ["p", "q"], "red fox runs"), ("b", [0.9, 0.1], "y", 2, [], "red red apple"), ("c", [0.0, 1.0], None, None, ["q"], "blue sky over the fox"), ("d", None, "x", 3, None, None), ("e", [1.0], "z-1", 5, ["r"], "")]
SCHEMA = "id string, vector array<float>, category string, price long, tags array<string>, text string"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize("metric,want", [("cosine", ["a", "b", "c"]), ("l2", ["a", "b", "c"]), ("dot", ["a", "b", "c"])])
def test_knn(rows, metric, want):
    assert ids(rank.knn(rows, [1.0, 0.0], 10, metric)) == want
    assert ids(rank.knn(rows, [1.0, 0.0], 1, metric, ["category", "Eq", "y"])) == ["b"]


@pytest.mark.parametrize(
    "where,want",
    [
        (["category", "Eq", "x"], "ad"), (["category", "NotEq", "x"], "bce"), (["price", "Gt", 1], "bde"), (["price", "Lte", 2], "ab"), (["category", "In", ["x", "y"]], "abd"), (["category", "NotIn", ["x", "y"]], "ce"),
        (["tags", "Contains", "q"], "ac"), (["tags", "NotContains", "q"], "bde"), (["tags", "ContainsAny", ["p", "r"]], "ae"), (["tags", "NotContainsAny", ["p", "r"]], "bcd"), (["tags", "Eq", "r"], "e"), (["category", "Glob", "[xy]"], "abd"),
        (["category", "NotGlob", "z*"], "abcd"), (["category", "IGlob", "Z-?"], "e"), (["category", "NotIGlob", "Z*"], "abcd"), (["price", "Exists"], "abde"), (["price", "NotExists"], "c"), (["nope", "Eq", 1], ""), (["nope", "NotExists"], "abcde"),
        (["And", [["price", "Gt", 1], ["category", "Exists"]]], "bde"), (["Or", [["price", "Eq", 1], ["category", "NotExists"]]], "ac"), (["Not", ["price", "Gt", 1]], "ac"), (["And", []], "abcde"), (["Or", []], ""),
    ],
)
def test_filters(rows, where, want):
    assert "".join(sorted(ids(filters.apply(rows, where)))) == want


@pytest.mark.parametrize("where", [[], ["price", "Eq", "x"], ["category", "Eq", 1], ["price", "Eq", None], ["price", "In", 1], ["category", "Contains", "x"], ["category", "Foo", 1], ["price", "Glob", "*"], ["category", "Eq", ["x"]]])
def test_filter_errors(rows, where):
    with pytest.raises(QueryError):
        filters.compile_filter(rows.schema, where)
    with pytest.raises(QueryError):
        filters.check_schema(T.StructType([T.StructField("$x", T.StringType())]))


def test_bm25_against_brute_force(rows):
    got = {r.id: r["$score"] for r in rank.bm25(rows, "red Fox", 10).collect()}
    texts = {r[0]: analyse(r[5]) for r in ROWS if r[5] is not None}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    want = {}
    for i, words in texts.items():
        score = 0.0
        for t in ("red", "fox"):
            df, tf = sum(t in w for w in texts.values()), words.count(t)
            score += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
        if score:
            want[i] = score
    assert got == pytest.approx(want, rel=1e-6)
    with pytest.raises(QueryError):
        rank.bm25(rows, " ! ")


def test_orders_collapse_fusion_projection(rows):
    assert ids(rank.order_by(rows, "price", False)) == ["a", "b", "d", "e", "c"] and ids(rank.order_by(rows, "price", True)) == ["e", "d", "b", "a", "c"]
    assert ids(rank.order_by(rows, "tags", True)) == ["e", "a", "c", "b", "d"] and ids(rank.unranked(rows, 2)) == ["a", "b"]
    assert ids(rank.collapse(rows, [F.col("id")], ["category"], 1, 10)) == ["a", "b", "c", "e"]
    one, two = rank.order_by(rows, "price", False, 3), rank.order_by(rows, "price", True, 3)
    fused = {r.id: r["$score"] for r in rank.fuse([(one, [F.col("price")]), (two, [F.col("price").desc()])]).collect()}
    assert fused["b"] == pytest.approx(1 / 62 + 1 / 63) and fused["a"] == pytest.approx(1 / 61)
    assert rank.project(rank.knn(rows, [1.0, 0.0]), exclude=["tags"]).columns == ["id", "$dist", "category", "price", "text"]
    with pytest.raises(QueryError):
        rank.unranked(rows, 0)
    assert [r[0] for r in spark_quantised(rows)] == [5.0, 63.0, 64.0, 64.0, 72.0, 120.0]


def spark_quantised(rows):
    s = rows.sparkSession.createDataFrame([(5,), (63,), (64,), (71,), (72,), (127,)], "n int")
    return s.select(rank.quantised(F.col("n"))).collect()


def test_centroid_search_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 2000)] + 0.2 * rng.standard_normal((2000, 16))
    df = spark.createDataFrame([(f"i{n:04d}", v.tolist(), n % 2) for n, v in enumerate(x)], "id string, vector array<float>, half int").cache()
    index = rank.Centroids(df, 20)
    hit = 0
    for q in range(5):
        query = x[q].tolist()
        hit += len(set(ids(index.search(query, 10, probes=4))) & set(ids(rank.knn(df, query, 10))))
    assert hit >= 45
    assert set(ids(index.search(x[0].tolist(), 10, where=["half", "Eq", 1]))) == set(ids(rank.knn(df, x[0].tolist(), 10, where=["half", "Eq", 1])))


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_centroid_search_loses_no_neighbour(spark, metric):
    rng = np.random.default_rng(5)
    near, far = rng.standard_normal((600, 16)), 40 + 0.1 * rng.standard_normal((200, 16)) * np.arange(1, 17)
    x = [*np.concatenate([near, far]).tolist(), [float("nan")] * 16, [0.0] * 16, [1.0] * 3, None]
    df = spark.createDataFrame([(f"i{n:04d}", v, n % 2) for n, v in enumerate(x)], "id string, vector array<float>, half int").cache()
    index = rank.Centroids(df, 16, metric)
    for q in (0, 7, 300, 650):
        for probes in (1, 8):
            assert ids(index.search(x[q], 20, probes=probes)) == ids(rank.knn(df, x[q], 20, metric)), (q, probes)


def test_write_log(spark):
    log = spark.createDataFrame([], "id string, seq long, deleted boolean, vector array<float>, price long")
    log = vs.upsert(log, spark.createDataFrame([("a", [1.0], 1), ("b", [2.0], 2)], "id string, vector array<float>, price long"), 1)
    log = vs.patch(log, spark.createDataFrame([("a", 9), ("zz", 1)], "id string, price long"), 2)
    log = vs.apply_batch(log, 10, where=["price", "Eq", 2], rows=spark.createDataFrame([("c", "new")], "id string, note string"), deletes=None)
    got = {r.id: (r.price, r.note) for r in rank.latest(log).collect()}
    assert got == {"a": (9, None), "c": (None, "new")}
    assert vs.compact(log).count() == 2 and rank.get(rank.latest(log), "b").count() == 0
    with pytest.raises(ValueError):
        vs.upsert(log, spark.createDataFrame([("a", "x")], "id string, price string"), 20)


def test_passages(spark):
    text = "First part. It goes on.\n\nSecond paragraph is here.\nWith a line." + " long" * 60
    parts = vs.split_passages(text, 80, 10)
    assert all(0 < len(p) <= 80 for p in parts) and "Second paragraph" in " ".join(parts) and vs.split_passages("") == [] and vs.split_passages(None) == []
    rows = vs.passages(spark.createDataFrame([("d", "one\n\ntwo", "k")], "id string, text string, kind string"), max_chars=6, overlap=0).collect()
    assert [(r.id, r["$doc_id"], r.text, r.kind) for r in rows] == [("d#0", "d", "one", "k"), ("d#1", "d", "two", "k")]


FILES = [
    ("/src/a.py", "file", b"import os\nprint('Hi')\n# end"), ("/src/sub/b.py", "file", b"x = 1\r\ny = os\n"), ("/src/sub", "dir", None), ("/docs/read[me].md", "file", b"os OS\n"), ("/img.png", "file", b"os"),
    ("/bin", "file", b"\x7fELFos"), ("/nul", "file", b"os\0os"), ("/empty", "file", b""),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("t", p, k, len(c or b""), bytearray(c) if c is not None else None) for p, k, c in FILES], "tenant string, path string, kind string, size long, content binary").cache()


@pytest.mark.parametrize("pattern,want", [("/src/*", ["/src/a.py", "/src/sub"]), ("/**/*.py", ["/src/a.py", "/src/sub/b.py"]), ("/{docs,bin}*", ["/bin"]), ("/docs/read[[]me].md", ["/docs/read[me].md"]), ("/???", ["/bin", "/nul"]), ("/src/**", ["/src/a.py", "/src/sub", "/src/sub/b.py"])])
def test_glob(files, pattern, want):
    assert [r.path for r in fs.glob(files, pattern).collect()] == want


def test_grep(files):
    got = [(r.path, r.line_number, r.line) for r in fs.grep(files, "os").collect()]
    assert got == [("/docs/read[me].md", 1, "os OS"), ("/src/a.py", 1, "import os"), ("/src/sub/b.py", 2, "y = os")]
    r = fs.grep(files, "PRINT(", fixed=True, ignore_case=True, before=1, after=1).collect()[0]
    assert (r.line_number, r.before, r.after) == (2, ["import os"], ["# end"])
    assert fs.grep(files, "os", under="/src/*", limit=5).count() == 1


def test_tree_operations(files):
    paths = lambda df: sorted(r.path for r in df.collect())
    assert [r.size for r in fs.stat(files, "/src/a.py").collect()] == [27]
    assert [r.path for r in fs.iterdir(files, "/src").collect()] == ["/src/a.py", "/src/sub"]
    assert bytes(fs.read(files, "/src/a.py", 7, 2).collect()[0].content) == b"os"
    moved = fs.rename(files, "/src", "/lib")
    assert "/lib/sub/b.py" in paths(moved) and "/src/a.py" not in paths(moved)
    assert "/nul" not in paths(fs.unlink(files, "/nul"))
    grown = fs.append(files, "/empty", b"abc")
    assert [r.size for r in fs.stat(grown, "/empty").collect()] == [3]
    assert "/new" in paths(fs.mkdir(files, "t", "/new")) and len(paths(fs.mkdir(files, "t", "/src/sub"))) == len(FILES)
    assert "/new" not in paths(fs.rmdir(fs.mkdir(files, "t", "/new"), "/new"))
    with pytest.raises(Exception, match="not empty"):
        fs.rmdir(files, "/src/sub").collect()
    assert paths(fs.write(files, files.filter("path = '/bin'"))) == sorted(p for p, _, _ in FILES)
