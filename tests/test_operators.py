"""Edge cases of the general operators against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skein import queries
from skein.operators import dedupe, hierarchy, late, logparse, regrid

LABELS = "array<struct<name:string,value:string>>"
ORDER = queries.ORDER
T0 = dt.datetime(2025, 1, 6)


# --- 1: deliveries ---

WB = "delivery_id long, namespace string, request_id string, assignment_generation long, received_at timestamp_ntz, n_samples int"


def brute_removed(rows):
    groups = {}
    for r in rows:
        rid = (r[2] or "").strip().lower()
        if rid:
            groups.setdefault((r[1], rid), []).append(r)
    out = []
    for g in groups.values():
        g.sort(key=lambda r: (r[3] is None, -(r[3] or 0), r[4] is None, r[4] or T0, r[0]))
        out += [r[0] for r in g[1:]]
    return sorted(out)


def test_redelivered_against_brute_force(spark):
    rng = random.Random(1)
    rows = [
        (i, rng.choice(["a", "b", None]), rng.choice([None, "", "  ", "X1", " x1\t", "x2", "X2\n", "y"]), rng.choice([None, 1, 2]), rng.choice([None, T0, T0 + dt.timedelta(seconds=1)]), 1)
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, WB)
    got = sorted(r.delivery_id for r in dedupe.redelivered(df, ["namespace"], "request_id", ORDER, "delivery_id").collect())
    assert got == brute_removed(rows)
    kept = dedupe.exactly_once(df, ["namespace"], "request_id", ORDER)
    assert kept.columns == df.columns and kept.count() == 300 - len(got)


def test_dedupe_empty_repeated_and_extra_columns(spark):
    df = spark.createDataFrame([], WB)
    assert dedupe.exactly_once(df, ["namespace"], "request_id", ORDER).count() == 0
    one = spark.createDataFrame([(1, "a", "r", 1, T0, 5)] * 3, WB).withColumns({"n": F.lit(1), "v": F.lit(2), "value": F.lit("x" * 100_000)})
    got = dedupe.exactly_once(one, ["namespace"], "request_id", ORDER).collect()
    assert len(got) == 1 and got[0].n == 1 and len(got[0].value) == 100_000


# --- 2: grid ---

SAMPLES = f"namespace string, labels {LABELS}, timestamp_ms long, value double, stale boolean"
CATALOGUE = f"series_id long, namespace string, labels {LABELS}, interval_ms long"


def grid(spark, points, interval=10_000, gap=30_000):
    ls = [("__name__", "m"), ("x", "1")]
    samples = spark.createDataFrame([("n", rng_order, t, v, s) for rng_order, t, v, s in points], SAMPLES)
    series = spark.createDataFrame([(7, "n", ls, interval)], CATALOGUE)
    return regrid.regular_grid(regrid.counted_samples(samples, series), gap)


def test_grid_fills_and_marks(spark):
    a, b = [("__name__", "m"), ("x", "1")], [("x", "1"), ("e", ""), ("__name__", "m")]
    points = [(a, 5, 1.0, False), (b, 20_001, 2.0, False), (a, 20_002, 3.0, None), (a, 90_000, 4.0, False), (a, 40_000, float("nan"), False), (a, 50_000, None, False), (a, 60_000, 9.0, True), (None, 70_000, 1.0, False)]
    rows = {r.period_start_ms: r for r in grid(spark, points).collect()}
    assert sorted(rows) == list(range(0, 100_000, 10_000))
    assert [rows[t].value for t in sorted(rows)] == [1.0, 1.0, 3.0, 3.0, 3.0, 3.0, None, None, None, 4.0]
    assert [t for t in sorted(rows) if not rows[t].observed] == [10_000, 30_000, 40_000, 50_000, 60_000, 70_000, 80_000]
    assert rows[20_000].n == 2 and rows[10_000].filled and not rows[60_000].filled


def test_grid_days_are_apart_and_negative_times(spark):
    a = [("__name__", "m"), ("x", "1")]
    day = regrid.DAY_MS
    points = [(a, day - 10_000, 1.0, False), (a, day + 20_000, 1.0, False), (a, -25_000, 1.0, False), (a, -1, float("inf"), False)]
    missing = sorted(r.period_start_ms for r in regrid.missing_periods(grid(spark, points)).collect())
    assert missing == [-20_000]


def test_grid_covers_the_whole_span(spark, monkeypatch):
    monkeypatch.setattr(regrid, "CHUNK", 4)
    a, day = [("__name__", "m"), ("x", "1")], regrid.DAY_MS
    points = [(a, day - 10_000, 1.0, False), (a, day + 20_000, 2.0, False), (a, 3 * day, 3.0, False)]
    rows = {r.period_start_ms: r for r in grid(spark, points).collect()}
    assert sorted(rows) == list(range(day - 10_000, 3 * day + 1, 10_000))
    assert rows[day].filled and rows[day].value == 1.0 and rows[day + 10_000].filled
    assert [t for t in sorted(rows) if rows[t].filled] == [day, day + 10_000, day + 30_000, day + 40_000, day + 50_000]
    assert rows[2 * day].value is None and not rows[2 * day].observed


def test_grid_long_gap_crosses_chunks_and_empty(spark):
    a = [("__name__", "m"), ("x", "1")]
    assert regrid.missing_periods(grid(spark, [(a, 0, 1.0, False), (a, 50_000_000, 1.0, False)], interval=1000)).count() == 49_999
    assert grid(spark, []).count() == 0


def test_small_catalogue_is_not_needed(spark, monkeypatch):
    monkeypatch.setattr("skein.runtime.BROADCAST_ROWS", 0)
    monkeypatch.setattr("skein.runtime.is_small", lambda df, rows=0: False)
    a = [("__name__", "m"), ("x", "1")]
    assert grid(spark, [(a, 0, 1.0, False), (a, 20_000, 1.0, False)]).count() == 3


# --- 3: logs ---

LOGS = f"entry_id long, namespace string, labels {LABELS}, timestamp_ns long, line string, structured_metadata map<string,string>, ingested_at timestamp_ntz"
TS = 1_736_121_600_000_000_000


def entries(spark, lines, component="comp"):
    ls = [("component", component)] if component else []
    return spark.createDataFrame([(i + 1, "n", ls, TS, x, None, None) for i, x in enumerate(lines)], LOGS)


CASES = [
    ("2025-01-06T00:01:37.770999Z WARNING sharding::lease: limit reached", 1736121697770, "warn", "sharding::lease"),
    ("\x1b[2m2025-01-06T02:01:37.770Z\x1b[0m \x1b[31m  ERR\x1b[0m \x1b[2mlogs::flush\x1b[0m: x level=info\r", 1736128897770, "error", "logs::flush"),
    ("2025-01-06T02:01:37+02:00  INFO a::b: x", 1736121697000, "info", "a::b"),
    ("2025/01/06 00:01:18 [error] 47#26: *9692 could not", 1736121678000, "error", "comp"),
    ("<132>Jan  6 00:01:33 node-5 tailerd[7577]: peer said: level=error", 1736121693000, "warn", "tailerd"),
    ("<10>1 2025-01-06T00:01:18.468Z node-26 gateway 7970 ID24 - shard", 1736121678468, "critical", "gateway"),
    ("I0106 00:01:37.946763   51024 leader_election.go:289] cache", 1736121697946, "info", "leader_election"),
    ("06 Jan 2025 00:01:36.848 [flush-2] DEBUG dev.Main - query", 1736121696848, "debug", "dev.Main"),
    ("2025-01-06 00:01:36,632 - tools.job - INFO - query", 1736121696632, "info", "tools.job"),
    ("2025-01-06 00:01:05,502 CRITICAL [harness.logs] rollup", 1736121665502, "critical", "harness.logs"),
    ("2025-01-06 00:01:15.583 ERROR 1 --- [main] io.store.Flusher : x", 1736121675583, "error", "io.store.Flusher"),
    ("[2025-01-06 00:01:19.400] [Info] [ingester] lease", 1736121679400, "info", "ingester"),
    ("[2025-01-06 00:01:19.400] [-] [ruler] lease", 1736121679400, "unknown", "ruler"),
    ('level=info ts=2025-01-06T00:01:42.014508702Z caller=controller.go:853 msg="level=error"', 1736121702014, "info", "controller"),
    ('time="2025-01-06T00:01:29Z" lvl=notice msg="x - y" pod=p', 1736121689000, "info", "comp"),
    ('{"timestamp":"2025-01-06T00:01:35.338Z","level":"dbg","target":"m::r","fields":{"message":"x"}}', 1736121695338, "debug", "m::r"),
    ('{"ts": 1736128492815000445, "severity": "warn", "logger": "h.f", "msg": "m"}', 1736128492815, "warn", "h.f"),
    ('{"ts":1736121662.034,"severity":"trc","logger":"e","msg":"m"}', 1736121662034, "trace", "e"),
    ('{"msg":"m","component":"ruler","lvl":"fatal"', 1736121600000, "fatal", "ruler"),
    ("key=value", 1736121600000, "unknown", "comp"),
]


@pytest.mark.parametrize("alone", [False, True])
def test_layouts(spark, alone):
    cases = CASES if not alone else CASES[4:6]
    got = {r.entry_id: r for r in logparse.parse(entries(spark, [c[0] for c in cases])).collect()}
    for i, (line, ms, level, component) in enumerate(cases):
        r = got[i + 1]
        assert (r.event_ms, r.level, r.component, r.last_entry_id) == (ms, level, component, i + 1), line


def test_entries_over_rows(spark):
    lines = ["tail without a head", CASES[0][0], "\tat x.Y(Z.java:1)", "", None, "  \r", "Caused by: level=error", "{", '  "level": "warn",', '  "logger": "l.g",', '  "ts": 1736121662034', "}", "goroutine 1 [running]:", CASES[7][0] + "\n  limits:\n    since: 2025-02-08 11:18:00"]
    got = {r.entry_id: (r.last_entry_id, r.event_ms, r.level, r.component) for r in logparse.parse(entries(spark, lines)).collect()}
    assert got == {2: (7, 1736121697770, "warn", "sharding::lease"), 8: (13, 1736121662034, "warn", "l.g"), 14: (14, 1736121696848, "debug", "dev.Main")}


def test_message_of_entries_over_rows(spark):
    lines = [CASES[0][0], "\tat x.Y(Z.java:1)", "", "\x1b[31mCaused by: z\x1b[0m\r", "{", '  "level": "warn",', '  "list": [', "1,", "null", "  ],", '  "msg": "m"', "}", "goroutine 1 [running]:"]
    lines += ['level=info msg="x"\n  more', "last", '{"level":"info","msg":"cut",', "12,", "at q"]
    df = entries(spark, lines)
    got = {r.entry_id: r.message for r in logparse.parse(df.unionByName(df)).collect()}
    assert got == {1: "limit reached\n\tat x.Y(Z.java:1)\nCaused by: z", 5: "m\ngoroutine 1 [running]:", 14: "x\n  more\nlast", 16: "cut\nat q"}


def test_blocks_repeats_and_streams(spark, monkeypatch):
    monkeypatch.setattr(logparse, "CHUNK_IDS", 2)
    lines = [CASES[0][0]] + ["  more"] * 9 + [CASES[1][0]]
    df = entries(spark, lines)
    got = {r.entry_id: r.last_entry_id for r in logparse.parse(df.unionByName(df)).collect()}
    assert got == {1: 10, 11: 11}
    other = df.withColumn("namespace", F.lit("m")).withColumn("entry_id", F.col("entry_id") + 100).withColumn("kind", F.lit(1)).withColumn("leaf", F.lit(2))
    assert logparse.parse(df.unionByName(other, allowMissingColumns=True)).count() == 4


def test_logs_empty_long_and_unlabelled(spark):
    assert logparse.parse(entries(spark, [])).count() == 0
    long = "2025-01-06T00:01:37Z INFO a::b: " + "word " * 200_000
    r = logparse.parse(entries(spark, [long], component=None)).collect()[0]
    assert r.component == "a::b" and len(r.message) == len(("word " * 200_000).strip())
    assert logparse.parse(entries(spark, ["key=v"], component=None)).collect()[0].component is None


# --- 4: late records ---


def test_only_the_template_resolves_an_ambiguous_header(spark):
    """A level that nobody knows: the line's own header could as well be a message; its template says what it is."""
    line = "[2025-01-06 10:00:{:02d}.000] [{}] [{}] flushed {} segments"
    lines = [line.format(i, ("info", "warn")[i % 2], ("ruler", "compactor")[i // 2 % 2], i) for i in range(40)]
    odd = line.format(50, "loud", "ruler", 7)
    got = {r.entry_id: r for r in logparse.parse(entries(spark, [*lines, odd])).collect()}
    assert (got[41].level, got[41].component, got[41].message) == ("unknown", "ruler", "flushed 7 segments")
    assert got[41].template in {r.template for i, r in got.items() if i < 41}
    alone = logparse.parse(entries(spark, [odd])).first()
    assert alone.component != "ruler" and alone.message.startswith("[loud]")
    other = logparse.parse(entries(spark, [*lines, "2025-01-06 10:00:59,123 INFO [exporter] rollup skipped"])).filter("entry_id = 41").first()
    assert (other.level, other.component, other.message) == ("info", "exporter", "rollup skipped")  # built otherwise: a leaf of its own


def test_late_state_corrects_and_merges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", None]), rng.randrange(0, 900_000), rng.choice([1.0, 2.0, 3.0, None, float("nan")]), rng.randrange(0, 4_000_000)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, ns string, ms long, val double, at long")
    state = lambda part: late.multiset(part, ["ns"], F.col("ms"), F.col("at"), F.col("val"), 300_000, 1_800_000)
    both = late.merge(state(df.filter("id < 200")), state(df.filter("id >= 200")), keys=["ns"])
    got = {(r.ns, r.period_start_ms): (r.first_count, r.final_count, r.dropped_count) for r in late.counts(both, ["ns"]).collect()}
    want = {}
    values = {}
    for _, ns, ms, v, at in rows:
        p = ms // 300_000 * 300_000
        first, final, dropped = want.get((ns, p), (0, 0, 0))
        want[ns, p] = (first + (at < p + 300_000), final + (at < p + 2_100_000), dropped + (at >= p + 2_100_000))
        if at < p + 2_100_000 and v is not None and v == v:
            values.setdefault((ns, p), []).append(v)
    assert got == want
    stats = {(r.ns, r.period_start_ms): (r.n, r.distinct_values, r.minimum, r.maximum, r.median) for r in late.statistics(both, ["ns"]).collect()}
    for k, vs in values.items():
        vs.sort()
        assert stats[k] == (len(vs), len(set(vs)), vs[0], vs[-1], vs[(len(vs) - 1) // 2])


def test_statistics_of_both_sources(spark, tmp_path):
    at, ms = T0 + dt.timedelta(minutes=1), 1_736_121_600_000
    values = [1.5, 2.5, 2.5, float("nan"), None, float("inf")]
    spark.createDataFrame([(i, "n", ms + i, v, at) for i, v in enumerate(values)], "sample_id long, namespace string, timestamp_ms long, value double, ingested_at timestamp_ntz").write.parquet(f"{tmp_path}/samples.parquet")
    spark.createDataFrame([(1, "n", ms * 10**6, "four", at)], "entry_id long, namespace string, timestamp_ns long, line string, ingested_at timestamp_ntz").write.parquet(f"{tmp_path}/log_entries.parquet")
    rows = {r.src: (r.n, r.distinct_values, r.minimum, r.maximum, r.median) for r in queries.QUERIES["p4_statistics"](spark, str(tmp_path)).collect()}
    assert rows == {"sample": (4, 3, 1.5, float("inf"), 2.5), "log": (1, 1, 4.0, 4.0, 4.0)}


def test_statistics_of_a_hot_period_and_null_keys(spark):
    """A period that holds nearly all values is cut into ranges; its median comes out exactly."""
    values = [(i * 7919) % 5003 / 10 for i in range(5003)]
    rows = [("hot", 0, v, 1, 0, 0) for v in values] + [("hot", 300_000, 1.0, 0, 2, 0), (None, 0, 4.0, 1, 0, 0), (None, 0, 6.0, 2, 0, 5), ("gone", 0, 1.0, 0, 0, 3)]
    state = spark.createDataFrame(rows, "ns string, period_start_ms long, value double, on_time long, late long, dropped long").repartition(4)
    got = {(r.ns, r.period_start_ms): (r.n, r.distinct_values, r.minimum, r.maximum, r.median) for r in late.statistics(state, ["ns"]).collect()}
    ordered = sorted(values)
    assert got == {("hot", 0): (5003, 5003, ordered[0], ordered[-1], ordered[2501]), ("hot", 300_000): (2, 1, 1.0, 1.0, 1.0), (None, 0): (3, 2, 4.0, 6.0, 6.0)}
    assert late.statistics(state.limit(0), ["ns"]).count() == 0


def test_first_arrivals(spark):
    df = spark.createDataFrame([(1, "a", T0 + dt.timedelta(1)), (1, "a", T0), (1, "a", None), (2, "b", None)], "id long, v string, at timestamp_ntz")
    got = late.first_arrivals(df, ["id"], "at", ["v"]).collect()
    assert [(r.id, r.at) for r in got] == [(1, T0)]
    assert late.first_arrivals(df.limit(0), ["id"], "at", ["v"]).count() == 0


# --- 5: hierarchies ---

LINKS = "tree string, node string, parent string"


def brute_tree(links):
    parent = {(t, n): p if (t, p) in {(a, b) for a, b, _ in links} else None for t, n, p in links}
    out = {}
    for t, n, _ in links:
        path, at = [n], parent[t, n]
        while at is not None and at not in path and len(path) <= len(links):
            path.append(at)
            at = parent[t, at]
        out[t, n] = None if at is not None else path[::-1]
    below = {k: 0 for k in out}
    for (t, _), path in out.items():
        for a in (path or [])[:-1]:
            below[t, a] += 1
    return {k: ("", -1, -1, None) if p is None else (p[0], len(p) - 1, below[k], p) for k, p in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_against_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(t, f"n{i}", rng.choice([None, "gone", *[f"n{j}" for j in (range(i) if rng.random() < 0.9 else range(40))]])) for t in ("a", "b") for i in range(40)]
    links += [("deep", f"d{i}", f"d{i - 1}" if i else None) for i in range(70)] + [("star", f"s{i}", "s0" if i else None) for i in range(50)] + [("self", "x", "x")]
    df = spark.createDataFrame(links, LINKS)
    resolved = hierarchy.resolve(df, with_path=True)
    got = {(r.tree, r.node): (r.root, r.depth, r.n_descendants, r.path) for r in resolved.collect()}
    assert got == brute_tree(links)
    pairs = hierarchy.descendants(resolved).count()
    assert pairs == sum(r[1] for r in got.values() if r[1] > 0)


def test_hierarchy_empty_and_dirty_spans(spark):
    assert hierarchy.resolve(spark.createDataFrame([], LINKS)).count() == 0
    schema = "trace_id string, span_id string, refs array<struct<ref_type:string,trace_id:string,span_id:string>>, ingested_at timestamp_ntz, node string"
    rows = [
        ("T", "A", None, T0, "x"), ("t", "b", [("FOLLOWS_FROM", "t", "z"), ("CHILD_OF", "other", "q"), ("CHILD_OF", "T", "a")], T0, "x"), ("t", "B", [], None, "x"), ("u", "b", [("CHILD_OF", "u", "none")], T0, "x"), (None, "c", None, T0, "x"),
    ]
    got = {(r.tree, r.node): (r.root, r.depth, r.n_descendants) for r in hierarchy.resolve(hierarchy.span_links(spark.createDataFrame(rows, schema))).collect()}
    assert got == {("t", "a"): ("a", 0, 1), ("t", "b"): ("a", 1, 0), ("u", "b"): ("b", 0, 0)}
