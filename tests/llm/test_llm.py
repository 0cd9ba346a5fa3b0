"""The llm operators against brute force, exact round trips and measured recall."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import lexicon, neighbours, packing, passages, percentiles, tokens

RANKS = f"{tokens.TOKENIZERS}/{tokens.RANKS}"
DOCS = "doc_id long, text string, ids string, doc string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], DOCS)


# --- 6: percentiles ---


@pytest.mark.parametrize("high", [True, False])
def test_rank_error_is_relative_to_the_protected_tail(high):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(0, 3, 200_000), np.full(50_000, 2.0)])
    rng.shuffle(values)
    parts = [percentiles.Sketch(high=high, seed=i) for i in range(20)]
    for s, v in zip(parts, np.array_split(values, 20), strict=True):
        s.add(v)
    whole = percentiles.Sketch.from_bytes(parts[0].to_bytes())
    for s in parts[1:]:
        whole.merge(percentiles.Sketch.from_bytes(s.to_bytes()))
    assert whole.n == len(values) and whole.kept < 25_000
    ordered = np.sort(values)
    for q in (0.001, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 0.9999):
        x = whole.quantiles([q])[0]
        low, up = np.searchsorted(ordered, x, "left") / len(values), np.searchsorted(ordered, x, "right") / len(values)
        distance = (1 - q) if high else q
        assert low - 0.05 * distance - 1e-5 <= q <= up + 0.05 * distance + 1e-5, (q, low, up)
    assert whole.quantiles([0, 1]) == [ordered[0], ordered[-1]]


def test_small_groups_are_exact(spark):
    rows = [("a", float(x)) for x in range(100)] + [("b", None), ("b", float("nan")), (None, 3.0), ("c", float("inf"))]
    df = spark.createDataFrame(rows, "k string, value double").withColumns({"n": F.lit(1), "part": F.lit(2)})
    got = {r.k: r for r in percentiles.read_out(percentiles.combined(percentiles.sketches(df, ["k"], F.col("value")), ["k"]), {"p50": 0.5, "top": 1.0}).collect()}
    assert set(got) == {"a", None, "c"} and got["a"].p50 == 49.0 and got["a"].n == 100 and got[None].p50 == 3.0 and got["c"].top == float("inf")
    empty = percentiles.combined(percentiles.sketches(df.limit(0), ["k"], F.col("value")), ["k"])
    assert empty.count() == 0


def test_both_tails_and_a_hot_day(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.random(60_000), rng.lognormal(0, 2, 60_000)])
    rows = spark.createDataFrame([("hot", 1, float(v)) for v in values] + [("cold", d, float(d)) for d in range(50)], "k string, day int, value double").repartition(24)
    parts = percentiles.sketches(rows, ["k", "day"], F.col("value"))
    days = percentiles.merged(parts, ["k", "day"], keep_part=True)
    assert days.filter("k = 'hot'").count() >= percentiles.MERGE_PARTS / 2  # no task merges all of the hot day
    got = {r.k: r for r in percentiles.read_out(percentiles.combined(days, ["k"]), {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p999": 0.999}).collect()}
    ordered = np.sort(values)
    for name, q in (("p01", 0.01), ("p25", 0.25), ("p50", 0.5), ("p99", 0.99), ("p999", 0.999)):
        rank = np.searchsorted(ordered, got["hot"][name], "right") / len(values)
        assert abs(rank - q) <= 0.05 * min(q, 1 - q) + 1e-5, (name, rank)
    assert got["hot"].n == len(values) and got["cold"].p50 == 24.0


# --- 7: neighbours ---


def brute_pairs(ids, x, k=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 12)
    np.fill_diagonal(sims, -9)
    out = set()
    for i in range(len(ids)):
        for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-sims[i, j], ids[j]))[:k]:
            out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(i, v.tolist(), "clash", 1) for i, v in zip(ids, x.astype(np.float32), strict=True)], "id string, vector array<float>, v string, sim int")


def test_exact_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 64)).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:2], 12, axis=0), x[:3] * 2])
    ids = [f"i{n:03d}" for n in rng.permutation(len(x))]
    order = np.argsort(ids)
    ids, x = [ids[i] for i in order], x[order]
    got = {(r.id_lo, r.id_hi) for r in neighbours.pairs(neighbours.nearest(frame(spark, ids, x))).collect()}
    assert got == brute_pairs(ids, x.astype(np.float64))


def test_few_rows_and_none(spark):
    x = np.eye(64)[:3]
    assert neighbours.nearest(frame(spark, ["a", "b", "c"], x)).count() == 6
    assert neighbours.nearest(frame(spark, ["a"], x[:1])).count() == 0
    odd = spark.createDataFrame([("a", x[0].tolist()), ("b", x[1].tolist()), ("n", None), ("s", [1.0]), ("z", [0.0] * 64), (None, x[2].tolist())], "id string, vector array<float>")
    assert {(r.id, r.other) for r in neighbours.nearest(odd).collect()} == {("a", "b"), ("b", "a")}
    assert neighbours.nearest(frame(spark, ["a"], x[:1]).limit(0)).count() == 0


def test_recall_with_hashing_and_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 64))
    own = np.concatenate([np.zeros(500, int), rng.integers(0, 60, 1000)])  # a third of the rows in one bucket
    x = centres[own] + 0.08 * rng.standard_normal((1500, 64))
    x = np.concatenate([x, rng.standard_normal((20, 64))])  # far from everything
    ids = [f"i{n:04d}" for n in range(len(x))]
    got = {(r.id_lo, r.id_hi) for r in neighbours.pairs(neighbours.nearest(frame(spark, ids, x))).collect()}
    want = brute_pairs(ids, x.astype(np.float32).astype(np.float64))
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9
    near = neighbours.nearest(frame(spark, ids, x)).groupBy("id").count()
    assert near.filter("count = 5").count() == len(ids)


def test_loose_clusters_meet_few_rows(spark):
    """Nearest neighbours at distance 0.5 (cosine 0.875): recall without comparing everything."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((800, 64))
    x = (centres / np.linalg.norm(centres, axis=1, keepdims=True))[rng.integers(0, 800, 8000)]
    x = (x + rng.standard_normal(x.shape) * 0.5 / np.sqrt(2) / 8).astype(np.float32)
    ids, stats = [f"i{n:04d}" for n in range(len(x))], []
    near = neighbours.nearest(frame(spark, ids, x), stats=stats).select("id", "other").collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    want = {(ids[i], ids[j]) for i, row in enumerate(np.argsort(-sims, axis=1)[:, :5]) for j in row}
    got = {(r.id, r.other) for r in near}
    assert 0.4 < np.median(np.sqrt(2 - 2 * np.sort(sims, axis=1)[:, -5])) < 0.6
    assert len(got & want) / len(want) >= 0.95
    assert sum(s["pairs"] for s in stats) / len(ids) ** 2 <= 0.05
    assert all(s["layout"].functions for s in stats)  # no round met all rows


def test_probes_differ_in_few_borders():
    place = np.random.default_rng(1).random((50, 5)) * 9
    cells, worth = neighbours.probes(place, 1.0, 0.5, 16)
    home = np.floor(place).astype(int)
    assert (cells[:, 0] == home).all() and worth[:, 0].all()
    moved = np.abs(cells - home[:, None])
    assert moved.max() == 1 and moved.sum(axis=2).max() <= 3
    assert all(len({tuple(c) for c, w in zip(cs, ws) if w}) == ws.sum() for cs, ws in zip(cells, worth))


def test_live_vectors(spark):
    good, nan, zero = [1.0] * 64, [float("nan")] + [1.0] * 63, [0.0] * 64
    rows = [("a", 1, False, good), ("a", 2, True, good), ("b", 1, True, None), ("b", 2, False, good), ("c", 1, False, nan), ("d", 1, False, zero), ("e", 1, False, [1.0] * 32), ("f", 1, False, None), ("g", 1, None, good), ("g", 1, None, good), (None, 1, False, good), ("h", 1, False, [None] + [1.0] * 63)]
    df = spark.createDataFrame(rows, "id string, seq long, deleted boolean, vector array<float>")
    assert sorted(r.id for r in neighbours.live_vectors(df).collect()) == ["b", "g"]


# --- 8: tokens ---

TEXTS = [None, "", " ", "a", "Hello world, it's 2025!", "naïve café 日本語 🙂 ​　x", "\r\n\t mixed \n\n ends  ", "<|endoftext|> as text", "x" * 3000, "12 " * 2000 + "é", "a\x1cb\x85c", "don't've'll 'S", "ﬁ ǅ ²½ Ⅷ"]


def test_ids_equal_the_public_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in tokens.encode(docs(spark, TEXTS), "doc_id").collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == (t.encode(text, add_special_tokens=False).ids if text else []), text


def test_ids_without_any_lexicon_word_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(tokens, "LEXICON_WORDS", 0)
    want = [(r.doc_id, r.ids) for r in tokens.encode(docs(spark, TEXTS), "doc_id").orderBy("doc_id").collect()]
    monkeypatch.undo()
    assert want == [(r.doc_id, r.ids) for r in tokens.encode(docs(spark, TEXTS), "doc_id").orderBy("doc_id").collect()]
    assert tokens.encode(docs(spark, TEXTS).limit(0), "doc_id").count() == 0


def test_automaton_is_minimal_and_numbers_words(tmp_path):
    ranks = lexicon.read_ranks(RANKS)
    words = [" tap", " taps", " top", " tops", "tap", "taps", "a", "ab", "日本"]
    a = lexicon.Automaton(sorted(w.encode() for w in words))
    assert len(a.arrays()[3]) < sum(map(len, words))  # suffixes are shared
    path = tmp_path / "lex.bin"
    path.write_bytes(lexicon.compile_lexicon(words, ranks))
    lex = lexicon.Lexicon(str(path))
    numbers = lex.numbers([w.encode() for w in sorted(words, key=str.encode)] + [b"ta", b"tapsx", b"", b"zz"]).tolist()
    assert numbers == [*range(len(words)), -1, -1, -1, -1]
    for w, n in zip(sorted(words, key=str.encode), numbers, strict=False):
        assert lex.ids_of(n) == lexicon.merge_word(w.encode(), ranks)


def test_a_very_long_word_takes_seconds():
    import time

    ranks, rng = lexicon.read_ranks(RANKS), random.Random(2)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)).encode()
    began = time.time()
    ids = lexicon.merge_word(word, ranks)
    assert time.time() - began < 30
    names = {v: k for k, v in ranks.items()}
    assert b"".join(names[i] for i in ids) == word


def test_decoding_gives_the_texts_back(spark):
    got = {r.doc_id: r.text for r in tokens.decode(tokens.encode(docs(spark, TEXTS), "doc_id"), "doc_id").collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}


def test_split_joins_to_the_text():
    rng = random.Random(4)
    exact = lexicon._patterns()[1]
    for _ in range(500):
        t = "".join(rng.choice("ab1 2'\n\t\x1c é,.s ") for _ in range(rng.randrange(400)))
        assert "".join(lexicon.split(t)) == t and lexicon.split(t) == exact(t)


# --- 9: packing ---


def test_every_token_is_placed_once_within_capacity(spark):
    rng = random.Random(6)
    texts = [None, "", "word " * 5000] + ["word " * rng.randrange(1, 900) for _ in range(300)]
    sizes = spark.createDataFrame([("s", 512), ("m", 2048), ("none", 0), ("null", None), (None, 512)], "size_name string, capacity_tokens long")
    df = docs(spark, texts)
    packed = packing.pack(df, sizes)
    length = {r.doc_id: len(r.ids) for r in tokens.encode(df, "doc_id").collect()}
    rows = packed.collect()
    for name, capacity in (("s", 512), ("m", 2048)):
        own = [r for r in rows if r.size_name == name]
        fill, placed = {}, {}
        for r in own:
            fill[r.bin] = fill.get(r.bin, 0) + r.n_tokens
            placed.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        assert max(fill.values()) <= capacity
        assert set(placed) == {d for d, n in length.items() if n}
        for d, parts in placed.items():
            parts.sort()
            assert len(parts) == max(1, -(-length[d] // capacity)) and sum(n for _, n in parts) == length[d]
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert sum(fill.values()) / (len(fill) * capacity) > 0.9
    assert {r.size_name for r in rows} == {"s", "m"}
    assert packing.pack(df.limit(0), sizes).count() == 0


def test_harmonic_small_cases():
    assert packing.harmonic(np.array([], int), 10).tolist() == []
    size = np.array([10, 6, 4, 5, 5, 1])
    bins = packing.harmonic(size, 10)
    assert all(size[bins == b].sum() <= 10 for b in set(bins)) and len(set(bins)) == 4


# --- 10: passages ---


def brute_shared(texts, span):
    where = {}
    for d, t in texts:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], set()).add(d)
    out = {}
    for d, t in texts:
        hit = [False] * len(t or "")
        for i in range(len(t or "") - span + 1):
            if len(where[t[i : i + span]]) > 1:
                hit[i : i + span] = [True] * span
        if any(hit):
            out[d] = sum(hit)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_shared_chars_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé日🙂 \n") for _ in range(n))
    common = [word(rng.randrange(35, 130)) for _ in range(6)]
    texts = []
    for i in range(60):
        parts = [word(rng.randrange(0, 80)) if rng.random() < 0.6 else rng.choice(common)[rng.randrange(3) :] for _ in range(rng.randrange(0, 8))]
        texts.append((i, "".join(parts)))
    texts += [(100, None), (101, ""), (102, "0" * 300), (103, "0" * 200), (104, common[0] * 3), (105, "xy" * 200), (106, "yx" * 90)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"h": F.lit(1), "piece": F.lit("x")})
    windows = passages.shared_passages(df, span=40, gram=16)
    got = {r.doc_id: r.shared_chars for r in passages.shared_chars(windows, 40).collect()}
    want = brute_shared(texts, 40)
    assert got == want
    assert {r.doc_id: r.n for r in passages.spans(windows, 40).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == want


def test_same_document_copies_and_empty(spark):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(120))
    same = spark.createDataFrame([(1, text), (1, text), (2, text[:100])], "doc_id long, text string")
    assert passages.shared_passages(same).count() == 0
    two = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert {r.doc_id: r.shared_chars for r in passages.shared_chars(passages.shared_passages(two)).collect()} == {1: len(text), 2: len(text)}
    assert passages.shared_passages(two.limit(0)).count() == 0
    assert passages.shared_passages(spark.createDataFrame([(1, text), (None, text)], "doc_id long, text string")).count() == 0


def test_long_texts_go_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    df = spark.createDataFrame([(1, text), (2, "q" * 50 + text[5_000:25_000])], "doc_id long, text string")
    monkeypatch.setattr(passages, "PIECE", 1000)
    got = {r.doc_id: r.shared_chars for r in passages.shared_chars(passages.shared_passages(df)).collect()}
    assert got == {1: 20_000, 2: 20_000}


def test_incremental_runs_and_compaction(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(8)]
    texts = [(i, base[i % 8] + str(i)) for i in range(20)]
    index = passages.FingerprintIndex(spark)
    everything = spark.createDataFrame(texts, "doc_id long, text string")
    for k in range(5):
        [run] = index.add(everything.filter(F.col("doc_id") % 5 == k))
    found = passages.shared_windows(index.matches(run), passages.keyed(everything, "doc_id", "text"))
    got = {r.doc_id for r in found.select("doc_id").distinct().collect()}
    last = {i for i, _ in texts if i % 5 == 4}
    assert {i for i in last if sum(j % 8 == i % 8 for j, _ in texts) > 1} <= got
    before = index.rows().count()
    index.compact()
    assert [level for level, _ in index.runs] == [1] and index.rows().count() == before


def test_history_is_merged_without_an_exchange(spark):
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    index = passages.FingerprintIndex(spark)
    runs = index.add(spark.createDataFrame([(i, base[: 300 + 10 * i]) for i in range(40)], "doc_id long, text string"), batches=3)
    plan = index.matches(runs[-1])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    settled = index.rows().filter(F.col("hot").isNotNull())
    assert settled.count() > 0  # a hot passage fills no bucket
    assert settled.select("slot").distinct().count() > settled.select("h").distinct().count()
