import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

import corvane.operators.skew as skew
from corvane.llm import copies, distinctive, fusion, neighbours

SCORES = "query_id string, lane string, chunk_id long, score double, weight int, _k string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def plain_fusion(data):
    by = {}
    for q, lane, c, s in data:
        if None not in (q, lane, c, s) and math.isfinite(s):
            by.setdefault(q, {}).setdefault(lane, {})
            by[q][lane][c] = max(s, by[q][lane].get(c, -math.inf))
    out = {}
    for q, lanes in by.items():
        items = {c for d in lanes.values() for c in d}
        total = dict.fromkeys(items, 0.0)
        for d in lanes.values():
            med = statistics.median(d.values())
            dev = [abs(x - med) for x in d.values()]
            scale = 1.4826 * statistics.median(dev) or sum(dev) / len(dev)
            for c in items:
                p = 1 / (1 + math.exp(-max(-40, min(40, (d[c] - med) / scale)))) if c in d and scale else 0.5
                total[c] += math.log(max(p, 1e-9))
        out |= {(q, c): math.exp(t / len(lanes)) for c, t in total.items()}
    return out


def test_fusion_equals_the_plain_model(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(f"q{q}", lane, int(c), float(rng.normal() * scale)) for q in range(4) for lane, scale in (("a", 1), ("b", 1000), ("c", 0.01)) for c in rng.choice(60, 40 if q else 55, replace=False)]
    data += [("q0", "a", 1, None), ("q0", "a", 2, float("nan")), ("q0", "b", 3, float("inf")), (None, "a", 1, 1.0), ("q9", "a", 1, None)] + data[:7]
    df = spark.createDataFrame([(*d, 1, "x") for d in data], SCORES)
    want = plain_fusion(data)
    monkeypatch.setattr(skew, "MOST_HOT_KEYS", 10**9)
    for hot in (20, 100_000):
        got = {(r["query_id"], r["chunk_id"]): r["fused"] for r in fusion.fuse_scores(df, hot_rows=hot).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_fusion_scale_ties_and_weights(spark):
    df = spark.createDataFrame([("q", "big", 1, 9e9), ("q", "big", 2, 1.0), ("q", "big", 3, 2.0), ("q", "small", 2, 0.9), ("q", "small", 3, 0.5), ("q", "small", 1, 0.1), ("t", "x", 7, 1.0), ("t", "x", 5, 1.0)], "query_id string, lane string, chunk_id long, score double")
    scaled = df.withColumn("score", F.when(F.col("lane") == "small", F.col("score") * 1e6).otherwise(F.col("score")))
    a, b = rows(fusion.best_item(fusion.fuse_scores(df)), "query_id", "chunk_id"), rows(fusion.best_item(fusion.fuse_scores(scaled)), "query_id", "chunk_id")
    assert a == b and ("t", 5) in a
    heavy = fusion.best_item(fusion.fuse_scores(df, weights={"small": 50.0}))
    assert ("q", 2) in rows(heavy, "query_id", "chunk_id")
    assert fusion.fuse_scores(df.limit(0)).count() == 0


def test_term_scores(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_HOT_KEYS", 10**9)
    post = [("the", c, 5, 0) for c in range(40)] + [("rare", 1, 4, 0), ("rare", 1, 4, 9), ("mid", 1, 1, 0), (None, 1, 9, 0), ("zero", 1, 0, 0), ("null", 1, None, 0), ("the", None, 3, 0)]
    lens = [(c, 10) for c in range(40)] + [(1, 10), (50, 0), (2, None)]
    p, d = spark.createDataFrame(post, "term string, chunk_id long, tf int, score int"), spark.createDataFrame(lens, "chunk_id long, dl int")
    for hot, most in ((2, 0), (5, 100), (100_000, 0), (100_000, 100)):
        scores = {(r["chunk_id"], r["term"]): r["score"] for r in distinctive.term_scores(p, d, hot_rows=hot, most_terms=most).collect()}
        assert set(scores) == {(c, "the") for c in range(40)} | {(1, "rare"), (1, "mid")}
        tfn, m = 4 * math.log2(1 + 1.0), 4 / 41
        assert scores[1, "rare"] == pytest.approx((math.log2(1 + m) + tfn * math.log2((1 + m) / m)) / (tfn + 1), rel=0.02)
        assert scores[1, "rare"] > scores[1, "the"]
    best = dict(rows(distinctive.best_term(distinctive.term_scores(p, d)), "chunk_id", "term"))
    assert best[1] == "rare" and best[0] == "the"
    assert distinctive.term_scores(p.limit(0), d.limit(0)).count() == 0


def test_letters_and_digits():
    assert copies.letters_and_digits("  Größe, 5-mal!\u200b") == copies.letters_and_digits("GRÖSSE 5mal") == "grösse5mal"
    assert copies.letters_and_digits("e\u0301") == "é" != copies.letters_and_digits("e")
    assert copies.letters_and_digits(None) == copies.letters_and_digits("–?!") == ""


def test_copies(spark, monkeypatch):
    monkeypatch.setattr(skew, "MOST_HOT_KEYS", 10**9)
    texts = ["What is it?", "what IS it", "What, is it!", "Why?", None, "", "—", "—"] + ["Hot one"] * 30
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, question string, key string").repartition(5)
    for hot in (3, 10**6):
        records, members = copies.copy_groups(df, "id", copies.record_key(ordered=["question"]), hot_rows=hot)
        assert rows(records, "first_id", "copies") == sorted([(0, 3), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1), (8, 30)])
        assert rows(members, "first_id", "copy_id") == [(0, 1), (0, 2)] + [(8, i) for i in range(9, 38)]
    records, members = copies.copy_groups(df.limit(0), "id", copies.record_key(ordered=["question"]))
    assert records.count() == members.count() == 0


def test_swapped_fields(spark):
    df = spark.createDataFrame([(1, "A b", "p", "C"), (2, "c", "p", "ab!"), (3, "c", "P", "ab"), (4, None, "p", "c"), (5, "ab", None, "c"), (6, "AB", None, "C"), (1, "A b", "p", "C")], "id long, s string, p string, o string")
    _, members = copies.copy_groups(df, "id", copies.record_key(exact=["p"], swappable=["s", "o"]))
    assert rows(members, "first_id", "copy_id") == [(1, 2), (5, 6)]


def test_filters_miss_no_repeat(spark, monkeypatch):
    df = spark.range(20_000).select(F.xxhash64(F.col("id") % 15_000).alias("h"), (F.col("id") % 15_000).alias("n")).repartition(7)
    for slice_hashes, room, held in ((10**6, 10**8, 10**6), (1000, 10**8, 500), (1000, 3000, 10**6)):
        monkeypatch.setattr(copies, "SLICE_HASHES", slice_hashes)
        monkeypatch.setattr(copies, "MOST_FILTER_BYTES", room)
        monkeypatch.setattr(copies, "HELD_HASHES", held)
        repeats, single = copies.possible_repeats(df, 20_000)
        assert single.filter("n < 5000").count() == 0 and repeats.count() + single.count() == 20_000
        assert single.count() > 0.95 * 10_000  # the filters keep their bits a hash at any number of slices


def test_graph_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, sims = neighbours.Graph(x).query(x, 6)
    true = np.argsort(-(x @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(ids, true)]) > 0.95
    assert neighbours.Graph(x[:1]).query(x[:3], 2)[0].tolist() == [[0, -1]] * 3
    same = np.repeat(x[:3], 40, axis=0)
    assert (neighbours.Graph(same).query(same, 3)[1] > 0.999).all()


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 8))
    near = base[:40] + rng.normal(size=(40, 8)) * 0.02
    x = np.concatenate([base, near]) * rng.uniform(0.1, 9, size=(340, 1))
    data = [(i, "l" if i % 2 else None, [float(v) for v in x[i]], 0.5) for i in range(340)]
    data += [(1000, "l", None, 0.1), (1001, "l", [0.0] * 8, 0.1), (1002, "l", [float("nan")] * 8, 0.1), (1003, "l", [1.0], 0.1), (1004, "l", [], 0.1), (None, "l", data[1][2], 0.1), data[3]]
    df = spark.createDataFrame(data, "vec_id long, lane string, embedding array<float>, similarity double")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(340) for j in range(i + 1, 340) if i % 2 == j % 2 and unit[i] @ unit[j] >= 0.95}
    for shard in (8192, 40):
        found = neighbours.nearest(df, k=8, size=8, shard_rows=shard, shard_queries=60)
        assert set(rows(neighbours.similar_pairs(found, 0.95), "vec_a", "vec_b")) == want
        assert found.filter("id = neighbour or place > 8").count() == 0
        close = neighbours.nearest(df, k=8, size=8, least=0.95, shard_rows=shard, shard_queries=60)
        assert set(rows(neighbours.similar_pairs(close, 0.95), "vec_a", "vec_b")) == want and close.filter("similarity < 0.95").count() == 0
    assert neighbours.nearest(df.limit(0), size=8).count() == 0


def test_far_nearest_against_brute_force(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(12, 64))[rng.integers(0, 12, 4000)] * 0.5 + rng.normal(size=(4000, 64))).astype(np.float32)
    lanes = np.where(np.arange(4000) % 3, "a", "b")
    df = spark.createDataFrame([(i, str(lanes[i]), x[i].tolist()) for i in range(4000)], "vec_id long, lane string, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.where(lanes[:, None] == lanes[None, :], unit @ unit.T, -2)
    np.fill_diagonal(sims, -2)
    want = {(i, int(j)) for i in range(4000) for j in np.argpartition(-sims[i], 5)[:5]}
    for shard in (2000, 200, 40):  # 2, 20 and 100 shards
        found = set(rows(neighbours.nearest(df, k=5, shard_rows=shard), "id", "neighbour"))
        assert len(found & want) >= 0.95 * len(want)
