import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import lexical, ranking, skew
from corvane.operators.embed import embed_texts
from corvane.session import cut

TEXTS = "doc_id long, text string"


def ids(df):
    return [(r["doc_id"], r["rank"]) for r in df.orderBy("rank").collect()]


def asked(spark, q):
    return spark.createDataFrame([("q", q)], "query_id string, query string")


def test_bm25_order(spark):
    docs = spark.createDataFrame([(0, "spark shuffle spark shuffle spark"), (1, "cooking pasta"), (2, "a spark of joy"), (3, None), (4, "")], TEXTS)
    assert [i for i, _ in ids(lexical.search_texts(docs, asked(spark, "spark shuffle"), 5))] == [0, 2]
    assert lexical.search_texts(docs, asked(spark, "absent"), 5).count() == 0
    assert lexical.search_texts(docs.limit(0), asked(spark, "spark"), 5).count() == 0


def test_bm25_ties_and_repeated_terms(spark):
    docs = spark.createDataFrame([(5, "same words"), (3, "same words"), (9, "other thing")], TEXTS)
    assert ids(lexical.search_texts(docs, asked(spark, "same"), 5)) == [(3, 1), (5, 2)]
    one = lexical.search_texts(docs, asked(spark, "same"), 1).first()["score"]
    assert lexical.search_texts(docs, asked(spark, "same same"), 1).first()["score"] == pytest.approx(2 * one)


def test_index_equals_texts(spark):
    docs = spark.createDataFrame([(i, f"term{i % 3} term{i % 5} common") for i in range(40)], TEXTS)
    post, dl = lexical.postings(docs), lexical.lengths(docs)
    a = lexical.search_index(post, dl, asked(spark, "term1 common"), 7, "doc_id").orderBy("rank").collect()
    b = lexical.search_texts(docs, asked(spark, "term1 common"), 7).orderBy("rank").collect()
    assert [(x["doc_id"], round(x["score"], 9)) for x in a] == [(x["doc_id"], round(x["score"], 9)) for x in b]


def test_vectors_and_fusion(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.7, 0.7]), (3, None), (4, [])], "vec_id long, embedding array<float>")
    query = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    found = ranking.semantic_search(vectors, query, 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [0, 2]
    rank = lambda order: spark.createDataFrame([("q", i, n + 1) for n, i in enumerate(order)], "query_id string, id long, rank int")
    fused = {r["id"]: r["score"] for r in ranking.reciprocal_rank_fusion([rank([0, 1, 2]), rank([2, 0, 1])], 3, "id").collect()}
    assert fused[0] > fused[2] > fused[1]


def test_page_ranking(spark):
    chunks = spark.createDataFrame([(1, "/a/", None, "fine"), (2, "/a/", None, "coarse"), (3, "/b/", None, None)], "chunk_id long, url string, date string, granularity string")
    hits = spark.createDataFrame([("q", 1, 0.5), ("q", 2, 0.4), ("q", 3, 0.52)], "query_id string, chunk_id long, score double")
    rows = ranking.page_ranking(hits, chunks, 5, 2026.0).orderBy("rank").collect()
    assert [(r["url"], r["chunk_id"], round(r["score"], 6)) for r in rows] == [("/a/", 1, 0.548), ("/b/", 3, 0.52)]


def test_hashing_embedder(spark):
    df = spark.createDataFrame([(1, "red apple pie"), (2, "apple pie red"), (3, None)], "id long, text string")
    v = {r["id"]: np.array(r["embedding"]) for r in embed_texts(df, "id", "text").collect()}
    assert np.allclose(v[1], v[2]) and abs(np.linalg.norm(v[1]) - 1) < 1e-5 and not v[3].any()


def test_exact_medians_select_hot_groups(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=5001).round(1), rng.normal(size=40)
    df = cut(spark.createDataFrame([("hot", float(v)) for v in x] + [("cold", float(v)) for v in y] + [("flat", 1.0)] * 900, "k string, v double").repartition(5))
    got = {r["k"]: (r["rows"], r["median"]) for r in skew.exact_medians(df, "k", "v", 300).collect()}
    assert got == {"hot": (5001, float(np.median(x))), "cold": (40, pytest.approx(float(np.median(y)))), "flat": (900, 1.0)}
    ranks = {r["k"]: r["value"] for r in skew.exact_ranks(df, "k", "v", 0.95, 300).collect()}
    assert ranks == {"hot": sorted(x)[round(0.95 * 5000)], "cold": sorted(y)[round(0.95 * 39)], "flat": 1.0}


def test_skew_join_equals_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 10}") for i in range(300)] + [(999, None)], "id long, key string")
    right = left.filter("key is not null").groupBy("key").count().withColumnRenamed("count", "n").selectExpr("key", "n", "length(key) as size")
    from pyspark.sql import functions as F

    a = sorted((r["id"], r["size"]) for r in skew.skew_join(left, right, "key", "n", F.col("id"), 20).collect())
    b = sorted((r["id"], r["size"]) for r in left.join(right, "key").collect())
    assert a == b
    assert skew.skew_join(left, right, "key", "n", F.col("id"), 20, "left").count() == 301


def test_top_without_a_limit(spark):
    scored = spark.range(1_000_003).select(F.lit("q").alias("query_id"), F.col("id").alias("chunk_id"), (-F.col("id")).cast("double").alias("score"))
    assert lexical.top(scored, None, "chunk_id").agg(F.max("rank")).first()[0] == 1_000_003
