"""Vector search, rank fusion, recency and page ranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.urls import recency
from corvane.operators.lexical import top
from corvane.session import cut

RRF_CONSTANT, GRANULARITY_SHARE = 60.0, 0.12
#: Query vectors that are sent to the workers at a time; scores a worker holds at a time.
QUERIES_AT_ONCE, SCORES_AT_ONCE = 10_000, 4_000_000


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products over the shorter length, in order, as a double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """A vector scaled to length 1; its length counts as at least 1e-12."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def _rows(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as the rows of a matrix of `width` columns: cut or filled up with zeros, nulls as zeros."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(lists.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = place < width
    out[np.repeat(np.arange(len(sizes)), sizes)[keep], place[keep]] = flat[keep]
    return out


def _nearest_of_batches(asked: list[tuple[str, list[float]]], k: int):
    """For each query all rows of a batch that can be among its k best; ties with the last of them included."""
    by_size: dict[int, list[int]] = {}
    for n, (_, v) in enumerate(asked):
        by_size.setdefault(len(v), []).append(n)
    groups = [(np.array(own), np.array([asked[n][1] for n in own], np.float64)) for size, own in by_size.items()]
    names = np.array([q for q, _ in asked], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, SCORES_AT_ONCE // len(asked))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                for own, q in groups:
                    scores = _rows(part.column(1), q.shape[1]) @ q.T
                    place = np.where(np.isnan(scores), -np.inf, scores)
                    least = np.partition(place, -k, axis=0)[-k] if k < len(place) else np.full(len(own), -np.inf)
                    i, j = np.nonzero(place >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(names[own[j]], pa.string()), part.column(0).take(pa.array(i)), pa.array(scores[i, j])], ["query_id", "id", "score"])

    return run


def semantic_search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) by brute-force dot product; queries are (query_id, vector), a stated set against all rows.

    Products run over the shorter length; null vectors and queries are left out. Batches of vectors are multiplied with
    QUERIES_AT_ONCE queries at a time, and only the k best rows of a batch (and ties) leave it before the shuffle.
    """
    kind = vectors.schema[id_column].dataType.simpleString()
    asking = queries.select(F.col("query_id").cast("string").alias("query_id"), F.transform("vector", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("vector")).filter("vector is not null")
    first = asking.limit(QUERIES_AT_ONCE + 1).collect()
    parts = [first]
    if len(first) > QUERIES_AT_ONCE:
        asking = cut(asking)
        n = 2 * math.ceil(asking.count() / QUERIES_AT_ONCE)
        parts = (asking.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).collect() for b in range(n))
    found = None
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v")).filter("v is not null")
    for part in parts:
        if part or found is None:
            near = rows.mapInArrow(_nearest_of_batches([(r[0], r[1]) for r in part], k), f"query_id string, id {kind}, score double") if part else rows.sparkSession.createDataFrame([], f"query_id string, id {kind}, score double")
            found = near if found is None else found.unionByName(near)
    return top(found.withColumnRenamed("id", id_column), k, id_column)


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int, id_column: str) -> DataFrame:
    """(query_id, id, score, rank): sum of 1 / (60 + rank) over rankings of (query_id, id, rank); ties by id."""
    both = rankings[0].select("query_id", id_column, "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select("query_id", id_column, "rank"))
    return top(both.groupBy("query_id", id_column).agg(F.sum(F.lit(1.0) / (F.lit(RRF_CONSTANT) + F.col("rank"))).alias("score")), k, id_column)


def page_ranking(hits: DataFrame, chunks: DataFrame, k: int, now: float, id_column: str = "chunk_id") -> DataFrame:
    """(query_id, url, id, score, rank): one row per page from hits (query_id, id, score) and chunks (id, url, date, granularity).

    A hit's score is boosted by recency; a page takes its best chunk plus a share of the best scores of its other granularities.
    """
    rows = hits.select("query_id", id_column, "score").join(chunks.select(id_column, "url", "date", F.coalesce("granularity", F.lit("fine")).alias("granularity")), id_column)
    rows = rows.withColumn("score", F.col("score") * recency("date", now))
    best = F.max(F.struct("score", (-F.col(id_column)).alias("i")))
    lanes = rows.groupBy("query_id", "url", "granularity").agg(best.alias("_b"))
    pages = lanes.groupBy("query_id", "url").agg(F.max("_b").alias("_b"), F.sum("_b.score").alias("_sum"), F.max("_b.score").alias("_max"))
    scored = pages.select("query_id", "url", (-F.col("_b.i")).alias(id_column), (F.col("_b.score") + F.lit(GRANULARITY_SHARE) * (F.col("_sum") - F.col("_max"))).alias("score"))
    return top(scored, k, id_column)


def recency_by_url(chunks: DataFrame, now: float) -> DataFrame:
    """(url, boost): the highest boost of any chunk of a page."""
    return chunks.groupBy("url").agg(F.max(recency("date", now)).alias("boost"))


def claim_search(claims: DataFrame, queries: DataFrame, boosts: DataFrame, k: int = 5, id_column: str = "claim_id") -> DataFrame:
    """The k nearest claims of each query, then re-ranked by the recency of their page (1 where it is unknown)."""
    near = semantic_search(claims, queries, k, id_column).drop("rank")
    rows = near.join(claims.select(id_column, F.col("source_url").alias("url")), id_column).join(boosts, "url", "left")
    return top(rows.select("query_id", id_column, (F.col("score") * F.coalesce("boost", F.lit(1.0))).alias("score")), k, id_column)
