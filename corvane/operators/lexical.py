"""BM25 over texts or over stored postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.session import cut, spread

K1, B = 1.2, 0.75
#: Query terms that are written into a plan; more of them, up to MOST_TERMS, are met by a broadcast.
LISTED_TERMS, MOST_TERMS = 1000, 1_000_000


def postings(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, id, tf) of every text."""
    rows = spread(df.filter(F.col(text).isNotNull()).select(id_column, text)).select(id_column, T.tokens(text).alias("_t"))
    return rows.select(id_column, F.explode("_t").alias("term")).groupBy("term", id_column).agg(F.count(F.lit(1)).cast("int").alias("tf")).select("term", id_column, "tf")


def lengths(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, dl) of every text, counted in terms."""
    return spread(df.filter(F.col(text).isNotNull()).select(id_column, text)).select(id_column, F.size(T.tokens(text)).alias("dl"))


def corpus_stats(dl: DataFrame) -> DataFrame:
    """One row (n, avgdl); avgdl is 0 for an empty corpus."""
    return dl.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))
    return idf * (tf * F.lit(K1 + 1)) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / avgdl))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times) of (query_id, query); a repeated term counts as often as it stands."""
    return queries.select("query_id", F.explode(T.tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _listed(terms: DataFrame) -> list[str] | None:
    """The distinct terms of queries, None where there are more than LISTED_TERMS of them."""
    some = [r["term"] for r in terms.select("term").distinct().limit(LISTED_TERMS + 1).collect()]
    if len(some) <= LISTED_TERMS:
        return some
    if terms.select("term").distinct().count() > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: search in several sets of queries")
    return None


def top(scored: DataFrame, k: int | None, id_column: str, group: str = "query_id") -> DataFrame:
    """The k highest scores of each query with their rank from 1; ties by id. NaN counts as the lowest score; k None ranks all."""
    order = Window.partitionBy(group).orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), id_column)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def _scored(hits: DataFrame, dl: DataFrame | None, terms: DataFrame, stats: DataFrame, df: DataFrame, id_column: str) -> DataFrame:
    rows = hits.join(F.broadcast(terms), "term").join(F.broadcast(df), "term")
    rows = rows if dl is None else rows.join(dl, id_column)
    rows = rows.crossJoin(F.broadcast(stats))  # one row
    weight = term_weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))
    return rows.groupBy("query_id", id_column).agg(F.sum(F.col("times") * weight).alias("score"))


def search_index(post: DataFrame, dl: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "chunk_id") -> DataFrame:
    """(query_id, id, score, rank) from stored lanes: only the postings of query terms are read.

    Queries are the stated small set; their terms are pushed to the scan. Postings repeated or with null or
    non-positive tf are left out, as are repeated or null lengths.
    """
    terms = cut(query_terms(queries))
    wanted = _listed(terms)
    of_queries = post.filter(F.col("term").isin(wanted)) if wanted is not None else post.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    valid = of_queries.filter("tf >= 1").select("term", id_column, "tf").distinct()
    sizes = dl.select(id_column, "dl").filter("dl is not null").distinct()
    found = cut(valid)
    return top(_scored(found, sizes, terms, corpus_stats(sizes), document_frequency(found), id_column), k, id_column)


def search_texts(df: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, id, score, rank) straight from texts: one pass keeps lengths and the counts of query terms only."""
    terms = cut(query_terms(queries))
    listed = _listed(terms)
    rows = spread(df.filter(F.col(text).isNotNull()).select(id_column, text)).select(id_column, T.tokens(text).alias("_t"))
    if listed is not None:
        wanted = F.array(*map(F.lit, listed)).cast("array<string>")
        rows = rows.select(id_column, F.size("_t").alias("dl"), F.filter("_t", lambda t: F.array_contains(wanted, t)).alias("_t"))
    else:
        rows = rows.select(id_column, F.size("_t").alias("dl"), "_t")
    rows = cut(rows)
    hits = rows.select(id_column, "dl", F.explode("_t").alias("term"))
    hits = hits if listed is not None else hits.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    hits = hits.groupBy(id_column, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    return top(_scored(hits, None, terms, corpus_stats(rows), document_frequency(hits), id_column), k, id_column)
