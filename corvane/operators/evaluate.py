"""Acceptance suites, relevance metrics, parameter sweeps and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.urls import normal_path
from corvane.operators.skew import exact_medians, exact_ranks
from corvane.session import cut

#: How much a user's rating weighs.
RATING_WEIGHT = {1: 2.0, 2: 1.75, 3: 1.5, 4: 1.25}


def rating_weight(rating: Column | str) -> Column:
    out = F.lit(1.0)
    for r, w in RATING_WEIGHT.items():
        out = F.when(T.col(rating) == r, w).otherwise(out)
    return out


def comparable(c: Column | str) -> Column:
    return T.one_space(F.lower(T.col(c)))


def evaluate_cases(cases: DataFrame, contexts: DataFrame) -> DataFrame:
    """cases (case_id, must_match_any, must_include_all, weight) against contexts (case_id, context): passed, matched_any,
    missing_all and score. Any one of the first list and all of the second must occur; blank phrases and an empty list pass."""
    hay = comparable("context")
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda p: comparable(p) != "")
    rows = cases.join(contexts, "case_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    rows = rows.withColumn("_any", clean("must_match_any"))
    hits = F.filter("_any", lambda p: F.contains(hay, comparable(p)))
    rows = rows.withColumn("matched_any", F.when(F.size(hits) > 0, hits[0])).withColumn("missing_all", F.filter(clean("must_include_all"), lambda p: ~F.contains(hay, comparable(p))))
    passed = ((F.size("_any") == 0) | F.col("matched_any").isNotNull()) & (F.size("missing_all") == 0)
    return rows.withColumn("passed", passed).withColumn("score", F.when(passed, F.col("weight")).otherwise(F.lit(0.0))).drop("_any", "context")


def suite_summary(evaluated: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Totals of evaluated cases: total, passed, pass_rate, score, weight."""
    return evaluated.groupBy(*(group or [])).agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), (F.count_if("passed") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("pass_rate"), F.sum("score").alias("score"), F.sum("weight").alias("weight"))


def contexts(ranked: DataFrame, group: list[str]) -> DataFrame:
    """(group…, context): titles, addresses, sections and texts of the retrieved chunks (few per group) in rank order."""
    part = F.concat("title", F.lit("\n"), "url", F.lit("\n"), F.coalesce(F.concat("section", F.lit("\n")), F.lit("")), "text", F.lit("\n\n"))
    return ranked.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))), lambda x: x["t"]), "").alias("context"))


def best_settings(summary: DataFrame) -> DataFrame:
    """Candidates of a sweep, best first: by score, pass rate, then the smaller chunk size and overlap. place counts from 1."""
    order = Window.orderBy(F.desc("score"), F.desc("pass_rate"), "chunk_size", "overlap")
    return summary.withColumn("place", F.row_number().over(order))  # a grid of settings: a handful of rows


def relevance_metrics(results: DataFrame, labels: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5), k: int = 5) -> DataFrame:
    """(query_id, first_rank, mrr, hit_at_…, ndcg): results (query_id, url, rank) against labels (query_id, url, grade).

    Addresses are compared by path; a page counts once, at its first rank. Labels of grade 0 or less don't count.
    """
    good = labels.filter("grade > 0").select("query_id", normal_path("url").alias("url"), "grade").groupBy("query_id", "url").agg(F.max("grade").alias("grade"))
    seen = results.select("query_id", normal_path("url").alias("url"), "rank").groupBy("query_id", "url").agg(F.min("rank").alias("rank"))
    seen = seen.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "url")))
    rows = seen.join(good, ["query_id", "url"], "left")
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + F.lit(1.0))
    first = F.min(F.when(F.col("grade").isNotNull(), F.col("rank")))
    per = rows.groupBy("query_id").agg(first.alias("first_rank"), F.sum(F.when((F.col("rank") <= k) & F.col("grade").isNotNull(), gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("_dcg"))
    ideal = good.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "url"))).filter(F.col("_r") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("_r"))).alias("_ideal"))
    out = ideal.join(per, "query_id", "left")
    hits = [F.when(F.col("first_rank") <= c, 1.0).otherwise(0.0).alias(f"hit_at_{c}") for c in cutoffs]
    return out.select("query_id", "first_rank", F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)).alias("mrr"), *hits, F.coalesce(F.col("_dcg") / F.col("_ideal"), F.lit(0.0)).alias("ndcg"))


def latency_report(df: DataFrame, group: list[str], value: str, hot_rows: int = 1_000_000) -> DataFrame:
    """(group…, runs, mean, median, p95) of a timing column; p95 is the value at round(0.95 * (runs - 1)), halves to even.

    Medians and ranks are exact; groups over `hot_rows` rows are narrowed down by counts instead of being gathered.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*group, F.to_json(F.struct(*group)).alias("_k"), F.col(value).cast("double").alias("_v"))
    rows = cut(rows)
    base = rows.groupBy("_k", *group).agg(F.count(F.lit(1)).alias("runs"), F.avg("_v").alias("mean"))
    slim = rows.select("_k", "_v")
    return base.join(exact_medians(slim, "_k", "_v", hot_rows, "median").drop("rows"), "_k").join(exact_ranks(slim, "_k", "_v", 0.95, hot_rows, "p95").drop("rows"), "_k").drop("_k")
