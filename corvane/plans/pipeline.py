"""From a content folder to an index, and from a question to pages and an answer."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import answer as A
from corvane.operators import chunking, embed, evaluate, facts, lexical, ranking, report
from corvane.session import cut
from corvane.sources import content, settings, store

MODES, SCOPES = ("hybrid", "semantic", "keyword"), ("all", "chunks", "qa", "claims")
#: The settings a sweep tries where none are given.
CHUNK_SIZES, OVERLAPS = (192, 256, 320), (16, 32, 48)


def documents(spark: SparkSession, root: str, cms: str = "hugo") -> tuple[DataFrame, DataFrame]:
    """(documents with doc_id by path, errors) of a content folder."""
    docs, errors = content.parse_files(content.read_files(spark, root), cms)
    return chunking.number_rows(docs, ["source_path"], "doc_id"), errors


def fact_chunks(docs: DataFrame, tokens: int, overlap: int) -> DataFrame:
    """The lane facts are drawn from: always by headings, at the fine size."""
    lane = chunking.chunk_documents(docs, tokens, overlap, "heading", "facts")
    return chunking.number_rows(lane, ["doc_id", "chunk_index"], "chunk_id")


def build_lanes(docs: DataFrame, chunk_size: int = 256, overlap: int = 32, strategy: str = "heading", coarse_chunk_size: int | None = None, coarse_overlap: int | None = None, summary: bool = False, qa: bool = False, claims: bool = False, edits: tuple[DataFrame, DataFrame] | None = None, client: Callable[[str], str] | None = None, make: Callable[[], embed.Embedder] = embed.hashing_embedder) -> dict[str, DataFrame]:
    """The lanes of an index over documents: chunks, vectors, postings, doc_len and, where asked for, qa and claims."""
    lanes = chunking.all_lanes(docs, chunk_size, overlap, strategy, coarse_chunk_size, coarse_overlap, summary)
    lane_order = F.when(F.col("granularity") == "fine", 0).when(F.col("granularity") == "coarse", 1).otherwise(2)
    chunks = cut(chunking.number_rows(lanes.withColumn("_lane", lane_order), ["doc_id", "_lane", "chunk_index"], "chunk_id").drop("_lane"))
    out = {"chunks": chunks, "vectors": embed.embed_texts(chunks, "chunk_id", "text", make), "postings": lexical.postings(chunks, "chunk_id"), "doc_len": lexical.lengths(chunks, "chunk_id")}
    if not (qa or claims):
        return out
    source = cut(fact_chunks(docs, chunk_size, overlap))
    if qa:
        pairs = facts.extract_pairs(source)
        if client:
            written = facts.generate_pairs(source, client).join(source.select("chunk_id", F.col("title").alias("source_title"), F.col("url").alias("source_url"), F.col("section").alias("source_section")), "chunk_id")
            pairs = pairs.unionByName(written.withColumn("place", F.lit(1_000_000)))
        pairs = chunking.number_rows(facts.dedup_pairs(pairs, ["chunk_id", "place", "question", "answer"]), ["chunk_id", "place", "question", "answer"], "qa_id").drop("place", "chunk_id")
        out["qa"] = pairs.join(embed.embed_texts(pairs, "qa_id", embed.pair_text(), make), "qa_id")
    if claims:
        found = facts.extract_claims(source)
        order = ["chunk_id", "place"]
        found = facts.apply_edits(found, edits[1], edits[0], order) if edits else facts.dedup_claims(found, order)
        found = chunking.number_rows(found, [*order, "predicate", "object"], "claim_id").drop(*order)
        out["claims"] = found.join(embed.embed_texts(found, "claim_id", embed.claim_text(), make), "claim_id")
    return out


def build_index(spark: SparkSession, root: str, output: str, cms: str = "hugo", model_id: str = "hashing-64", dim: int = 64, claims_edits: str | None = None, **options) -> DataFrame:
    """Reads a content folder and writes its index; returns the files that couldn't be read."""
    docs, errors = documents(spark, root, cms)
    edits = settings.read_claim_edits(spark, claims_edits) if claims_edits else None
    store.write_index(output, model_id, dim, **build_lanes(docs, edits=edits, **options))
    return errors


def facts_of(spark: SparkSession, index: str, name: str, edits: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """The pairs (name "qa") or claims ("claims") of an index, drawn from its chunks anew where it has no such lane; claims with
    edits (additions, redaction rules) applied. Without repetitions, first come first."""
    if name in store.read_manifest(spark, index)["lanes"]:
        found, order = store.read_lane(spark, index, name).drop("embedding"), ["qa_id" if name == "qa" else "claim_id"]
    else:
        chunks = store.read_lane(spark, index, "chunks").filter("granularity = 'fine'")
        found, order = (facts.extract_pairs if name == "qa" else facts.extract_claims)(chunks), ["chunk_id", "place"]
    if name == "qa":
        return facts.dedup_pairs(found, order).drop(*order)
    return (facts.apply_edits(found, edits[1], edits[0], order) if edits else facts.dedup_claims(found, order)).drop(*order)


def report_text(spark: SparkSession, run_dir: str) -> str:
    """The report on a folder with index_runs.csv, search_results.csv and, where results were judged, judgments.csv."""
    rows = {name: report.read_rows(spark, path) for name in ("index_runs", "search_results", "judgments") if os.path.exists(path := f"{run_dir}/{name}.csv")}
    if len({"index_runs", "search_results"} & rows.keys()) < 2:
        raise FileNotFoundError(f"no runs in {run_dir}")
    runs = rows["index_runs"] if "run" in rows["index_runs"].columns else rows["index_runs"].withColumn("run", F.lit(1))
    table = report.benchmark_report(runs, rows["search_results"], rows.get("judgments"))
    return "\n".join(["# Benchmark", "", "## Datasets", "", report.markdown_table(report.dataset_profile(runs), 1), "", "## Results", "", report.markdown_table(table), ""])


def query_vectors(queries: DataFrame, make: Callable[[], embed.Embedder] = embed.hashing_embedder) -> DataFrame:
    return embed.embed_texts(queries, "query_id", "query", make).withColumnRenamed("embedding", "vector")


def retrieve(lanes: Callable[[str], DataFrame], queries: DataFrame, mode: str = "hybrid", k: int = 5, make: Callable[[], embed.Embedder] = embed.hashing_embedder) -> DataFrame:
    """(query_id, chunk_id, score, rank) of queries (query_id, query). Only the parts a mode needs are planned; an unknown
    mode is hybrid, which fuses three times k of each side."""
    keyword = lambda n: lexical.search_index(lanes("postings"), lanes("doc_len"), queries, n)
    semantic = lambda n: ranking.semantic_search(lanes("vectors"), query_vectors(queries, make), n, "chunk_id")
    if mode == "keyword":
        return keyword(k)
    if mode == "semantic":
        return semantic(k)
    return ranking.reciprocal_rank_fusion([semantic(3 * k), keyword(3 * k)], k, "chunk_id")


def search(spark: SparkSession, index: str, queries: DataFrame, mode: str = "hybrid", scope: str = "all", k: int = 5, make: Callable[[], embed.Embedder] = embed.hashing_embedder) -> dict[str, DataFrame]:
    """Ranked rows by scope: chunks with title, url, section and a snippet; qa and claims by similarity (not in keyword mode)."""
    lane = lambda name: store.read_lane(spark, index, name)
    out = {}
    if scope in ("all", "chunks"):
        hits = cut(retrieve(lane, queries, mode, k, make))
        out["chunks"] = hits.join(lane("chunks"), "chunk_id").select("query_id", "rank", "score", "chunk_id", "title", "url", "section", F.translate(F.substring("text", 1, 180), "\n", " ").alias("snippet"))
    known = store.read_manifest(spark, index)["lanes"]
    for name, key in (("qa", "qa_id"), ("claims", "claim_id")):
        if scope in ("all", name) and name in known and mode != "keyword":
            found = ranking.semantic_search(lane(name), query_vectors(queries, make), k, key)
            out[name] = cut(found).join(lane(name).drop("embedding"), key)
    return out


def search_with_answer(spark: SparkSession, index: str, queries: DataFrame, now: float, mode: str = "hybrid", k: int = 8, answer_k: int = 5, subject: str = "", make: Callable[[], embed.Embedder] = embed.hashing_embedder) -> tuple[DataFrame, DataFrame]:
    """(pages, answers): pages (query_id, rank, score, url, title, section, snippet), boosted by recency and granularities; and
    per query an answer from pairs, claims and pages with its citations."""
    lane = lambda name: store.read_lane(spark, index, name)
    hits = retrieve(lane, queries, mode, 3 * k if mode not in ("semantic", "keyword") else k, make)
    chunks = lane("chunks")
    best = cut(ranking.page_ranking(hits, chunks, k, now))
    pages = best.join(chunks.select("chunk_id", "title", "section", T.snippet("text").alias("snippet")), "chunk_id")
    asking, known = query_vectors(queries, make), store.read_manifest(spark, index)["lanes"]
    none = "query_id string, query string, score double, rank int, source_url string, question string, answer string, predicate string, object string"
    pairs = claims = spark.createDataFrame([], none)
    if "qa" in known:
        pairs = ranking.semantic_search(lane("qa"), asking, answer_k, "qa_id").join(lane("qa").drop("embedding"), "qa_id").join(queries, "query_id")
    if "claims" in known:
        found = ranking.claim_search(lane("claims"), asking, ranking.recency_by_url(chunks, now), answer_k)
        claims = found.join(lane("claims").drop("embedding"), "claim_id").join(queries, "query_id")
    evidence = A.collect_evidence(pairs, claims, pages.join(queries, "query_id"))
    return pages.drop("chunk_id"), A.answers(evidence, subject)


def tune(docs: DataFrame, suite: DataFrame, chunk_sizes: Sequence[int] = CHUNK_SIZES, overlaps: Sequence[int] = OVERLAPS, k: int = 5, mode: str = "hybrid", make: Callable[[], embed.Embedder] = embed.hashing_embedder) -> DataFrame:
    """Each pair of chunk size and overlap, best first, by how a suite of cases does on an index built with it.
    Each case gets as many hits as it asks for (top_k, else k), ranked as search ranks them."""
    limit = F.coalesce("top_k", F.lit(k)) if "top_k" in suite.columns else F.lit(k)
    queries = cut(suite.select(F.col("case_id").alias("query_id"), "query", limit.alias("_k")))
    limits = sorted(r["_k"] for r in queries.select("_k").distinct().collect()) or [k]
    tried = None
    for size in chunk_sizes:
        for overlap in overlaps:
            lanes = build_lanes(docs, size, overlap, make=make)
            lanes |= {name: cut(lanes[name]) for name in lanes if name != "chunks"} if len(limits) > 1 else {}
            parts = [retrieve(lanes.__getitem__, queries.filter(F.col("_k") == n).drop("_k"), mode, n, make).select("query_id", "chunk_id", "rank") for n in limits]
            hits = reduce(DataFrame.unionByName, parts).withColumnRenamed("query_id", "case_id")
            context = evaluate.contexts(hits.join(lanes["chunks"], "chunk_id"), ["case_id"])
            one = evaluate.evaluate_cases(suite, context).select("passed", "score", "weight").withColumn("chunk_size", F.lit(size)).withColumn("overlap", F.lit(overlap))
            tried = one if tried is None else tried.unionByName(one)
    return evaluate.best_settings(evaluate.suite_summary(tried, ["chunk_size", "overlap"]))
