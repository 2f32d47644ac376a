"""Command line: index, search, tune, qa-corpus, claims-corpus, report."""

from __future__ import annotations

import argparse
import datetime
import json

from pyspark.sql import SparkSession

from corvane.operators import facts
from corvane.plans import pipeline
from corvane.session import local_session
from corvane.sources import content, settings, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvane")
    verbs = p.add_subparsers(dest="verb", required=True)
    index = verbs.add_parser("index")
    index.add_argument("content_dir")
    index.add_argument("--cms", choices=sorted(content.PROFILES), default="hugo")
    index.add_argument("--output", default="index")
    index.add_argument("--chunk-size", type=int, default=256)
    index.add_argument("--overlap", type=int, default=32)
    index.add_argument("--chunk-strategy", choices=("heading", "semantic"), default="heading")
    index.add_argument("--coarse-chunk-size", type=int)
    index.add_argument("--coarse-overlap", type=int)
    for flag in ("--summary-lane", "--qa", "--claims"):
        index.add_argument(flag, action="store_true")
    index.add_argument("--claims-edits")
    search = verbs.add_parser("search")
    search.add_argument("index")
    search.add_argument("query")
    search.add_argument("--top-k", type=int, default=5)
    search.add_argument("--mode", choices=pipeline.MODES, default="hybrid")
    search.add_argument("--scope", choices=pipeline.SCOPES, default="all")
    search.add_argument("--answer", action="store_true")
    search.add_argument("--subject", default="")
    tune = verbs.add_parser("tune")
    tune.add_argument("content_dir")
    tune.add_argument("--cms", choices=sorted(content.PROFILES), default="hugo")
    tune.add_argument("--eval", required=True)
    tune.add_argument("--chunk-sizes", type=settings.number_list, default=list(pipeline.CHUNK_SIZES))
    tune.add_argument("--overlaps", type=settings.number_list, default=list(pipeline.OVERLAPS))
    tune.add_argument("--top-k", type=int, default=5)
    tune.add_argument("--mode", choices=pipeline.MODES, default="hybrid")
    tune.add_argument("--report")
    for name in ("qa-corpus", "claims-corpus"):
        verb = verbs.add_parser(name)
        verb.add_argument("index")
        verb.add_argument("output")
    verb.add_argument("--claims-edits")
    report = verbs.add_parser("report")
    report.add_argument("run_dir")
    report.add_argument("--output")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.getActiveSession() or local_session()
    if a.verb == "index":
        errors = pipeline.build_index(spark, a.content_dir, a.output, a.cms, claims_edits=a.claims_edits, chunk_size=a.chunk_size, overlap=a.overlap, strategy=a.chunk_strategy, coarse_chunk_size=a.coarse_chunk_size, coarse_overlap=a.coarse_overlap, summary=a.summary_lane, qa=a.qa, claims=a.claims)
        errors.show(20, truncate=False)
    elif a.verb == "search":
        queries = spark.createDataFrame([("q", a.query)], "query_id string, query string")
        for scope, rows in pipeline.search(spark, a.index, queries, a.mode, a.scope, a.top_k).items():
            print(scope)
            rows.orderBy("rank").show(a.top_k, truncate=80)
        if a.answer:
            now = datetime.datetime.now(datetime.UTC)
            _, answers = pipeline.search_with_answer(spark, a.index, queries, now.year + (now.timetuple().tm_yday - 1) / 365.2425, a.mode, a.top_k, subject=a.subject)
            answers.show(1, truncate=False)
    elif a.verb == "tune":
        docs, _ = pipeline.documents(spark, a.content_dir, a.cms)
        tried = pipeline.tune(docs, settings.read_suite(spark, a.eval), a.chunk_sizes, a.overlaps, a.top_k, a.mode).orderBy("place").collect()
        for r in tried:
            print(f"{r['place']}. --chunk-size {r['chunk_size']} --overlap {r['overlap']}: score {r['score']:.2f} of {r['weight']:.2f}, {r['passed']} of {r['total']} passed")
        if a.report:
            with open(a.report, "w", encoding="utf-8") as f:
                json.dump([r.asDict() for r in tried], f, indent=2)
    elif a.verb == "report":
        text = pipeline.report_text(spark, a.run_dir)
        with open(a.output or f"{a.run_dir}/report.md", "w", encoding="utf-8") as f:
            f.write(text)
    else:
        name = a.verb.split("-")[0]
        edits = settings.read_claim_edits(spark, a.claims_edits) if getattr(a, "claims_edits", None) else None
        facts.corpus_json(pipeline.facts_of(spark, a.index, name, edits), name).write.mode("overwrite").text(a.output)


if __name__ == "__main__":
    main()
