"""Small files an editor or an evaluation keeps: edits, suites, query sets, labels, judgements, run settings."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.urls import normal_path
from corvane.operators.facts import keep_first

ADDS = "subject string, predicate string, object string, evidence string, source_title string, source_url string, source_section string, tags array<string>, confidence float"
RULES = "subject string, predicate string, object string, source_url string, contains string"
CASES = "id string, query string, must_match_any array<string>, must_include_all array<string>, top_k int, weight float, user_rating int"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def read_claim_edits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(additions, redaction rules) of a TOML file with [[add]] and [[redact]] tables."""
    with open(path, "rb") as f:
        table = tomllib.load(f)
    adds = [tuple(float(v) if k == "confidence" and v is not None else v for k, v in ((k, a.get(k)) for k in _names(ADDS))) for a in table.get("add", [])]
    rules = [tuple(r.get(k) for k in _names(RULES)) for r in table.get("redact", [])]
    return spark.createDataFrame(adds, ADDS), spark.createDataFrame(rules, RULES)


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """Cases of an acceptance suite. Raises ValueError where the suite is empty or a case can't be judged."""
    suite = spark.read.schema(f"name string, cases array<struct<{', '.join(c.replace(' ', ': ', 1) for c in CASES.split(', '))}>>").json(path, multiLine=True)
    empty = F.array().cast("array<string>")
    cases = suite.select("name", F.posexplode("cases").alias("place", "c")).select("name", "place", "c.*")
    cases = cases.withColumn("must_match_any", F.coalesce("must_match_any", empty)).withColumn("must_include_all", F.coalesce("must_include_all", empty)).withColumn("weight", F.coalesce("weight", F.lit(1.0).cast("float"))).withColumnRenamed("id", "case_id")
    bad = cases.filter((T.strip(F.coalesce("query", F.lit(""))) == "") | ((F.size("must_match_any") == 0) & (F.size("must_include_all") == 0)) | (F.col("weight") <= 0) | ~F.coalesce("user_rating", F.lit(1)).between(1, 5))
    if cases.isEmpty():
        raise ValueError("the suite has no cases")
    if wrong := [r["case_id"] for r in bad.select("case_id").limit(10).collect()]:
        raise ValueError(f"cases that can't be judged: {wrong}")
    return cases


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, …) of a query set; blank queries are dropped, missing ids are q001, q002 … by position."""
    rows = spark.read.schema("dataset_id string, queries array<struct<id: string, query: string, intent: string, difficulty: string, expected_terms: array<string>>>").json(path, multiLine=True)
    rows = rows.select("dataset_id", F.posexplode("queries").alias("place", "q")).select("dataset_id", "place", "q.*")
    name = F.coalesce(F.when(T.strip("id") != "", T.strip("id")), F.concat(F.lit("q"), F.lpad((F.col("place") + 1).cast("string"), 3, "0")))
    return rows.filter(T.strip(F.coalesce("query", F.lit(""))) != "").withColumn("query_id", name).drop("id", "place")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, query_id, url, grade, weight): graded pages, and relevant ones with grade 1 where not graded; grades over 0 only.
    The last entry of a query holds; weights of 0 or less count as 1."""
    with open(path, "rb") as f:
        entries = tomllib.load(f).get("labels", [])
    latest = {(e.get("dataset"), e.get("query_id")): e for e in entries}
    rows = []
    for (dataset, query), e in latest.items():
        graded = {u: float(g) for u, g in (e.get("graded_urls") or {}).items()}
        weight = float(e.get("weight") or 1.0)
        for u in e.get("relevant_urls") or []:
            graded.setdefault(u, 1.0)
        rows += [(dataset, query, u, g, weight if weight > 0 else 1.0) for u, g in graded.items() if g > 0]
    out = spark.createDataFrame(rows, "dataset string, query_id string, url string, grade double, weight double")
    return out.withColumn("url", normal_path("url")).groupBy("dataset", "query_id", "url").agg(F.max("grade").alias("grade"), F.max("weight").alias("weight"))


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a cache of JSON lines; broken lines are skipped, the last entry of a key holds."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    rows = lines.select("at", F.get_json_object("value", "$.key").alias("key"), F.col("value").alias("value")).filter("key is not null")
    return keep_first(rows.withColumn("at", -F.col("at")), [F.col("key")], ["at"]).select("key", "value")


def append_judgements(df: DataFrame, path: str) -> None:
    """Appends (key, …) as lines of JSON with sorted keys."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("append").text(path)


@dataclass
class RunSettings:
    """Settings of a benchmark run."""

    chunk_size: int = 256
    overlap: int = 32
    strategy: str = "heading"
    mode: str = "hybrid"
    scope: str = "chunks"
    top_k: int = 5
    runs: int = 2
    cutoffs: tuple[int, ...] = (1, 3, 5)
    datasets: list[dict] = field(default_factory=list)
    models: list[dict] = field(default_factory=list)
    judge: dict = field(default_factory=dict)
    query_generation: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)


def read_settings(path: str) -> RunSettings:
    """Settings of a TOML file; needs a dataset and a model; cutoffs are sorted positive numbers."""
    with open(path, "rb") as f:
        t = tomllib.load(f)
    if not t.get("datasets") or not t.get("models"):
        raise ValueError("settings need at least one dataset and one model")
    index, search = t.get("index", {}), t.get("search", {})
    cutoffs = tuple(sorted({k for k in t.get("relevance", {}).get("k", [1, 3, 5]) if isinstance(k, int) and k > 0}))
    return RunSettings(index.get("chunk_size", 256), index.get("overlap", 32), index.get("chunk_strategy", "heading"), search.get("mode", "hybrid"), search.get("scope", "chunks"), search.get("top_k", 5), t.get("suite", {}).get("runs_per_combo", 2), cutoffs or (1, 3, 5), t["datasets"], t["models"], t.get("judge", {}), t.get("query_generation", {}), {k: v for k, v in index.items() if k not in ("chunk_size", "overlap", "chunk_strategy")})


def number_list(raw: str) -> list[int]:
    """Distinct numbers of a comma-separated list in order; 0 or nothing is an error."""
    out = sorted({int(x) for x in raw.split(",") if x.strip()})
    if not out or out[0] <= 0:
        raise ValueError(f"needs positive numbers: {raw!r}")
    return out


def dump_suite(cases: DataFrame) -> str:
    """A suite as JSON text: an editor's file, so it passes through the driver."""
    rows = [r.asDict(recursive=True) for r in cases.orderBy("place").collect()]
    name = rows[0]["name"] if rows else "suite"
    return json.dumps({"name": name, "cases": [{k: v for k, v in r.items() if k not in ("name", "place") and v is not None} for r in rows]}, indent=2, ensure_ascii=False)
