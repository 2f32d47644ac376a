"""The pN_ queries, over whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.copies import copy_groups, record_key
from corvane.llm.distinctive import best_term, term_scores
from corvane.llm.fusion import best_item, fuse_scores
from corvane.llm.leakage import leaks
from corvane.llm.markup import clean_bodies
from corvane.llm.mojibake import repair_texts
from corvane.llm.oracles import oracle_sql  # noqa: F401
from corvane.llm.neighbours import nearest, similar_pairs
from corvane.llm.pairs import broken_pairs
from corvane.llm.split import split_files, split_plan, split_texts
from corvane.llm.tokenize import encode_texts
from corvane.session import work_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_item(fuse_scores(_read(spark, sf_dir, "search_result")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_term(term_scores(_read(spark, sf_dir, "postings"), _read(spark, sf_dir, "doc_len")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(_read(spark, sf_dir, "qa"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_bodies(_read(spark, sf_dir, "site_docs")).select("doc_id", F.explode("markup").alias("markup"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, questions = copy_groups(_read(spark, sf_dir, "qa"), "qa_id", record_key(ordered=["question"]))
    _, facts = copy_groups(_read(spark, sf_dir, "claims"), "claim_id", record_key(exact=["predicate"], swappable=["subject", "object"]))
    both = questions.withColumn("lane", F.lit("qa")).unionByName(facts.withColumn("lane", F.lit("claims")))
    return both.select("lane", "first_id", "copy_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(nearest(_read(spark, sf_dir, "vectors"), k=8, least=0.90), 0.90)


def p6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_read(spark, sf_dir, "vectors"), k=5)


def _items(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, str]]:
    return [("doc", _read(spark, sf_dir, "site_docs"), "doc_id", "body"), ("chunk", _read(spark, sf_dir, "chunks"), "chunk_id", "text")]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = (split_plan(df, i, t).select(F.lit(kind).alias("item_kind"), F.col(i).alias("item_id"), "boundary") for kind, df, i, t in _items(spark, sf_dir))
    return docs.unionByName(chunks)


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chunks = (split_texts(df, i, t).withColumnRenamed(i, "item_id").withColumn("item_kind", F.lit(kind)) for kind, df, i, t in _items(spark, sf_dir))
    return docs.unionByName(chunks).select("item_kind", "item_id", "piece", "words", "text")


def p7_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bodies of site_docs, one after the other in large files, cut without loading a file."""
    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    _read(spark, sf_dir, "site_docs").select("body").filter("body is not null").write.text(folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length")
    return split_files(files).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "piece", "words", "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(_read(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_texts(_read(spark, sf_dir, "documents")).select("doc_id", "recovery")


def p10_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_texts(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:].split("_")[0].isdigit()}
