"""Keeping lanes up to date as documents arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators import chunking, lexical


def ingest_documents(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, tokens: int = 256, overlap: int = 32) -> StreamingQuery:
    """Reads Parquet documents (doc_id, title, url, date, body) as they appear and adds their chunks, postings and lengths,
    each micro-batch under its own number, so that a batch run again replaces itself. Of a document that stands in a batch several
    times the row that sorts last counts. What a later batch brings anew counts instead of what earlier ones brought: see
    current(). Ends when the folder is used up."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("doc_id").agg(F.max(F.struct(*[c for c in batch.columns if c != "doc_id"])).alias("_r")).select("doc_id", "_r.*")
        latest.select("doc_id").write.mode("overwrite").parquet(f"{target}/documents/batch={number}")
        chunks = chunking.chunk_documents(latest, tokens, overlap)
        chunks = chunks.withColumn("chunk_id", F.xxhash64("doc_id", "granularity", "chunk_index"))
        chunks = chunks.persist()
        for name, lane in (("chunks", chunks), ("postings", lexical.postings(chunks, "chunk_id")), ("doc_len", lexical.lengths(chunks, "chunk_id"))):
            lane.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        chunks.unpersist()

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, lane: str) -> DataFrame:
    """A lane as of the latest batch of each document: what earlier batches brought of a document that came again is left out."""
    latest = spark.read.parquet(f"{target}/documents").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    chunks = spark.read.parquet(f"{target}/chunks").join(latest, ["doc_id", "batch"], "left_semi")
    if lane == "chunks":
        return chunks.drop("batch")
    return spark.read.parquet(f"{target}/{lane}").join(chunks.select("chunk_id", "batch"), ["chunk_id", "batch"], "left_semi").drop("batch")


def settled_queries(keys: DataFrame, quiet: str = "200 milliseconds", late: str = "1 second") -> DataFrame:
    """The last text of each burst of typing: (user_id, ts, text) grouped into sessions that end after a quiet gap."""
    sessions = keys.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", quiet).alias("w"))
    return sessions.agg(F.max_by("text", "ts").alias("text")).filter(F.char_length("text") >= 2)
