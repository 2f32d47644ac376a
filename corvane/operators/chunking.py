"""Chunks of documents: sections, pieces under a word limit, overlap, and the lanes made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.session import spread

#: Words per token, as a rule of thumb, and the heading pattern.
WORDS_PER_TOKEN = 0.75
HEADING = r"^#{1,6}[ \t]+([^\n]+)"


def max_words(tokens: int) -> int:
    return int(tokens * WORDS_PER_TOKEN)


def sections(body: Column | str) -> Column:
    """Array of (section, text): parts between headings, the heading they stand under (null before the first), no empty parts."""
    parts = F.split(T.col(body), r"(?m)(?=^#{1,6}[ \t]+\S)")

    def one(p: Column) -> Column:
        head = F.regexp_extract(p, HEADING, 1)
        return F.struct(F.when(p.rlike(HEADING), T.strip(head)).alias("section"), T.strip(F.regexp_replace(p, HEADING, "")).alias("text"))

    return F.filter(F.transform(parts, one), lambda x: x["text"] != "")


def merged(pieces: Column, limit: int, separator: str) -> Column:
    """Pieces joined in order as long as they stay within `limit` words; each trimmed, empty ones skipped."""
    clean = F.filter(F.transform(pieces, T.strip), lambda p: p != "")
    sized = F.transform(clean, lambda p: F.struct(p.alias("t"), T.word_count(p).alias("n")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        fits = a["cur"].isNotNull() & (a["n"] + x["n"] <= limit)
        done = F.when(a["cur"].isNull() | fits, a["done"]).otherwise(F.array_append(a["done"], a["cur"]))
        cur = F.when(fits, F.concat(a["cur"], F.lit(separator), x["t"])).otherwise(x["t"])
        return F.struct(done.alias("done"), cur.alias("cur"), F.when(fits, a["n"] + x["n"]).otherwise(x["n"]).alias("n"))

    return F.aggregate(sized, start, step, lambda a: F.when(a["cur"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["cur"])))


def pieces(c: Column | str, limit: int) -> Column:
    """A text within the limit as it is, else by paragraphs, else by sentences, else as it is. An oversized paragraph stays whole."""
    c = T.col(c)
    paragraphs, parts = F.split(c, "\n\n"), F.split(c, r"[.!?]+\s+")
    return F.when(T.word_count(c) <= limit, F.array(c)).when(F.size(paragraphs) > 1, merged(paragraphs, limit, "\n\n")).when(F.size(parts) > 1, merged(parts, limit, ". ")).otherwise(F.array(c))


def tail_words(c: Column, n: int) -> Column:
    """The last n words, single-spaced; a text of no more words unchanged."""
    w = T.words(c)
    return F.when(F.size(w) <= n, c).otherwise(F.array_join(F.slice(w, -n, n), " "))


def overlapped(items: Column, n: int) -> Column:
    """Array of (section, text) with the last n words of each text, as extended itself, put before the next one."""
    if n <= 0:
        return items
    start = F.struct(F.array().cast("array<struct<section:string,text:string>>").alias("done"), F.lit(None).cast("string").alias("prev"))

    def step(a: Column, x: Column) -> Column:
        t = F.when(a["prev"].isNull(), x["text"]).otherwise(F.concat(tail_words(a["prev"], n), F.lit(" "), x["text"]))
        return F.struct(F.array_append(a["done"], F.struct(x["section"].alias("section"), t.alias("text"))).alias("done"), t.alias("prev"))

    return F.aggregate(items, start, step, lambda a: a["done"])


def semantic_sections(body: Column | str, target: int) -> Column:
    """Array of (section, text), section null: sentences joined until the size is reached, or from a least size on until
    two neighbouring sentences share few words."""
    least = max(target // 3, 40)
    sized = F.transform(T.sentences(body), lambda s: F.struct(s.alias("t"), T.word_count(s).alias("n"), T.token_set(s).alias("w")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit(0).alias("n"), F.lit(None).cast("array<string>").alias("w"))

    def step(a: Column, x: Column) -> Column:
        likeness = F.when(a["w"].isNull(), F.lit(1.0)).otherwise(T.jaccard(a["w"], x["w"]))
        breaks = a["cur"].isNotNull() & (a["n"] >= least) & ((a["n"] + x["n"] > target) | (likeness < 0.14))
        grow = a["cur"].isNotNull() & ~breaks
        return F.struct(
            F.when(breaks, F.array_append(a["done"], a["cur"])).otherwise(a["done"]).alias("done"),
            F.when(grow, F.concat(a["cur"], F.lit(" "), x["t"])).otherwise(x["t"]).alias("cur"),
            F.when(grow, a["n"] + x["n"]).otherwise(x["n"]).alias("n"),
            x["w"].alias("w"),
        )

    found = F.aggregate(sized, start, step, lambda a: F.when(a["cur"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["cur"])))
    return F.transform(found, lambda t: F.struct(F.lit(None).cast("string").alias("section"), t.alias("text")))


def chunk_documents(docs: DataFrame, tokens: int = 256, overlap: int = 32, strategy: str = "heading", granularity: str = "fine", body: str = "body") -> DataFrame:
    """One row per chunk: the document's other columns, granularity, chunk_index (from 0), section and text.

    strategy is "heading" or "semantic". Documents with a null or blank body give no row. No shuffle beyond spreading.
    """
    limit = max_words(tokens)
    if strategy not in ("heading", "semantic"):
        raise ValueError(f"unknown strategy {strategy}")
    found = sections(body) if strategy == "heading" else semantic_sections(body, limit)
    cut_up = F.flatten(F.transform(found, lambda s: F.transform(pieces(s["text"], limit), lambda p: F.struct(s["section"].alias("section"), p.alias("text")))))
    rows = spread(docs.filter(T.col(body).isNotNull())).withColumn("_chunks", overlapped(cut_up, overlap))
    keep = [c for c in docs.columns if c != body and c not in ("granularity", "chunk_index", "section", "text")]
    return rows.select(*keep, F.lit(granularity).alias("granularity"), F.posexplode("_chunks").alias("chunk_index", "_c")).select(*keep, "granularity", "chunk_index", F.col("_c.section").alias("section"), F.col("_c.text").alias("text"))


def summary_lane(docs: DataFrame, body: str = "body") -> DataFrame:
    """One chunk per document of its first longer sentences, in the shape of chunk_documents."""
    keep = [c for c in docs.columns if c != body and c not in ("granularity", "chunk_index", "section", "text")]
    rows = docs.withColumn("_s", T.summary_sentences(body)).filter("_s is not null")
    return rows.select(*keep, F.lit("summary").alias("granularity"), F.lit(0).alias("chunk_index"), F.lit(None).cast("string").alias("section"), F.col("_s").alias("text"))


def all_lanes(docs: DataFrame, tokens: int = 256, overlap: int = 32, strategy: str = "heading", coarse_tokens: int | None = None, coarse_overlap: int | None = None, summary: bool = False, body: str = "body") -> DataFrame:
    """The fine lane, and where asked for the coarse and summary lanes of the same documents."""
    out = chunk_documents(docs, tokens, overlap, strategy, "fine", body)
    if coarse_tokens:
        out = out.unionByName(chunk_documents(docs, coarse_tokens, overlap if coarse_overlap is None else coarse_overlap, strategy, "coarse", body))
    return out.unionByName(summary_lane(docs, body)) if summary else out


def number_rows(df: DataFrame, order: list[str], name: str = "chunk_id") -> DataFrame:
    """df plus consecutive numbers from 0 in the given (total) order, without sorting everything in one task.

    Rows are range-partitioned and sorted; the driver sees one count per partition.
    """
    from corvane.session import cut

    parts = cut(df.repartitionByRange(*[F.col(c).asc() for c in order]).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    spans = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first")).orderBy("_part").collect()
    total, offsets = 0, []
    for s in spans:
        offsets.append((s["_part"], total - s["first"]))
        total += s["n"]
    table = df.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    return parts.join(F.broadcast(table), "_part").withColumn(name, F.col("_row") + F.col("_offset")).drop("_part", "_row", "_offset")
