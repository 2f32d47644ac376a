"""How characteristic a term is of a record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.skew import hot_keys, hot_threshold, skew_join
from corvane.session import cut, stored

#: What is known about each term is broadcast up to this many terms and bytes of terms; beyond, postings move to it by term.
MOST_TERMS, MOST_TERM_BYTES = 500_000, 16_000_000


def term_scores(postings: DataFrame, lengths: DataFrame, term: str = "term", record: str = "chunk_id", tf: str = "tf", length: str = "dl", c: float = 1.0, hot_rows: int = 200_000, most_terms: int = MOST_TERMS) -> DataFrame:
    """(record, term, tf, score): divergence from randomness of every posting.

    With tfn = tf * log2(1 + c * average length / length) and the term's mean frequency m = all its occurrences / records,
    score = (log2(1 + m) + tfn * log2((1 + m) / m)) / (tfn + 1): the information content under a geometric model of the
    collection times the Laplace after-effect gain.

    - Postings with a null term or record or a tf that is null or under 1 are left out. Repeated postings count once; should
      their tf differ, the largest counts.
    - Repeated lengths count once (the largest). Where a length is null, 0, negative or missing, the record's sum of tf stands in.
    - The number of records is that of distinct records in either table; the average is over the lengths above 0.
    - Other columns are ignored. An empty table gives an empty result.

    Postings move once, by record; the same exchange serves the records' lengths, the terms' statistics and the scores.
    Records over `hot_rows` postings are known beforehand from counts, are spread by term and meet a broadcast of their
    lengths. The terms' statistics, over all postings, are broadcast where they are at most `most_terms` (counted beforehand);
    a larger vocabulary is met by a join that spreads the terms over `hot_rows` postings.
    """
    raw = postings.select(F.col(term).alias("_t"), F.col(record).alias("_r"), F.col(tf).cast("long").alias("_tf")).filter("_t is not null and _r is not null and _tf >= 1")
    vocabulary = raw.groupBy("_t").agg(F.count(F.lit(1)).alias("_n")).agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum(F.octet_length("_t").cast("long")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows")).first()
    hot = hot_threshold(vocabulary["rows"], hot_rows)
    busy = hot_keys(raw, "_r", hot)
    known = lengths.select(F.col(record).alias("_r"), F.col(length).cast("double").alias("_dl")).filter("_r is not null")

    def measured(rows: DataFrame, given: DataFrame) -> DataFrame:
        own = rows.groupBy("_r").agg(F.sum("_tf").alias("_sum"))
        sizes = given.groupBy("_r").agg(F.max("_dl").alias("_dl")).join(own, "_r", "full")
        return sizes.select("_r", F.when(F.col("_dl") > 0, F.col("_dl")).when(F.col("_sum") > 0, F.col("_sum").cast("double")).alias("_len"))

    cold = raw if busy is None else raw.join(F.broadcast(busy.select("_r")), "_r", "left_anti")
    rows = cold.repartition("_r").groupBy("_r", "_t").agg(F.max("_tf").alias("_tf"))
    sizes = measured(rows, known if busy is None else known.join(F.broadcast(busy.select("_r")), "_r", "left_anti"))
    placed = rows.join(sizes, "_r")
    if busy is not None:
        keys = F.broadcast(busy.select("_r"))
        wide = stored(raw.join(keys, "_r", "left_semi").groupBy("_r", "_t").agg(F.max("_tf").alias("_tf")))
        long = cut(measured(wide, known.join(keys, "_r", "left_semi")))
        placed = placed.unionByName(wide.join(F.broadcast(long), "_r"))  # at most MOST_HOT_KEYS rows
        rows, sizes = rows.unionByName(wide), sizes.unionByName(long)
    corpus = sizes.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"))  # one row
    terms = rows.groupBy("_t").agg(F.count(F.lit(1)).alias("rows"), F.sum("_tf").alias("_occurs"))
    if vocabulary["terms"] <= most_terms and vocabulary["bytes"] <= MOST_TERM_BYTES:
        placed = placed.join(F.broadcast(terms.drop("rows")), "_t")
    else:
        placed = skew_join(placed, cut(terms), "_t", "rows", F.col("_r"), hot)
    placed = placed.crossJoin(F.broadcast(corpus))
    tfn = F.col("_tf") * F.log2(F.lit(1.0) + F.lit(float(c)) * F.col("_avg") / F.col("_len"))
    placed = placed.withColumn("_tfn", tfn).withColumn("_m", F.col("_occurs") / F.col("_n"))
    score = (F.log2(1 + F.col("_m")) + F.col("_tfn") * F.log2((1 + F.col("_m")) / F.col("_m"))) / (F.col("_tfn") + 1)
    return placed.select(F.col("_r").alias(record), F.col("_t").alias(term), F.col("_tf").alias(tf), score.alias("score"))


def best_term(scores: DataFrame, record: str = "chunk_id", term: str = "term") -> DataFrame:
    """(record, term): the highest score of each record; the first term by code points wins a tie."""
    lead = F.min_by(F.col(term), F.struct((-F.col("score")).alias("s"), F.col(term).alias("t")))
    return scores.groupBy(record).agg(lead.alias(term))
