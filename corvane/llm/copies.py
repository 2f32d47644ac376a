"""Records that differ only in formatting: collapse them and count their copies."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.skew import hot_threshold, skew_join
from corvane.session import spread, stored

#: Bits of a filter for each hash in it, however many there are, and hash functions of a filter.
BITS_A_RECORD, HASHES = 16, 4
#: Hashes of a slice of the hash range, which one task filters; bytes of filters that are broadcast at a time.
SLICE_HASHES, MOST_FILTER_BYTES = 4_000_000, 32_000_000
#: Distinct hashes a partition collects before it passes them on.
HELD_HASHES = 1_000_000


def letters_and_digits(text: str | None) -> str:
    """The letters and digits of a text, composed and without case; nothing else of it."""
    return "".join(filter(str.isalnum, unicodedata.normalize("NFC", text).casefold())) if text else ""


def _canonical_batch(texts: pd.Series) -> pd.Series:
    return texts.map(letters_and_digits, na_action="ignore").fillna("")


def canonical(column: str) -> Column:
    """letters_and_digits of a column, empty for null."""
    return F.pandas_udf(_canonical_batch, "string")(F.col(column))


def record_key(ordered: Sequence[str] = (), swappable: Sequence[str] = (), exact: Sequence[str] = ()) -> Column:
    """The key under which records count as copies, null where any of the ordered or swappable fields has no letter or digit.

    ordered fields must agree in letters and digits, swappable ones too but in any order, exact ones literally (null equals null).
    """
    free = [canonical(c) for c in ordered]
    loose = [canonical(c) for c in swappable]
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in exact] + free
    if loose:
        parts.append(F.array_join(F.array_sort(F.array(*loose)), "\u0001"))
    blank = F.lit(False)
    for x in free + loose:
        blank = blank | (x == "")
    return F.when(~blank, F.concat_ws("\u0002", *parts))


def _slots(hashes: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    h = hashes.view(np.uint64)
    step = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)) | np.uint64(1)
    last = np.asarray(bits).astype(np.uint64) - np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & last for i in range(HASHES)]).astype(np.int64)


def _has(filter_: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((filter_[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).all(axis=0)


def _add(filter_: np.ndarray, slots: np.ndarray) -> None:
    np.bitwise_or.at(filter_, (slots >> 3).ravel(), (np.uint8(1) << (slots & 7).astype(np.uint8)).ravel())


def _bits(n: int) -> int:
    return max(1 << 10, 1 << (max(n, 1) * BITS_A_RECORD - 1).bit_length())


def _slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each hash: equal ranges, in order."""
    return ((hashes.view(np.uint64) >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _partition_hashes(slices: int):
    """Of each partition, the hashes it saw once and those it saw again, by slice."""

    def pack(once: np.ndarray, again: np.ndarray) -> pd.DataFrame:
        edges = np.arange(slices + 1)  # sorted hashes, so slices are runs
        at, bt = np.searchsorted(_slice_of(once, slices), edges), np.searchsorted(_slice_of(again, slices), edges)
        own = np.flatnonzero((np.diff(at) > 0) | (np.diff(bt) > 0))
        return pd.DataFrame({"slice": own.astype(np.int32), "once": [once[at[k] : at[k + 1]].tobytes() for k in own], "again": [again[bt[k] : bt[k + 1]].tobytes() for k in own]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            held.append(pdf["h"].to_numpy().view(np.uint64))
            size += len(pdf)
            if size >= HELD_HASHES:
                values, counts = np.unique(np.concatenate(held), return_counts=True)
                yield pack(values[counts == 1], values[counts > 1])
                held, size = [], 0
        if size:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            yield pack(values[counts == 1], values[counts > 1])

    return run


def _slice_filter(pdf: pd.DataFrame) -> pd.DataFrame:
    """The filter of a slice's repeated hashes. Each partition's hashes are tested against the filter of all seen before it."""
    parts = [(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(pdf["once"], pdf["again"])]
    bits = _bits(sum(len(a) + len(b) for a, b in parts))
    seen, repeated = np.zeros(bits >> 3, np.uint8), []
    for once, again in parts:
        slots = _slots(once, bits)
        repeated += [once[_has(seen, slots)], again]
        _add(seen, slots)
        _add(seen, _slots(again, bits))
    found = np.unique(np.concatenate(repeated))
    filter_ = np.zeros(_bits(len(found)) >> 3, np.uint8)
    _add(filter_, _slots(found, len(filter_) * 8))
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "size": [len(filter_) if len(found) else 0], "again": [filter_.tobytes() if len(found) else b""]})


def _membership(shared, low: int, slices: int):
    """Whether hashes of the slices from `low` on are in the filters of their slices."""

    def maybe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        flat, bits, starts = shared.value
        for series in batches:
            h = series.to_numpy().view(np.uint64)
            k = _slice_of(h, slices) - low
            out = np.zeros(len(h), bool)
            some = np.flatnonzero(bits[k] > 0)
            out[some] = _has(flat, _slots(h[some], bits[k[some]]) + starts[k[some]])
            yield pd.Series(out)

    return F.pandas_udf(maybe, "boolean")


def possible_repeats(keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(possible repeats, singletons) among the rows of keys (with a long column h): a row is a singleton only if no other row has its h.

    The range of hashes is cut into slices of about SLICE_HASHES. Every partition passes on, by slice, the hashes it saw once
    and those it saw again; a slice's task merges them in a Bloom filter and makes a second filter of the repeated ones.
    Both have BITS_A_RECORD bits a hash whatever n. The second filters meet the rows by broadcasts of at most
    MOST_FILTER_BYTES at a time; where there are more, each broadcast serves a range of hashes of its own.
    """
    spark = keys.sparkSession
    slices = max(1, -(-n // SLICE_HASHES))
    sent = keys.select("h").mapInPandas(_partition_hashes(slices), "slice int, once binary, again binary")
    filters = stored(sent.groupBy("slice").applyInPandas(_slice_filter, "slice int, size long, again binary"))
    rounds, room = [[0, 0]], MOST_FILTER_BYTES
    for r in sorted(filters.select("slice", "size").collect()):  # one number a slice
        if r["size"] > room and rounds[-1][1] > rounds[-1][0]:
            rounds.append([r["slice"], r["slice"]])
            room = MOST_FILTER_BYTES
        room -= r["size"]
        rounds[-1][1] = r["slice"] + 1
    rounds[-1][1] = slices
    for a, b in zip(rounds, rounds[1:]):
        a[1] = b[0]
    marked = None
    for low, high in rounds:
        own = filters.filter((F.col("slice") >= low) & (F.col("slice") < high) & (F.col("size") > 0)) if len(rounds) > 1 else filters.filter("size > 0")
        tables = [(r["slice"], bytes(r["again"])) for r in own.select("slice", "again").collect()]  # at most MOST_FILTER_BYTES
        bits = np.zeros(high - low, np.int64)
        for k, data in tables:
            bits[k - low] = len(data) * 8
        starts = np.concatenate([[0], np.cumsum(bits)[:-1]])
        flat = np.frombuffer(b"".join(d for _, d in sorted(tables)), np.uint8)
        shared = spark.sparkContext.broadcast((flat, bits, starts))

        place = F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * slices, 32)
        part = keys if len(rounds) == 1 else keys.filter((place >= low) & (place < high))
        part = part.withColumn("maybe", _membership(shared, low, slices)(F.col("h")))
        marked = part if marked is None else marked.unionByName(part)
    marked = stored(marked)
    return marked.filter("maybe").drop("maybe"), marked.filter("not maybe").drop("maybe")


def copy_groups(df: DataFrame, id_column: str, key: Column, hot_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(records, members): one row (first_id, copies) for each distinct record, and (first_id, copy_id) for each further copy.

    key is a record's canonical text (see record_key); rows with a null key are never copies and stay records of their own.
    Rows repeated under the same id count as copies but give no member pair with themselves. Only possible repeats, as told by
    merged Bloom filters, are shuffled and grouped by the whole key; all others are emitted as singletons. Popular groups
    are counted by partial aggregates and their members found by broadcast. An empty table gives two empty results.
    """
    rows = stored(spread(df.select(F.col(id_column).alias("id"), key.alias("key"))).withColumn("h", F.when(F.col("key").isNotNull(), F.xxhash64("key"))))
    keyed = rows.filter("key is not null")
    n = keyed.count()
    repeats, single = possible_repeats(keyed, n)
    candidates = repeats.select("id", "key")
    groups = stored(candidates.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")))
    alone = single.select("id").unionByName(rows.filter("key is null").select("id"))
    records = groups.select("first_id", "copies").unionByName(alone.select(F.col("id").alias("first_id"), F.lit(1).cast("long").alias("copies")))
    several = groups.filter("copies > 1")
    members = skew_join(candidates, several, "key", "copies", F.col("id"), hot_threshold(n, hot_rows))
    return records, members.filter("id <> first_id").select("first_id", F.col("id").alias("copy_id")).distinct()
