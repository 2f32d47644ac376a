"""Evaluation texts that leak into training text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import spread

#: BM25 parameters; postings per block of the index.
K1, B, BLOCK = 1.2, 0.75, 32
#: Bytes of item texts in one index, which is what is broadcast; indexes a worker holds in one pass over the documents.
INDEX_BYTES, INDEXES_AT_ONCE = 16_000_000, 4
#: Characters of documents and passages searched at a time; runs of items whose thresholds are found at a time.
CHUNK_CHARS, CHUNK_PASSAGES, CHUNK_RUNS = 4_000_000, 4096, 200_000
WORD = re.compile(r"[^\W_]+")
IGNORED = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, without case and marks."""
    if not text.isascii():
        text = IGNORED.sub("", unicodedata.normalize("NFKD", text))
    return WORD.findall(text.casefold())


def _run_hashes(tokens: np.ndarray, least: int) -> np.ndarray:
    """A hash of the `least` tokens from each place on."""
    h = np.zeros(max(0, len(tokens) - least + 1), np.uint64)
    for k in range(least):
        h = h * PRIME + tokens[k : k + len(h)].astype(np.uint64)
    return h


class ItemIndex:
    """An inverted index of test items with BM25 weights in flat arrays, in blocks with their maxima.

    Weights are divided by the item's threshold: the lowest score that `least` consecutive words of it can reach. So a passage
    that holds such words scores at least 1, and all items from 1 on are retrieved; none that leaked can be missed.
    """

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        kept = [(i, w) for i, t in sorted(items) if len(w := words_of(t)) >= least]
        self.least, self.ids = least, [i for i, _ in kept]
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.tokens = np.array([number(x, len(self.vocabulary)) for _, w in kept for x in w], np.int32)
        sizes = np.array([len(w) for _, w in kept], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n, terms = len(kept), len(self.vocabulary)
        if not n:
            return
        owner = np.repeat(np.arange(n), sizes)
        pairs, back, tf = np.unique(owner * terms + self.tokens, return_inverse=True, return_counts=True)
        item, term = pairs // terms, pairs % terms
        df = np.bincount(term, minlength=terms)
        idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
        weight = idf[term] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * sizes / sizes.mean()))[item])
        threshold = self._thresholds(weight[back], owner, n)
        order = np.lexsort((item, term))
        self.where, self.weight = item[order].astype(np.int32), (weight / threshold[item])[order]
        self.first = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        self.most = np.maximum.reduceat(self.weight, self.first[:-1])
        blocks = -(-df // BLOCK)
        start = np.repeat(self.first[:-1], blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        end = np.minimum(start + BLOCK, np.repeat(self.first[1:], blocks))
        self.block_most, self.block_first, self.block_last = np.maximum.reduceat(self.weight, start), self.where[start], self.where[end - 1]
        # terms and items in one number, to find any term's next posting or block by one search
        self.block_term = np.repeat(np.arange(terms), blocks)
        self.post_key, self.block_key = np.repeat(np.arange(terms), df) * (n + 1) + self.where, self.block_term * (n + 1) + self.block_last
        self.run_at = np.flatnonzero(np.arange(len(owner)) + least <= self.offsets[1:][owner])
        self.run_item = owner[self.run_at]
        key = _run_hashes(self.tokens, least)[self.run_at] ^ (self.run_item.astype(np.uint64) * PRIME)
        order = np.argsort(key, kind="stable")
        self.run_key, self.run_at, self.run_item = key[order], self.run_at[order], self.run_item[order]

    def _thresholds(self, weight: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """For each item the lowest sum of weights that `least` consecutive words of it have, repeated words counted once."""
        starts = np.flatnonzero(np.arange(len(owner)) + self.least <= self.offsets[1:][owner])
        out = np.full(n, np.inf)
        for a in range(0, len(starts), CHUNK_RUNS):
            at = starts[a : a + CHUNK_RUNS, None] + np.arange(self.least)
            order = np.argsort(self.tokens[at], axis=1, kind="stable")
            token, w = np.take_along_axis(self.tokens[at], order, 1), np.take_along_axis(weight[at], order, 1)
            w[:, 1:][token[:, 1:] == token[:, :-1]] = 0
            np.minimum.at(out, owner[at[:, 0]], w.sum(1))
        return out

    def retrieve(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place of the item) of all items that score at least 1 for the distinct terms of a row of terms (-1: none), by
        block-max WAND: every row has a cursor for each term, and all rows take their next step together."""
        none, goal, n = len(self.ids), 1.0 - 1e-9, len(self.ids) + 1
        row = np.arange(len(terms))
        t = np.where(terms < 0, 0, terms).astype(np.int64)
        cur = np.where(terms < 0, -1, self.first[t])
        item = np.where(terms < 0, none, self.where[cur])
        rows, places = [], []
        while True:
            order = np.argsort(item, axis=1, kind="stable")
            t, cur, item = (np.take_along_axis(x, order, 1) for x in (t, cur, item))
            bound = np.cumsum(np.where(item < none, self.most[t], 0.0), axis=1)
            alive = bound[:, -1] >= goal
            if not alive.all():
                row, t, cur, item, bound = (x[alive] for x in (row, t, cur, item, bound))
            if not len(row):
                return (np.concatenate(rows), np.concatenate(places)) if rows else (np.zeros(0, np.int64),) * 2
            pivot = np.take_along_axis(item, (bound >= goal).argmax(axis=1)[:, None], 1)
            near = item <= pivot
            block = np.minimum(np.searchsorted(self.block_key, t * n + pivot), len(self.block_key) - 1)
            inside = (self.block_term[block] == t) & (self.block_last[block] >= pivot)
            holds = inside & (self.block_first[block] <= pivot)
            reach = np.where(near & holds, self.block_most[block], 0.0).sum(axis=1) >= goal
            leave = np.where(near & inside, np.where(holds, self.block_last[block] + 1, self.block_first[block]), none).min(axis=1)
            following = np.where(near, none, item).min(axis=1)
            at = pivot[:, 0]
            to = np.minimum(np.maximum(leave, at + 1), np.maximum(following, at + 1))  # no item in these blocks can reach the threshold
            level = item[:, 0] == at
            hit = np.flatnonzero(reach & level)
            if len(hit):
                score = np.where(item[hit] == pivot[hit], self.weight[cur[hit]], 0.0).sum(axis=1)
                good = hit[score >= goal]
                rows.append(row[good])
                places.append(at[good])
            to = np.where(reach, np.where(level, at + 1, at), to)
            move = near & (item < to[:, None])
            r, c = np.nonzero(move)
            term = t[r, c]
            new = np.searchsorted(self.post_key, term * n + to[r])
            cur[r, c] = new
            item[r, c] = np.where(new < self.first[term + 1], self.where[np.minimum(new, len(self.where) - 1)], none)

    def leaked(self, texts: list[list[str]]) -> set[tuple[int, int]]:
        """(place of the text, item id): the items of which a text, given as its words, holds `least` consecutive words.

        The texts are cut into passages of 2 * least words, each starting `least` words after the last, so that every run of
        `least` words lies in a passage. Not looked up are passages without a run of words that all occur in items, and those
        whose terms can't reach the threshold even together.
        """
        step = self.least
        if not self.ids:
            return set()
        sizes = np.array([len(w) + 1 for w in texts], np.int64)
        flat = (x for w in texts for x in (*w, None))  # no run goes on over the end of a text
        t = np.fromiter(map(self.vocabulary.get, flat, repeat(-1)), np.int32, int(sizes.sum()))
        n = len(t)
        if n <= step:
            return set()
        count = np.concatenate([[0], np.cumsum(t >= 0)])
        known = count[step:] - count[:-step] == step
        runs = np.concatenate([[0], np.cumsum(known)])
        sums = np.concatenate([[0.0], np.cumsum(np.append(self.most, 0.0)[t])])
        starts = np.arange(0, n - step + 1, step)
        likely = runs[np.minimum(starts + step + 1, len(known))] > runs[starts]
        likely &= sums[np.minimum(starts + 2 * step, n)] - sums[starts] >= 1.0 - 1e-6
        hashes = _run_hashes(t, step)
        ends = np.cumsum(sizes)
        found: set[tuple[int, int]] = set()
        starts = starts[likely]
        for a in range(0, len(starts), CHUNK_PASSAGES):
            begin = starts[a : a + CHUNK_PASSAGES]
            terms = np.sort(np.append(t, np.full(2 * step, -1, np.int32))[begin[:, None] + np.arange(2 * step)], axis=1)
            terms[:, 1:][terms[:, 1:] == terms[:, :-1]] = -1
            passage, at = self.retrieve(terms)
            place = begin[passage][:, None] + np.arange(step + 1)
            whole = known[np.minimum(place, len(known) - 1)] & (place < len(known))
            at, place = np.broadcast_to(at[:, None], place.shape)[whole], place[whole]
            key = hashes[place] ^ (at.astype(np.uint64) * PRIME)
            run = np.searchsorted(self.run_key, key)
            while len(run):  # keys are hashes: runs with the key are compared word by word
                same = run < len(self.run_key)
                same[same] = self.run_key[run[same]] == key[same]
                run, key, at, place = run[same], key[same], at[same], place[same]
                equal = (self.tokens[self.run_at[run][:, None] + np.arange(step)] == t[place[:, None] + np.arange(step)]).all(axis=1) & (self.run_item[run] == at)
                found |= set(zip(np.searchsorted(ends, place[equal], side="right").tolist(), [self.ids[k] for k in at[equal]]))
                run, key, at, place = run[~equal] + 1, key[~equal], at[~equal], place[~equal]
        return found


def leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 12) -> DataFrame:
    """(id, item id): which items leaked into which documents, each pair once.

    A document counts if it holds `least` consecutive words of the item; words are runs of letters and digits, without case
    and marks. Items under `least` words, null ids and null texts make no case; an item id with several texts counts with each.
    The items are the stated query set: they are indexed in parts of about INDEX_BYTES of text, so what is broadcast is bounded.
    Every document is searched whole, in one narrow pass for each INDEXES_AT_ONCE such parts.
    """
    spark = documents.sparkSession
    known = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").distinct()
    size = known.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    parts = max(1, math.ceil(size / INDEX_BYTES))
    kinds = documents.schema[id_column].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    rows = spread(documents.select(F.col(id_column).alias("d"), F.col(text).alias("t")).filter("d is not null and t is not null"))
    indexes = []
    for b in range(parts):
        part = known.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == b)
        indexes.append(spark.sparkContext.broadcast(ItemIndex([(r["i"], r["t"]) for r in part.toLocalIterator()], least)))
    out = None
    for a in range(0, parts, INDEXES_AT_ONCE):

        def run(batches: Iterator[pd.DataFrame], shared=indexes[a : a + INDEXES_AT_ONCE]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids, at = pdf["d"].tolist(), 0
                while at < len(ids):
                    texts, size = [], 0
                    for t in pdf["t"].iloc[at:]:
                        texts.append(words_of(t))
                        size += len(t)
                        if size >= CHUNK_CHARS:
                            break
                    hits = [(ids[at + k], i) for index in shared for k, i in index.value.leaked(texts)]
                    yield pd.DataFrame(hits, columns=["d", "i"])
                    at += len(texts)

        found = rows.mapInPandas(run, f"d {kinds[0]}, i {kinds[1]}")
        out = found if out is None else out.unionByName(found)
    return out.distinct().select(F.col("d").alias(id_column), F.col("i").alias(item_id))
