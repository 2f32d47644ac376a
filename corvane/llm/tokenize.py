"""Encoding of a corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import spread

#: Fixed value: how byte-level BPE splits text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters encoded at a time, and words kept for reuse by a worker.
CHUNK_CHARS, KEPT_WORDS = 4_000_000, 400_000


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tables(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id of each byte, sorted pair keys, their ranks, ids by rank) of a vocabulary file."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    vocab = model["vocab"]
    names = _byte_names()
    start = np.zeros(256, np.int64)
    for name, byte in names.items():
        start[byte] = vocab[name]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
    ids = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    return start, keys[order], order.astype(np.int64), ids


def merge_words(words: list[bytes], tables) -> list[np.ndarray]:
    """The token ids of each word: in rounds, every word merges all its pairs of the lowest rank, many words at once."""
    start, keys, ranks, ids = tables
    never = len(ranks)
    sizes = np.array([len(w) for w in words], np.int64)
    symbols = start[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    done_symbols, done_owner = [], []
    while len(symbols):
        pair = (symbols[:-1] << 32) | symbols[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        rank = np.where((keys[at] == pair) & (owner[:-1] == owner[1:]), ranks[at], never)
        rank = np.append(rank, never)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        lowest = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(owner))))
        ready = lowest == never
        if ready.any():
            done_symbols.append(symbols[ready])
            done_owner.append(owner[ready])
        hit = np.flatnonzero((rank == lowest) & ~ready)
        if len(hit):
            # where hits overlap, as in a run of one letter, every second one merges
            new_run = np.append(True, np.diff(hit) != 1)
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            symbols[hit] = ids[rank[hit]]
            ready[hit + 1] = True
        symbols, owner = symbols[~ready], owner[~ready]
    flat = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
    who = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
    flat = flat[np.argsort(who, kind="stable")].astype(np.int32)
    return np.split(flat, np.cumsum(np.bincount(who, minlength=len(words)))[:-1]) if words else []


class Encoder:
    """Encodes texts with one set of tables; keeps the ids of words it met."""

    def __init__(self, tables) -> None:
        self.tables, self.pattern, self.kept = tables, regex.compile(SPLIT), {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        pieces = [self.pattern.findall(t) if t else [] for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept = {}
        new = list({w for p in pieces for w in p if w not in self.kept})
        self.kept.update(zip(new, merge_words([w.encode("utf-8") for w in new], self.tables)))
        return [np.concatenate([self.kept[w] for w in p]) if p else np.zeros(0, np.int32) for p in pieces]


def encode_texts(df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every row's text, without special tokens.

    Null and empty texts give an empty list; a text of only white space is encoded like any other; strings that look like a
    special token are ordinary text. Repeated rows are each encoded. Other columns are ignored. The tables of the vocabulary
    file, read once by the driver, are of fixed size and broadcast. No shuffle beyond spreading a table of too few splits.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_tables(vocabulary))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for pdf in batches:
            texts = [None if x is None else x for x in pdf["text"]]
            at, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= CHUNK_CHARS or i == len(texts) - 1:
                    yield pd.DataFrame({"id": pdf["id"].iloc[at : i + 1].to_numpy(), "ids": encoder.encode(texts[at : i + 1])})
                    at, size = i + 1, 0

    rows = spread(df.select(F.col(id_column).alias("id"), F.col(text).alias("text")))
    kind = df.schema[id_column].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)
