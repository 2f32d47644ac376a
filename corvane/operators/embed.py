"""Turning texts into vectors: an interface, and an embedder that needs no model."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import spread

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Signed feature hashing of words, damped by log counts, scaled to length 1; an empty text gives zeros."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts):
            counts: dict[str, int] = {}
            for w in re.findall(r"[^\W_]+", text.casefold()):
                counts[w] = counts.get(w, 0) + 1
            for w, n in counts.items():
                h = xxhash.xxh64_intdigest(w)
                row[h % dim] += (1 if h >> 63 else -1) * (1 + math.log(n))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors of texts from a model's token vectors (texts, tokens, size) and its mask: the mean of the tokens that count."""
    weight = mask[:, :, None].astype(np.float32)
    mean = (tokens * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


def embed_texts(df: DataFrame, id_column: str, text: Column | str, make: Callable[[], Embedder] = hashing_embedder, batch: int = 32) -> DataFrame:
    """(id, embedding) of every row, null texts as empty ones. make is called once in each worker, so a model is loaded once."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": list(embed([t or "" for t in part["text"]]))})

    rows = df.select(F.col(id_column).alias("id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    return spread(rows).mapInPandas(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_column)


def pair_text(question: str = "question", answer: str = "answer") -> Column:
    return F.concat(F.lit("Q: "), question, F.lit(" A: "), answer)


def claim_text() -> Column:
    return F.concat_ws(" ", "subject", "predicate", "object", "evidence")
