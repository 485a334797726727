"""Embedding texts with a pluggable embedder: each distinct text once, known ones from a cache table.

``HashEmbedder`` is a deterministic stand-in (signed feature hashing of words). Defined results: a
null text is embedded as an empty one, whose vector is all zeros; repeated texts cost one call.
"""

from __future__ import annotations

import random
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, ATTEMPTS, DELAY = 32, 3, 0.5


class HashEmbedder:
    """Counts of words, each at a place and with a sign by its checksum, scaled to length 1."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.dim] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _with_retries(embed: Callable[[list[str]], np.ndarray], texts: list[str], delay: float) -> np.ndarray:
    """Tries again after a lost connection or a time-out, each time after twice the wait and up to a tenth of a second by chance."""
    for attempt in range(ATTEMPTS):
        try:
            return embed(texts)
        except (ConnectionError, TimeoutError):
            if attempt == ATTEMPTS - 1:
                raise
            time.sleep(delay * 2**attempt + random.uniform(0, min(0.1, delay)))
    raise AssertionError


def embed(rows: DataFrame, text: str, embedder: Callable[[list[str]], np.ndarray], dim: int, cache: DataFrame | None = None, delay: float = DELAY) -> DataFrame:
    """Adds ``vector``. cache: (text_hash, vector) of texts embedded before."""
    hashed = rows.withColumn("text_hash", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    todo = hashed.groupBy("text_hash").agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    if cache is not None:
        todo = todo.join(cache.select("text_hash"), "text_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), BATCH):
                part = batch.iloc[a : a + BATCH]
                vectors = _with_retries(embedder, part["text"].tolist(), delay)
                if vectors.shape != (len(part), dim):
                    raise ValueError(f"vectors of {vectors.shape[-1]} numbers, not {dim}")
                yield pd.DataFrame({"text_hash": part["text_hash"].tolist(), "vector": list(vectors)})

    known = todo.mapInPandas(run, "text_hash string, vector array<float>")
    if cache is not None:
        known = known.unionByName(cache.select("text_hash", "vector"))
    return hashed.join(known, "text_hash").drop("text_hash")
