"""Embedders: text to vector. A model is any object with embed(list of texts) -> matrix that can travel to workers."""

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions.text import STOPWORDS


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


_STOP = frozenset(STOPWORDS)
_WORDS = re.compile(r"[^\W_]+").findall


class _Places(dict):
    """Word to bucket of a count, met once: buckets of plus, then of minus, then one for words that don't count."""

    MOST = 500_000

    def __init__(self, dimension: int):
        super().__init__()
        self.dimension = dimension

    def __missing__(self, word: str) -> int:
        at = 2 * self.dimension
        if len(word) > 2 and word.isascii() and word not in _STOP:
            digest = hashlib.md5(word.encode()).hexdigest()
            at = int(digest[:8], 16) % self.dimension + (0 if int(digest[8], 16) < 8 else self.dimension)
        if len(self) > self.MOST:
            self.clear()
        self[word] = at
        return at

    def __reduce__(self):  # it travels empty
        return _Places, (self.dimension,)


class HashingEmbedder:
    """An offline stand-in for a model: content tokens are counted into buckets named by their md5, with a sign, and scaled to length 1."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self.places = _Places(dimension)

    def embed(self, texts: list[str]) -> np.ndarray:
        n, width, words, ends = self.dimension, 2 * self.dimension + 1, [], []
        for text in texts:
            words += map(self.places.__getitem__, _WORDS(text.lower()) if text else ())
            ends.append(len(words))
        rows = np.repeat(np.arange(len(texts)), np.diff(np.array(ends, dtype=np.int64), prepend=0))
        counts = np.bincount(rows * width + np.array(words, dtype=np.int64), minlength=len(texts) * width).reshape(-1, width)
        out = (counts[:, :n] - counts[:, n : 2 * n]).astype(np.float64)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


def embedded(rows: DataFrame, text: str, embedder: Embedder, name: str = "vector", batch: int = 100) -> DataFrame:
    """rows with a vector (array of double) of a text column, computed in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [embedder.embed(texts.iloc[a : a + batch].fillna("").tolist()) for a in range(0, len(texts), batch)]
            yield pd.Series([v for p in parts for v in p])

    return rows.withColumn(name, run(text))


def not_indexed(chunks: DataFrame, index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The chunks that an index does not hold yet."""
    return chunks.join(index.select(key), key, "left_anti")


def index_chunks(chunks: DataFrame, path: str, embedder: Embedder, clear: bool = False, batch: int = 100) -> dict[str, int]:
    """Add the chunks (chunk_id, text and what else they have) that the table of vectors at path lacks; clear begins it anew.

    Returns how many chunks came, how many were there and how many the table has. Chunks with one chunk_id count once.
    """
    spark = chunks.sparkSession
    new, mode = chunks.dropDuplicates(["chunk_id"]), "overwrite"
    if not clear:
        try:
            new, mode = not_indexed(new, spark.read.parquet(path)), "append"
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    before = spark.read.parquet(path).count() if mode == "append" else 0
    embedded(new, "text", embedder, batch=batch).write.mode(mode).parquet(path)
    total = spark.read.parquet(path).count()
    return {"added": total - before, "held_before": before, "total": total}
