"""Importance resampling towards a target: documents whose hashed features are likelier among target texts are drawn with a higher chance.

Features are runs of 1 to n words, hashed into buckets by crc32. A bucket's gain is the scaled logarithm of its share
among the target's features over its share among the documents'; a document's weight is the mean gain of its features.
Adding Gumbel noise from a digest of doc_id and taking the highest scores draws without replacement, by chances in
proportion to exp(weight / SCALE), and every run draws the same.

CRCs of many features at a time: the distinct features of a block of texts are grouped by length, each group is a matrix
of bytes, and the CRCs of its rows advance together column by column; the buckets are then scattered back to all
occurrences.
"""

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.store import materialise
from ragloom.llm.wordhash import chunks, encode, mix

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 2024, 10, 20
#: Gains and noise are whole numbers of so many to the natural logarithm's unit.
SCALE = 1000
#: Features of more bytes are too few of one length for a matrix and are read one by one.
LONG = 256
#: Fixed: the polynomial of crc32, bits reversed.
POLYNOMIAL = 0xEDB88320
_FEATURES = "doc_id long, body long, n_words long, n_features long, weight long"


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> 1) ^ np.where(crc & 1, np.uint32(POLYNOMIAL), np.uint32(0))
    return crc


_CRC = _crc_table()
#: Bytes that words consist of: digits, small letters and all of characters beyond ASCII.
_INSIDE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def crc_rows(rows: np.ndarray) -> np.ndarray:
    """crc32 of each row of a matrix of bytes."""
    crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
    for column in rows.T:
        crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return ~crc


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of one row of each kind, and for every row which of these it equals."""
    packed = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    packed[:, : rows.shape[1]] = rows
    packed = packed.view(np.uint64)
    key = packed[:, 0]
    for column in packed.T[1:]:
        key = mix(key) + column
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    if packed.shape[1] > 1 and not (packed == packed[first[which]]).all():  # two kinds with one key
        _, first, which = np.unique(packed, axis=0, return_index=True, return_inverse=True)
    return first, which.reshape(-1)


def crcs(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of the bytes between each start and end."""
    size, out = end - start, np.zeros(len(start), dtype=np.uint32)
    if not len(size):
        return out
    order = np.argsort(size, kind="stable")
    lengths, at = np.unique(size[order], return_index=True)
    for length, own in zip(lengths.tolist(), np.split(order, at[1:]), strict=True):
        if length > LONG:
            out[own] = [crc32(buf[x : x + length]) for x in start[own].tolist()]
        elif length:
            rows = buf[start[own][:, None] + np.arange(length)]
            first, which = distinct_rows(rows)
            out[own] = crc_rows(rows[first])[which]
    return out


def features(parts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """crc32 of all features of some texts in lower case, text by text; where each text's begin (one more at the end); each text's words."""
    buf = np.frombuffer(b" ".join([b"", *parts, b""]), dtype=np.uint8)
    inside = _INSIDE[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    word_at = np.searchsorted(start, np.cumsum([1] + [len(p) + 1 for p in parts]))
    words = np.diff(word_at)
    if n == 1:
        return crcs(buf, start, end), word_at, words
    # words side by side with one blank between, so that a run of words is a run of bytes
    size = end - start + 1
    new = np.cumsum(size) - size
    joined = buf[np.repeat(start - new, size) + np.arange(size.sum())]
    joined[new + size - 1] = 32
    owner = np.repeat(np.arange(len(parts)), words)
    found, of = [], []
    for k in range(n):
        last = np.arange(k, len(start))
        last = last[owner[last] == owner[last - k]]
        found.append(crcs(joined, new[last - k], (new + size - 1)[last]))
        of.append(owner[last])
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return np.concatenate(found)[order], np.searchsorted(of_all[order], np.arange(len(parts) + 1)), words


def _lowered(texts: pd.Series) -> list[bytes]:
    return [encode(t).lower() for t in texts]  # bytes know A-Z alone


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the texts (a column text; null: none) each bucket holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            parts = _lowered(batch["text"])
            for a, b in chunks(parts):
                held += np.bincount(features(parts[a:b], n)[0] % buckets, minlength=buckets)
        at = np.flatnonzero(held)
        yield pd.DataFrame({"bucket": at, "n": held[at]})

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, dtype=np.int64)
    out[rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, of counts among the documents and among the target's texts."""
    s, t, k = float(own.sum()), float(target.sum()), len(own)
    return np.array([math.floor(SCALE * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(own.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, n: int = 1) -> DataFrame:
    """doc_id, body (a hash of the text), n_words, n_features and weight of every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = _lowered(batch["text"])
            for a, b in chunks(parts):
                crc, at, words = features(parts[a:b], n)
                sums = np.r_[0, np.cumsum(gain[crc % len(gain)])]
                size = np.diff(at)
                weight = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(size, 1)
                yield batch[["doc_id", "body"]].iloc[a:b].assign(n_words=words, n_features=size, weight=weight)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, _FEATURES)


def noise(doc_id: F.Column, seed: int) -> F.Column:
    """Gumbel noise of a document, from a digest of seed and doc_id; a null doc_id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: 1, 2, 3... of the drawn percent of rows that have least_words or more, else null.

    Scores are whole numbers of a bounded range, so that how many rows each has is a small table; it gives the lowest
    score drawn and each score's first rank. Rows of equal score are ranked by doc_id, null last, in a window for each score.
    """
    able = scored.where(F.col("n_words") >= least_words)
    counts = sorted(able.groupBy("score").count().collect(), reverse=True)
    draw, offsets, above = percent * sum(n for _, n in counts) // 100, [], 0
    for score, n in counts:
        if above >= draw:
            break
        offsets.append((score, above))
        above += n
    spark = scored.sparkSession
    first = F.broadcast(spark.createDataFrame(offsets, "score long, _first long"))
    placed = able.join(first, "score").withColumn("rank", F.col("_first") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"))))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    least = offsets[-1][0] if offsets else None
    rest = scored.where((F.col("n_words") < least_words) | (F.lit(True) if least is None else F.col("score") < least))
    return placed.select(*scored.columns, "rank").unionByName(rest.select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def scores(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each row of docs: doc_id, body (a hash of the text), n_words, n_features, weight, score, rank (null: not drawn).

    docs needs doc_id and text, target text; other columns are ignored. Words are runs of digits, letters a to z and
    characters beyond ASCII, after A-Z became small; features are runs of 1 to n words, repeats counted. Null and empty
    texts have none and weigh 0. Each row is a document of its own: repeated rows count each time and are drawn by equal scores; ties go
    to the smaller doc_id, null last. Without documents the result is empty; a target without words leaves gains
    to the documents' own counts.
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    scored = weights(docs, gain, n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(materialise(scored, "importance"), percent, least_words)


def resample(docs: DataFrame, target: DataFrame, rank: str = "rank", **options) -> DataFrame:
    """The rows of docs that scores() draws, as they are, with a column of that name for their rank; repeated rows are drawn by their ranks each."""
    drawn = scores(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn_id"), F.col("body").alias("_drawn_body"), F.col("rank").alias("_drawn_rank"))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    at = {c: F.col(x) for c, x in zip(docs.columns, names, strict=True)}
    # repeated rows are counted off, so that each meets one rank
    again = lambda key, by: F.row_number().over(Window.partitionBy(*key).orderBy(by))
    own = own.withColumn("_id", at["doc_id"].cast("long")).withColumn("_body", F.xxhash64(at["text"]))
    own = own.join(drawn.select("_drawn_id", "_drawn_body").distinct(), F.col("_id").eqNullSafe(F.col("_drawn_id")) & F.col("_body").eqNullSafe(F.col("_drawn_body")), "left_semi")
    own = own.withColumn("_nth", again(("_id", "_body"), F.lit(0)))
    drawn = drawn.withColumn("_drawn_nth", again(("_drawn_id", "_drawn_body"), F.col("_drawn_rank")))
    met = own.join(drawn, F.col("_id").eqNullSafe(F.col("_drawn_id")) & F.col("_body").eqNullSafe(F.col("_drawn_body")) & (F.col("_nth") == F.col("_drawn_nth")))
    return met.select(*(F.col(x).alias(c) for c, x in zip(docs.columns, names, strict=True)), F.col("_drawn_rank").alias(rank))
