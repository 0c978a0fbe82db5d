"""Chunking: documents (doc_id, text) to chunks, by whole document, sentence windows or meaning."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.text import plain_sentence, sentence_pieces, sentences
from ragloom.operators.embedding import Embedder, HashingEmbedder
from ragloom.operators.ordering import running_before

#: Groups whose sizes are sent to every task; of more they are joined in a shuffle.
MOST_GROUPS = 200_000
#: Sentences that an embedder gets at once, and those of the last document among them.
SENTENCES = 1_000


def _chunks(docs: DataFrame, bounds: Column, strategy: str) -> DataFrame:
    """bounds: array of struct(first, last) sentence numbers, of the column `parts`; null or empty for a document without sentences.

    A chunk's text is put together before rows are made of chunks, so that no chunk's row holds its document's other sentences; and from single
    sentences, as a slice of an array goes over all of it.
    """
    text = lambda b: F.array_join(F.transform(F.sequence(b["first"], b["last"]), lambda i: F.get("parts", i)), " ")
    made = F.transform("bounds", lambda b: F.struct(text(b).alias("text"), b["first"].alias("first"), b["last"].alias("last")))
    rows = docs.select("doc_id", "parts", bounds.alias("bounds")).select("doc_id", F.posexplode(made).alias("chunk_id", "c"))
    return rows.select("doc_id", "chunk_id", "c.text", F.col("c.first").alias("start_sentence"), F.col("c.last").alias("end_sentence"), (F.col("c.last") - F.col("c.first") + 1).alias("num_sentences"), F.lit(strategy).alias("strategy"))


def no_chunks(docs: DataFrame) -> DataFrame:
    """Every document that isn't blank as one chunk."""
    return docs.where(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "") != "").select("doc_id", F.lit(0).alias("chunk_id"), "text", F.lit("none").alias("strategy"))


def sentence_chunks(docs: DataFrame, size: int = 5, overlap: int = 2) -> DataFrame:
    """Windows of `size` sentences that begin size - overlap (at least one) apart; the first to reach the end is the last."""
    step = max(1, size - overlap)
    n = F.size("parts")
    windows = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    bounds = F.transform(F.sequence(F.lit(0), windows - 1), lambda k: F.struct((k * step).alias("first"), (F.least(k * step + size, n) - 1).alias("last")))
    return _chunks(docs.select("doc_id", sentences(F.col("text")).alias("parts")), F.when(n > 0, bounds), "sentence")


def corpus_chunks(docs: DataFrame, by: str = "example_id", size: int = 5, overlap: int = 2) -> DataFrame:
    """Windows of sentences over the joined texts of each group: `by`, chunk_id, text, start_sentence, end_sentence, num_sentences, strategy.

    The texts of a group (by, doc_id: a number, unique in the group, text) are joined by empty lines in order of doc_id, as if they were one document;
    a sentence that no document's end closes goes on in the next. No row holds a group: a piece's sentence is its place in its document after the sum of
    the ends before it, and each window is put together from its pieces. Null texts are empty; a group without sentences has no windows.
    """
    step = max(1, size - overlap)
    rows = docs.select(by, "doc_id", sentence_pieces(F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"))).alias("pieces"))
    # every piece but the last of a document ends a sentence
    rows = running_before(rows.withColumn("ends", F.size("pieces").cast("long") - 1), [by], "doc_id", "ends", "ahead")
    pieces = rows.select(by, "doc_id", "ahead", F.posexplode("pieces").alias("at", "piece")).select(by, "doc_id", (F.col("ahead") + F.col("at")).alias("sentence"), "piece")
    counts = pieces.where(F.length(plain_sentence(F.col("piece"))) > 0).groupBy(F.col(by).alias("_by")).agg((F.max("sentence") + 1).alias("n"))
    told = pieces.join(F.broadcast(counts) if counts.count() <= MOST_GROUPS else counts, F.col(by).eqNullSafe(F.col("_by"))).where(F.col("sentence") < F.col("n"))
    last = F.when(F.col("n") <= size, F.lit(0)).otherwise(F.ceil((F.col("n") - size) / step)).cast("long")
    first = F.greatest(F.lit(0), F.ceil((F.col("sentence") - size + 1) / step)).cast("long")
    windows = F.sequence(F.least(first, last), F.least(F.floor(F.col("sentence") / step).cast("long"), last))
    windows = F.filter(windows, lambda k: (k * step <= F.col("sentence")) & (F.col("sentence") < k * step + size))
    held = told.select(by, "n", "sentence", "doc_id", "piece", F.explode(windows).alias("chunk_id"))
    parts = held.groupBy(by, "chunk_id").agg(F.array_sort(F.collect_list(F.struct("sentence", "doc_id", "piece"))).alias("p"), F.min("sentence").alias("start_sentence"), F.max("sentence").alias("end_sentence"))
    whole = F.transform(
        F.sequence("start_sentence", "end_sentence"),
        lambda i: plain_sentence(F.array_join(F.transform(F.filter("p", lambda x: x["sentence"] == i), lambda x: x["piece"]), "")),
    )
    return parts.select(by, "chunk_id", F.array_join(whole, " ").alias("text"), "start_sentence", "end_sentence", (F.col("end_sentence") - F.col("start_sentence") + 1).alias("num_sentences"), F.lit("sentence").alias("strategy"))


def similarities(vectors: np.ndarray) -> np.ndarray:
    """Cosines of neighbouring rows; 0 where a row has no length."""
    norms = np.linalg.norm(vectors, axis=1)
    size = norms[1:] * norms[:-1]
    return np.divide((vectors[1:] * vectors[:-1]).sum(axis=1), size, out=np.zeros(len(size)), where=size > 0)


def greedy_bounds(sims: np.ndarray, threshold: float, least: int, most: int) -> list[tuple[int, int]]:
    """Cuts after sentence i once i - start + 2 reaches `most`, or reaches `least` while the next sentence is less alike than threshold.

    So a chunk has most - 1 sentences at the most, and `least` of 2 lets single sentences stand.
    """
    out, start = [], 0
    for i, s in enumerate(sims.tolist()):
        length = i - start + 2
        if length >= most or (length >= least and s < threshold):
            out.append((start, i))
            start = i + 1
    return [*out, (start, len(sims))]


def semantic_chunks(docs: DataFrame, embedder: Embedder | None = None, threshold: float = 0.5, least: int = 2, most: int = 10) -> DataFrame:
    """Runs of sentences cut where neighbours are less alike than threshold; texts of up to `least` sentences are one chunk."""
    embedder = embedder or HashingEmbedder()

    def cuts(parts: list[list[str]]) -> Iterator[list[dict[str, int]]]:
        vectors = embedder.embed([s for p in parts for s in p])
        ends = np.cumsum([len(p) for p in parts])
        for p, end in zip(parts, ends, strict=True):
            own = vectors[end - len(p) : end]
            found = greedy_bounds(np.round(similarities(own), 6), threshold, least, most) if len(p) > least else [(0, len(p) - 1)]
            yield [{"first": a, "last": b} for a, b in found if len(p)]

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def bounds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out, held, n = [], [], 0
            for p in rows:
                held.append([] if p is None else list(p))
                n += len(held[-1])
                if n >= SENTENCES:
                    out += cuts(held)
                    held, n = [], 0
            yield pd.Series([*out, *cuts(held)] if held else out)

    return _chunks(docs.select("doc_id", sentences(F.col("text")).alias("parts")), bounds("parts"), "semantic")


def numbered(chunks: DataFrame, example: str, order: tuple[str, ...] = ("doc_id", "chunk_id")) -> DataFrame:
    """chunks with global_chunk_id, dense from 0 within each example."""
    return chunks.withColumn("global_chunk_id", F.row_number().over(Window.partitionBy(example).orderBy(*order)) - 1)


def chunk_examples(examples: DataFrame, strategy: str = "sentence", **options) -> DataFrame:
    """Chunks of examples (example_id, documents: array of texts): example_id, doc_idx, chunk_id, global_chunk_id, text, strategy.

    Blank documents give no chunks, but doc_idx counts them. An example is one row, and its chunks are numbered in one task.
    """
    cut = {"none": no_chunks, "sentence": sentence_chunks, "semantic": semantic_chunks}
    if strategy not in cut:
        raise ValueError(f"unknown strategy {strategy}: choose from {', '.join(cut)}")
    rows = examples.select("example_id", F.posexplode("documents").alias("doc_idx", "text"))
    rows = rows.where(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "") != "").select(F.struct("example_id", "doc_idx").alias("doc_id"), "text")
    chunks = cut[strategy](rows, **options).select("doc_id.example_id", "doc_id.doc_idx", "chunk_id", "text", "strategy")
    return numbered(chunks, "example_id", ("doc_idx", "chunk_id"))


def chunk_key(text: Column, doc_id: Column, at: Column) -> Column:
    """The first 16 hex digits of the md5 of doc, number and content."""
    return F.substring(F.md5(F.concat_ws("_", doc_id.cast("string"), at.cast("string"), text)), 1, 16)
