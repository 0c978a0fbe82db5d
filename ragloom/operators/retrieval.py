"""Retrieval: BM25, TF-IDF, dense, fused and reranked top-k of documents for a set of queries.

documents: doc_id, text and metadata; queries: query_id, text, a stated set that is small beside the documents. Results:
query_id, doc_id, score (rounded to 6 digits), rank from 1. Equal scores rank by doc_id.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.text import content_tokens
from ragloom.operators.embedding import Embedder, HashingEmbedder, embedded
from ragloom.operators.nearest import nearest
from ragloom.operators.vector_index import VectorIndex
from ragloom.sources.shared import scratch, written

Tokens = Callable[[Column], Column]
#: A set of queries is sent to every task if its terms are at most so many rows; beyond that Spark joins by shuffling.
MOST_SENT = 200_000


@dataclass(frozen=True)
class RetrievalSpec:
    """How to retrieve; the values are those that the evaluation runs begin with."""

    method: str = "bm25"
    top_k: int = 5
    k1: float = 1.5
    b: float = 0.75
    alpha: float = 0.5
    rrf_k: int = 60
    fusion: str = "rrf"
    sparse: str = "tfidf"


def _few(rows: DataFrame) -> bool:
    return rows.limit(MOST_SENT + 1).count() <= MOST_SENT


def _sent(rows: DataFrame, few: bool) -> DataFrame:
    """rows as a side of a join: sent to every task if they are few."""
    return F.broadcast(rows) if few else rows


def query_terms(queries: DataFrame, tokens: Tokens = content_tokens) -> DataFrame:
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


#: A term that no text has: each document's row with it tells the length.
_LENGTH = "\x00"


def postings(documents: DataFrame, terms: DataFrame, tokens: Tokens = content_tokens, few: bool = False) -> DataFrame:
    """doc_id, term, tf, length for the wanted terms (column term), and one row a document for the term _LENGTH. Other terms are
    dropped before anything is shuffled."""
    every = documents.select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    every = every.select("doc_id", F.size("tokens").alias("length"), F.explode(F.concat("tokens", F.array(F.lit(_LENGTH)))).alias("term"))
    wanted = terms.select("term").distinct().union(terms.sparkSession.createDataFrame([(_LENGTH,)], "term string"))
    return every.join(_sent(wanted, few), "term").groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best by score, then doc_id, of each query."""
    ranked = scores.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k)


def bm25_scores(documents: DataFrame, queries: DataFrame, spec: RetrievalSpec = RetrievalSpec(), tokens: Tokens = content_tokens) -> DataFrame:
    """query_id, doc_id, score of all documents that share a term with a query; a repeated query term counts again.

    Documents are read and tokenised once: document frequencies, the mean length and the scores all come from one exchange of
    postings, which holds the queries' terms only.
    """
    terms = query_terms(queries, tokens)
    few = _few(terms)  # a look at the queries alone
    found = postings(documents, terms, tokens, few)
    # both counts use tf, so that every use of the postings asks for the same columns and Spark shuffles them once
    stats = found.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.avg("length").alias("mean"))
    own = F.col("term") == _LENGTH
    totals = stats.agg(F.max(F.when(own, F.col("df"))).alias("docs"), F.max(F.when(own, F.col("mean"))).alias("mean_length"))
    idf = stats.join(_sent(terms, few), "term").join(F.broadcast(totals)).select("query_id", "term", "qtf", "mean_length", F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (spec.k1 + 1) / (tf + spec.k1 * (1 - spec.b + spec.b * F.col("length") / F.col("mean_length")))
    # no more rows than the queries have terms
    return found.join(_sent(idf, few), "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def ngrams(tokens: Tokens, most: int) -> Tokens:
    """Tokens and the runs of up to `most` of them, joined by blanks."""

    def of(text: Column) -> Column:
        def of_length(t: Column, n: int) -> Column:
            found = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, F.lit(n)), " "))
            return F.when(F.size(t) >= n, found).otherwise(F.array().cast("array<string>"))

        def runs(t: Column) -> Column:
            return F.concat(t, *(of_length(t, n) for n in range(2, most + 1)))

        return F.element_at(F.transform(F.array(tokens(text)), runs), 1)

    return of


def vocabulary(documents: DataFrame, most_terms: int, tokens: Tokens = content_tokens, most: int = 1) -> DataFrame:
    """term, no: the most_terms that occur most often in documents, then by name, among tokens and runs of up to `most` of them; as a stored table.

    A run occurs no more often than any of its tokens, so runs are counted only where each token occurs as often as the last of the most_terms most frequent
    tokens: no other run can be in the vocabulary. Where there are fewer tokens, all runs are counted. Tokens are without blanks.
    """
    found = documents.select(tokens(F.col("text")).alias("t"))
    cut = lambda rows: rows.orderBy(F.desc("cf"), "term").limit(most_terms)
    with scratch(documents.sparkSession, "vocabulary-counts") as place:
        every = written(found.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("cf")), "counts", place)
        n, least = cut(every).agg(F.count("*"), F.min("cf")).first()
        least = least if n == most_terms else 0
        counted = every.where(F.col("cf") >= least)
        few = _few(counted)
        parts = [counted]
        for n in range(2, most + 1):
            of = lambda i: F.struct(*(F.get("t", i + j).alias(f"_{j}") for j in range(n)))  # noqa: B023, E731
            runs = found.where(F.size("t") >= n).select(F.inline(F.transform(F.sequence(F.lit(0), F.size("t") - n), of)))
            for j in range(n):
                runs = runs.join(_sent(counted.select(F.col("term").alias(f"_{j}")), few), f"_{j}", "left_semi")
            own = runs.groupBy(*(f"_{j}" for j in range(n))).agg(F.count("*").alias("cf"))
            parts.append(own.where(F.col("cf") >= least).select(F.concat_ws(" ", *(f"_{j}" for j in range(n))).alias("term"), "cf"))
        return written(cut(reduce(DataFrame.unionByName, parts)).select("term", F.monotonically_increasing_id().alias("no")), "vocabulary")


def tfidf_scores(documents: DataFrame, queries: DataFrame, tokens: Tokens = content_tokens, most_terms: int | None = None, most: int = 1) -> DataFrame:
    """Cosine of tf * (ln((1 + N) / (1 + df)) + 1) vectors of queries and documents, over all terms of the documents: tokens, and runs of up to `most` of them.

    most_terms keeps only the terms that occur most often in the documents, then by name: such a vocabulary is small and sent to all tasks,
    and other terms go before anything is shuffled.
    """
    terms = query_terms(queries, ngrams(tokens, most) if most > 1 else tokens)
    few = _few(terms)
    found = documents.select("doc_id", F.explode((ngrams(tokens, most) if most > 1 else tokens)(F.col("text"))).alias("term"))
    if most_terms:
        known = F.broadcast(vocabulary(documents, most_terms, tokens, most))
        # terms are their numbers from here on
        found = found.join(known, "term").select("doc_id", F.col("no").alias("term"))
        terms = terms.join(known, "term").select("query_id", F.col("no").alias("term"), "qtf")
    counts = found.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    n = documents.agg(F.count("*").alias("docs"))
    stats = counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    idf = stats.join(F.broadcast(n)).select("term", (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    asked = idf.join(_sent(terms, few), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("q"))
    asked = asked.withColumn("q", F.col("q") / F.sqrt(F.sum(F.col("q") * F.col("q")).over(Window.partitionBy("query_id"))))
    by_term = asked.groupBy(F.col("term").alias("of")).agg(F.collect_list(F.struct("query_id", "q")).alias("asks"))
    weights = counts.join(F.broadcast(idf) if most_terms else idf, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    held = weights.join(_sent(by_term, few), F.col("term") == F.col("of"), "left")
    # a document's row: its length, and its terms that a query has
    rows = held.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("asks").isNotNull(), F.struct("w", "asks"))).alias("hits"))
    parts = rows.select("doc_id", "norm", F.explode("hits").alias("h")).select("doc_id", "norm", "h.w", F.explode("h.asks").alias("a"))
    return parts.groupBy("a.query_id", "doc_id").agg((F.sum(F.col("w") * F.col("a.q")) / F.first("norm")).alias("score"))


#: Terms of a bounded vocabulary.
VOCABULARY = 10_000

def dense_top(vectors: DataFrame, queries: DataFrame, k: int, others_only: bool = False) -> DataFrame:
    """Exactly the k nearest (doc_id, vector) of each query (query_id, vector) by cosine: the stated queries against all rows, in blocks.

    others_only leaves out the vector whose doc_id is the query_id. Vectors without length have cosine 0; ids are numbers.
    """
    of = lambda rows, name: rows.select(F.col(name).cast("long").alias(name), F.col("vector").cast("array<double>").alias("vector"))
    return top_k(nearest(of(vectors, "doc_id"), of(queries, "query_id"), k, others_only=others_only), k)


def rrf(dense: DataFrame, sparse: DataFrame, spec: RetrievalSpec = RetrievalSpec()) -> DataFrame:
    """Reciprocal-rank fusion of two ranked legs: alpha / (k + rank) and (1 - alpha) / (k + rank); a missing leg adds nothing."""
    leg = lambda rows, w: rows.select("query_id", "doc_id", (F.lit(w) / (spec.rrf_k + F.col("rank"))).alias("part"))
    return leg(dense, spec.alpha).unionByName(leg(sparse, 1 - spec.alpha)).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def linear_fusion(dense: DataFrame, sparse: DataFrame, spec: RetrievalSpec = RetrievalSpec()) -> DataFrame:
    """Fusion of scores scaled to 0..1 over each leg's rows of a query; a leg whose scores are all alike scales to 1."""
    by = Window.partitionBy("query_id")

    def leg(rows: DataFrame, name: str) -> DataFrame:
        low, high = F.min("score").over(by), F.max("score").over(by)
        return rows.select("query_id", "doc_id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0).alias(name))

    both = leg(dense, "x").join(leg(sparse, "y"), ["query_id", "doc_id"], "full")
    return both.select("query_id", "doc_id", (spec.alpha * F.coalesce("x", F.lit(0.0)) + (1 - spec.alpha) * F.coalesce("y", F.lit(0.0))).alias("score"))


def hybrid(dense: DataFrame, sparse: DataFrame, spec: RetrievalSpec = RetrievalSpec()) -> DataFrame:
    """Top-k of two legs of scores (query_id, doc_id, score), each cut to twice as many first."""
    legs = top_k(dense, 2 * spec.top_k), top_k(sparse.where(F.round("score", 6) > 0), 2 * spec.top_k)
    return top_k((rrf if spec.fusion == "rrf" else linear_fusion)(*legs, spec), spec.top_k)


def lexical_pair_score(query: Column, text: Column) -> Column:
    """An offline stand-in for a pair model: the share of the query's distinct tokens that the text has."""
    asked = F.array_distinct(content_tokens(query))
    return F.coalesce(F.size(F.array_intersect(asked, content_tokens(text))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


class PairScorer(Protocol):
    """A model that reads a query and a text together."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def model_pair_score(model: PairScorer, batch: int = 100) -> Callable[[Column, Column], Column]:
    """The pair score of a model, called in Arrow batches, as rerank() takes it."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for query, text in batches:
            pairs = list(zip(query.fillna(""), text.fillna(""), strict=True))
            yield pd.Series([float(s) for a in range(0, len(pairs), batch) for s in model.score(pairs[a : a + batch])], dtype=float)

    return lambda query, text: run(query, text)


def rerank(candidates: DataFrame, documents: DataFrame, queries: DataFrame, k: int, score: Callable[[Column, Column], Column] = lexical_pair_score, most: int = 100) -> DataFrame:
    """The first `most` candidates (query_id, doc_id, score, rank) of each query by a pair score, then by their rank before:
    original_ and rerank_score, original_ and new_rank. Texts are fetched for candidates only."""
    asked = queries.select("query_id", F.col("text").alias("query"))
    n = queries.count()
    named = candidates.where(F.col("rank") <= most).join(_sent(asked, n <= MOST_SENT), "query_id")
    pairs = documents.select("doc_id", F.col("text").alias("content")).join(_sent(named, n * most <= MOST_SENT), "doc_id")
    scored = pairs.select("query_id", "doc_id", F.col("score").alias("original_score"), F.round(score(F.col("query"), F.col("content")), 6).alias("rerank_score"), F.col("rank").alias("original_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "original_rank")
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def hybrid_reranked(dense: DataFrame, sparse: DataFrame, documents: DataFrame, queries: DataFrame, spec: RetrievalSpec = RetrievalSpec(), candidates: int = 20, score: Callable[[Column, Column], Column] = lexical_pair_score) -> DataFrame:
    """The hybrid's candidates, reranked by a pair score, cut to top-k."""
    return rerank(hybrid(dense, sparse, replace(spec, top_k=candidates)), documents, queries, spec.top_k, score)


def retrieve(documents: DataFrame, queries: DataFrame, spec: RetrievalSpec = RetrievalSpec(), keep: Column | None = None, embedder: Embedder | None = None, score: Callable[[Column, Column], Column] = lexical_pair_score, index: VectorIndex | None = None) -> DataFrame:
    """Top-k by the spec's method: query_id, doc_id, score, rank. keep filters documents by metadata after scoring, so corpus statistics stay whole.

    index, of the embedder's vectors of the documents, is searched in place of all vectors; documents that keep leaves out may then take places of others.

    bm25, tfidf and tfidf_ngram are sparse; dense takes the embedder's vectors; hybrid fuses dense with spec.sparse, and
    hybrid_rerank reranks 20 of these by a pair score, which is then the score.
    """
    sparse = {
        "bm25": lambda: bm25_scores(documents, queries, spec),
        "tfidf": lambda: tfidf_scores(documents, queries),
        "tfidf_ngram": lambda: tfidf_scores(documents, queries, content_tokens, VOCABULARY, 2),
    }
    known = (*sparse, "dense", "hybrid", "hybrid_rerank")
    if spec.method not in known:
        raise ValueError(f"unknown method {spec.method}: choose from {', '.join(known)}")

    def kept(scores: DataFrame) -> DataFrame:
        return scores if keep is None else scores.join(documents.where(keep).select("doc_id"), "doc_id", "left_semi")

    if spec.method in sparse:
        return top_k(kept(sparse[spec.method]()).where(F.round("score", 6) > 0), spec.top_k)
    wanted = spec.top_k if spec.method == "dense" else 2 * spec.top_k if spec.method == "hybrid" else 40
    asked = embedded(queries.select("query_id", "text"), "text", embedder or HashingEmbedder())
    if index is not None:
        near = top_k(kept(index.search(asked, wanted)), wanted)
    else:
        own = documents if keep is None else documents.where(keep)  # vectors have no statistics
        near = dense_top(embedded(own.select("doc_id", "text"), "text", embedder or HashingEmbedder()), asked, wanted)
    if spec.method == "dense":
        return near
    if spec.method == "hybrid":
        return hybrid(near, kept(sparse[spec.sparse]()), spec)
    best = hybrid_reranked(near, kept(sparse[spec.sparse]()), documents, queries, spec, score=score)
    return best.select("query_id", "doc_id", F.col("rerank_score").alias("score"), F.col("new_rank").alias("rank"))


def corpus_statistics(documents: DataFrame, tokens: Tokens = content_tokens) -> DataFrame:
    """What an index holds: documents, tokens, terms and the mean number of tokens."""
    rows = documents.select(tokens(F.coalesce("text", F.lit(""))).alias("t"))
    terms = rows.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_terms"))
    return rows.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("n_tokens"), F.round(F.avg(F.size("t")), 6).alias("mean_tokens")).join(F.broadcast(terms))
