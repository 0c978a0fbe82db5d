"""The nearest vectors of a stated set of queries, within groups of both: matrix products of blocks, on as many tasks as there are rows for."""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Queries that are sent to every task; more of them meet the vectors in a shuffle.
MOST_QUERIES = 5_000
#: Vectors and queries of one block of that shuffle.
VECTORS_A_BLOCK, QUERIES_A_BLOCK = 8_192, 4_096
#: Groups whose sizes are sent to every task.
MOST_GROUPS = 200_000


def scaled(rows: list) -> np.ndarray:
    """Vectors as rows of length 1; those without length stay zero."""
    if not len(rows):
        return np.zeros((0, 0))
    x = np.stack(rows).astype(np.float64)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _best(ids: np.ndarray, own: np.ndarray, names: np.ndarray, matrix: np.ndarray, k: int, others_only: bool) -> pd.DataFrame:
    """The k best of the vectors (ids ascending) for every query."""
    scores = np.round(matrix @ own.T, 6) + 0.0
    if others_only:
        scores[names[:, None] == ids[None, :]] = -2.0
    # no query's score is sorted that more than k others exceed
    least = np.partition(scores, -k, axis=1)[:, -k] if 0 < k < len(ids) else np.full(len(names), -2.0)
    query, at = np.nonzero(scores >= least[:, None])
    found = scores[query, at]
    order = np.lexsort((at, -found, query))
    query, at, found = query[order], at[order], found[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    best = (place < k) & (found >= -1.5)
    return pd.DataFrame({"query_id": names[query[best]], "doc_id": ids[at[best]], "score": found[best]})


def nearest(vectors: DataFrame, queries: DataFrame, k: int, by: tuple[str, ...] = (), others_only: bool = False, most_queries: int | None = None) -> DataFrame:
    """query_id, doc_id, score: candidates for the k nearest (by, doc_id, vector) of each query (by, query_id, vector) by cosine among the
    vectors with its values of `by`, the k best of each block; rank them to have the k best of all.

    Scores have six digits; equal ones go by doc_id. A vector without length has cosine 0. others_only leaves out a vector whose
    doc_id is the query_id. A query may be in several groups. Up to most_queries (by default MOST_QUERIES) rows of queries are sent to the vectors where they are; beyond that,
    both sides are dealt into blocks, so that a group of any size is in as many tasks as its blocks.
    """
    kinds = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("doc_id", vectors.schema["doc_id"].dataType)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", score double"
    vectors, queries = vectors.select(*by, "doc_id", "vector"), queries.select(*by, "query_id", "vector")
    most_queries = MOST_QUERIES if most_queries is None else most_queries
    few = queries.limit(most_queries + 1).toPandas()
    if len(few) <= most_queries:
        groups = {key: (part["query_id"].to_numpy(), scaled(part["vector"].to_list())) for key, part in _grouped(few, by)}
        sent = vectors.sparkSession.sparkContext.broadcast(groups)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, part in _grouped(batch, by):
                    if key in sent.value:
                        part = part.sort_values("doc_id")
                        yield _best(part["doc_id"].to_numpy(), scaled(part["vector"].to_list()), *sent.value[key], k, others_only)

        return vectors.mapInPandas(run, schema)

    def blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
        return rows.groupBy(*(F.col(c).alias(f"_{c}") for c in by), F.lit(0).alias("_all")).agg(F.ceil(F.count("*") / most).cast("int").alias(name))

    both = blocks(vectors, VECTORS_A_BLOCK, "parts").join(blocks(queries, QUERIES_A_BLOCK, "asked"), [*(f"_{c}" for c in by), "_all"])
    both = F.broadcast(both) if both.count() <= MOST_GROUPS else both
    same = reduce(lambda x, c: x & (F.col(c) == F.col(f"_{c}")), by, F.col("_all") == 0)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = vectors.join(both, same).select(*by, "doc_id", "vector", own("doc_id", "parts").alias("part"), every("asked").alias("ask"))
    right = queries.join(both, same).select(*by, "query_id", "vector", every("parts").alias("part"), own("query_id", "asked").alias("ask"))

    def meet(block: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(asks):
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        block = block.sort_values("doc_id")
        return _best(block["doc_id"].to_numpy(), scaled(block["vector"].to_list()), asks["query_id"].to_numpy(), scaled(asks["vector"].to_list()), k, others_only)

    keys = [*by, "part", "ask"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)


def _grouped(rows: pd.DataFrame, by: tuple[str, ...]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    return ((key, part) for key, part in rows.groupby(list(by))) if by else iter([((), rows)] if len(rows) else [])


def ranked(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",), tie: str = "doc_id") -> DataFrame:
    """The k best by score, then tie, of each query, with rank."""
    order: Column = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), tie))
    return scores.withColumn("rank", order).where(F.col("rank") <= k)
