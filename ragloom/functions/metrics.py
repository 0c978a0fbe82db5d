"""Scores of one example, and of vectors."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def trace_scores(relevant: Column, utilized: Column, supported: Column, total: Column) -> Column:
    """Struct of context_relevance, context_utilization, completeness and adherence from arrays of sentence keys.

    Keys count once each, whether or not such a sentence exists; shares are capped at 1. Without sentences all shares are 0.
    """
    r, u = F.array_distinct(relevant), F.array_distinct(utilized)
    part = lambda n, d: F.when((total > 0) & (d > 0), F.least(n / F.greatest(d, F.lit(1)), F.lit(1.0))).otherwise(0.0)
    return F.struct(
        part(F.size(r), total).alias("context_relevance"), part(F.size(u), total).alias("context_utilization"),
        part(F.size(F.array_intersect(r, u)), F.size(r)).alias("completeness"), supported.cast("double").alias("adherence"),
    )


def trace_average(relevance: Column, utilization: Column, completeness: Column, adherence: Column) -> Column:
    return (relevance + utilization + completeness + adherence) / 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
