"""Comparisons: embeddings, chunkings and answer models by their scores, the best of each, and rankings of configurations."""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ragloom.functions.metrics import cosine
from ragloom.operators.embedding import Embedder, embedded
from ragloom.operators.nearest import nearest
from ragloom.operators.nearest import ranked as ranked_nearest
from ragloom.plans.models import ChatModel, asked
from ragloom.sources.shared import written

#: What the best configuration is made of where a phase has no result.
FALLBACKS = {"embedding": "minilm", "chunking": "semantic", "model": "llama-3.1-8b"}


def retrieval_scores(hits: DataFrame, by: str) -> DataFrame:
    """`by`, avg_score and n: the mean score of each query's hits (by, query_id, score), then the mean over queries that have hits."""
    each = hits.groupBy(by, "query_id").agg(F.avg("score").alias("score"))
    return each.groupBy(by).agg(F.round(F.avg("score"), 6).alias("avg_score"), F.count("*").alias("n"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """strategy, avg_chunks: chunks of an example, by strategy and example_id in chunks. Written once; it names the strategies that have chunks."""
    counts = chunks.groupBy("strategy", "example_id").agg(F.count("*").alias("n")).groupBy("strategy").agg(F.round(F.avg("n"), 6).alias("avg_chunks"))
    return written(counts, "chunk-counts")


def chunking_scores(hits: DataFrame, counts: DataFrame) -> DataFrame:
    """strategy, avg_chunks (see chunk_counts()), avg_score and n."""
    return retrieval_scores(hits, "strategy").join(counts, "strategy").select("strategy", "avg_chunks", "avg_score", "n")


def nearest_by_strategy(chunks: DataFrame, strategies: DataFrame, queries: DataFrame, embedder: Embedder, k: int = 5) -> DataFrame:
    """strategy, query_id, score of the k nearest chunks (strategy, doc_id, text) of each query (query_id, text) in each strategy that strategies names; texts are embedded once."""
    asked = embedded(queries.select("query_id", "text"), "text", embedder).join(F.broadcast(strategies.select("strategy")))
    asked = asked.select("strategy", F.to_json(F.array("strategy", F.col("query_id").cast("string"))).alias("query_id"), "vector")
    hits = ranked_nearest(nearest(embedded(chunks.select("strategy", "doc_id", "text"), "text", embedder), asked, k, ("strategy",)), k)
    at = F.from_json("query_id", "array<string>")
    return hits.select(at[0].alias("strategy"), at[1].cast(queries.schema["query_id"].dataType).alias("query_id"), "score")


def compare_models(rows: DataFrame, models: dict[str, ChatModel], embedder: Embedder, truth: str = "truth", prompt: str = "prompt") -> DataFrame:
    """answer_scores() of models that answer the same rows (prompt, truth): each is asked everything once, with the time of its calls and the words of its answers."""
    parts = [asked(rows.select(prompt, truth), prompt, m, ms="ms").withColumn("model", F.lit(name)) for name, m in models.items()]
    said = embedded(embedded(reduce(DataFrame.unionByName, parts), "response", embedder, "answer_vector"), truth, embedder, "truth_vector")
    return answer_scores(said.withColumn("tokens", F.size(F.split(F.trim(F.coalesce("response", F.lit(""))), r"\s+"))))


def observed(results: DataFrame, name: str = "results") -> tuple[DataFrame, Observation]:
    """results (is_valid, and ms if it is there) with an observation that has n, n_valid and avg_ms once a job has gone over them: no second pass counts them."""
    seen = Observation(name)
    ms = F.avg("ms") if "ms" in results.columns else F.lit(None).cast("double")
    return results.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("is_valid").alias("n_valid"), ms.alias("avg_ms")), seen


def answer_scores(answers: DataFrame) -> DataFrame:
    """model, avg_similarity, avg_ms, avg_tokens and n of answers (model, answer_vector, truth_vector, ms, tokens, error) without an error, best first."""
    ok = answers.where("error IS NULL")
    out = ok.groupBy("model").agg(F.round(F.avg(cosine(F.col("answer_vector"), F.col("truth_vector"))), 6).alias("avg_similarity"), F.avg("ms").alias("avg_ms"), F.coalesce(F.avg("tokens"), F.lit(0.0)).alias("avg_tokens"), F.count("*").alias("n"))
    return out.orderBy(F.desc("avg_similarity"), "model")


@dataclass(frozen=True)
class BestConfig:
    embedding: str
    chunking: str
    model: str
    scores: tuple[float | None, float | None, float | None]


def best_config(embeddings: DataFrame, chunkings: Callable[[str], DataFrame], models: Callable[[str, str], DataFrame]) -> BestConfig:
    """The greedy best: the best embedding goes into the comparison of chunkings, both go into that of models. One row of each reaches the driver."""

    def first(scores: DataFrame, name: str, value: str, phase: str) -> tuple[str, float | None]:
        row = scores.orderBy(F.desc(value), name).select(name, value).first()
        return (row[0], row[1]) if row else (FALLBACKS[phase], None)

    embedding, a = first(embeddings, "embedding", "avg_score", "embedding")
    chunking, b = first(chunkings(embedding), "strategy", "avg_score", "chunking")
    model, c = first(models(embedding, chunking), "model", "avg_similarity", "model")
    return BestConfig(embedding, chunking, model, (a, b, c))


def ranked(results: DataFrame, value: str, tie: str, by: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Configurations with rank by a value, the highest first, then by tie; the first n of each group. One row a configuration goes into the window."""
    order = Window.partitionBy(*(by or [])).orderBy(F.desc_nulls_last(value), tie)
    out = results.withColumn("rank", F.row_number().over(order))
    return out if n is None else out.where(F.col("rank") <= n)


def statistics(results: DataFrame) -> DataFrame:
    """total, valid, failed and the percentages of both, over configurations (n, n_valid)."""
    total, valid = F.sum("n"), F.sum("n_valid")
    share = lambda x: F.round(F.coalesce(100.0 * x / F.nullif(total, F.lit(0)), F.lit(0.0)), 6)
    return results.agg(F.coalesce(total, F.lit(0)).alias("total"), F.coalesce(valid, F.lit(0)).alias("valid"), F.coalesce(total - valid, F.lit(0)).alias("failed"), share(valid).alias("valid_percent"), share(total - valid).alias("failed_percent"))


def insight(config_type: Column, method: Column) -> Column:
    """Why the best configuration of a domain is of its kind."""
    said = F.when(config_type == "sparse", "lexical matching effective").when(config_type == "hybrid", "benefits from semantic + lexical").otherwise("semantic understanding is key")
    kind = F.when(config_type.isin("sparse", "hybrid"), F.initcap(config_type)).otherwise("Dense")
    return F.concat(kind, F.lit(" ("), method, F.lit(") optimal - "), said)


def progress_totals(progress: DataFrame, expected: int, seconds_each: float | None = None) -> DataFrame:
    """Of progress rows (n, state): total, done, begun, not_begun, percent done, examples done, and the seconds left at seconds_each an example."""
    at = lambda s: F.count_if(F.col("state") == s)
    examples = F.sum(F.least(F.col("n"), F.lit(expected)))
    left = (F.count("*") * expected - examples) * seconds_each if seconds_each is not None else F.lit(None).cast("double")
    return progress.agg(
        F.count("*").alias("total"), at("done").alias("done"), at("begun").alias("begun"), at("not begun").alias("not_begun"),
        F.round(F.coalesce(100.0 * at("done") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("percent"), examples.alias("examples"), left.alias("seconds_left"),
    )
