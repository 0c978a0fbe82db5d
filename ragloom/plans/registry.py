"""What is known by name: embedding models, answer models, grids of configurations, and how a configuration retrieves."""

import time
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators.retrieval import RetrievalSpec
from ragloom.plans.evaluation import config_grid, config_id

# The short names that configurations use.
EMBEDDINGS = {
    "minilm": ("sentence-transformers/all-MiniLM-L6-v2", 384), "mpnet": ("sentence-transformers/all-mpnet-base-v2", 768), "bge-base": ("BAAI/bge-base-en-v1.5", 768),
    "bge-large": ("BAAI/bge-large-en-v1.5", 1024), "e5-base": ("intfloat/e5-base-v2", 768), "e5-large": ("intfloat/e5-large-v2", 1024), "gte-large": ("thenlper/gte-large", 1024),
    "jina-base": ("jinaai/jina-embeddings-v2-base-en", 768), "finbert": ("yiyanghkust/finbert-tone", 768), "legal-bert": ("nlpaueb/legal-bert-base-uncased", 768),
    "law-embedding-1": ("law-ai/InLegalBERT", 768), "pubmedbert": ("NeuML/pubmedbert-base-embeddings", 768), "biobert": ("dmis-lab/biobert-base-cased-v1.2", 768),
    "bioclinicalbert": ("emilyalsentzer/Bio_ClinicalBERT", 768), "sapbert": ("cambridgeltl/SapBERT-from-PubMedBERT-fulltext", 768), "biomed-e5-large": ("BAAI/bge-large-en-v1.5", 1024),
}
MODELS = {
    "llama-3.3-70b": "llama-3.3-70b-versatile", "llama-3.1-8b": "llama-3.1-8b-instant", "llama-4-scout": "meta-llama/llama-4-scout-17b-16e-instruct",
    "llama-4-maverick": "meta-llama/llama-4-maverick-17b-128e-instruct", "qwen3-32b": "qwen/qwen3-32b", "kimi-k2": "moonshotai/kimi-k2-instruct",
    "gpt-oss-20b": "openai/gpt-oss-20b", "gpt-oss-120b": "openai/gpt-oss-120b", "compound": "groq/compound",
}
DOMAIN_EMBEDDINGS = {
    "finqa": ["finbert", "bge-large", "e5-large", "gte-large", "minilm", "mpnet"],
    "cuad": ["legal-bert", "law-embedding-1", "e5-large", "bge-large", "minilm", "mpnet"],
    "delucionqa": ["bge-large", "e5-large", "gte-large", "minilm", "mpnet"],
    "hotpotqa": ["bge-large", "e5-large", "gte-large", "minilm", "mpnet"],
    "covidqa": ["bioclinicalbert", "pubmedbert", "biomed-e5-large", "sapbert", "bge-base", "biobert", "minilm", "mpnet"],
}
DOMAIN_MODELS = {
    "finqa": ["openai/gpt-oss-120b", "qwen/qwen3-32b", "llama-3.3-70b-versatile", "groq/compound", "openai/gpt-oss-20b"],
    "cuad": ["openai/gpt-oss-120b", "qwen/qwen3-32b", "llama-3.3-70b-versatile", "moonshotai/kimi-k2-instruct-0905", "llama-3.1-8b-instant"],
    "delucionqa": ["openai/gpt-oss-120b", "qwen/qwen3-32b", "llama-3.3-70b-versatile", "moonshotai/kimi-k2-instruct-0905", "groq/compound"],
    "hotpotqa": ["openai/gpt-oss-120b", "qwen/qwen3-32b", "llama-3.3-70b-versatile", "moonshotai/kimi-k2-instruct-0905", "llama-3.1-8b-instant"],
    "covidqa": ["openai/gpt-oss-120b", "qwen/qwen3-32b", "llama-3.3-70b-versatile", "moonshotai/kimi-k2-instruct-0905", "llama-3.1-8b-instant"],
}
#: The ten configurations of the final runs, best first. Lists for each domain are top_configs() of its results.
FINAL_CONFIGS = (
    ("sparse", "semantic", "tfidf", "qwen/qwen3-32b"), ("sparse", "semantic", "bm25", "qwen/qwen3-32b"), ("sparse", "semantic", "tfidf", "groq/compound"), ("hybrid", "semantic", "finbert", "groq/compound"),
    ("dense", "semantic", "finbert", "qwen/qwen3-32b"), ("dense", "semantic", "bge-base", "groq/compound"), ("dense", "semantic", "minilm", "openai/gpt-oss-120b"), ("sparse", "semantic", "bm25", "groq/compound"),
    ("dense", "semantic", "mpnet", "qwen/qwen3-32b"), ("dense", "semantic", "finbert", "groq/compound"),
)
#: The weight of the dense leg, by kind of run.
ALPHAS = {"preliminary": 0.5, "final": 0.7, "multidomain": 0.5}


def methods(spark: SparkSession) -> DataFrame:
    """key, name, dimension and kind of every retrieval method that is known."""
    rows = [(k, name, dimension, "dense") for k, (name, dimension) in EMBEDDINGS.items()] + [(k, k, None, "sparse") for k in ("bm25", "tfidf")]
    return spark.createDataFrame(rows, "key string, name string, dimension int, kind string")


def with_models(rows: DataFrame, column: str = "llm", name: str = "model") -> DataFrame:
    """rows with the full id of the model in a column; a name that isn't known stands for itself."""
    known = rows.sparkSession.createDataFrame(list(MODELS.items()), "_alias string, _model string")
    return rows.join(F.broadcast(known), F.col(column) == F.col("_alias"), "left").withColumn(name, F.coalesce("_model", column)).drop("_alias", "_model")


def grids(spark: SparkSession) -> DataFrame:
    """The configurations of all domains, numbered from 1 within each."""
    return reduce(DataFrame.unionByName, (config_grid(spark, d, DOMAIN_EMBEDDINGS[d], DOMAIN_MODELS[d]) for d in DOMAIN_EMBEDDINGS))


def final_configs(spark: SparkSession) -> DataFrame:
    rows = [(i, *c) for i, c in enumerate(FINAL_CONFIGS, 1)]
    return spark.createDataFrame(rows, "config_index int, config_type string, chunking string, method string, llm string").withColumn("config_id", config_id())


def config_counts(configs: DataFrame, examples: int = 10) -> DataFrame:
    """By domain: configurations, methods, models and the evaluations of `examples` each; a row with domain null sums up."""
    counts = [F.count("*").alias("configs"), F.countDistinct("method").alias("methods"), F.countDistinct("llm").alias("models"), (F.count("*") * examples).alias("evaluations")]
    return configs.groupBy("domain").agg(*counts).unionByName(configs.agg(*counts).withColumn("domain", F.lit(None).cast("string")))


def retrieval_of(config_type: str, method: str, run: str = "preliminary", base: RetrievalSpec = RetrievalSpec()) -> RetrievalSpec:
    """How a configuration retrieves: a sparse method, or the embedding `method` alone or beside TF-IDF."""
    if config_type not in ("sparse", "dense", "hybrid"):
        raise ValueError(f"unknown kind of configuration {config_type}")
    if config_type == "sparse":
        return replace(base, method=method)
    return replace(base, method=config_type, sparse="tfidf", alpha=ALPHAS[run])


T = TypeVar("T")


def timed(action: Callable[[], T]) -> tuple[T, float]:
    """What an action returns and the seconds it took."""
    began = time.perf_counter()
    return action(), time.perf_counter() - began
