"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Each stage gets the documents that the stage before it kept, as a Parquet table, and works on all of them.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import jaccard, mixing, packing, secrets, toxicity
from ragloom.llm.store import documents, shared_dir, small_batches

#: Documents that score this much are toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below TOXIC; its labels are sf_dir's, its texts those of docs."""
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.withColumnRenamed("score", "_own_score"), model).where(F.col("score") < TOXIC).drop("score").withColumnRenamed("_own_score", "score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links."""
    return jaccard.keep_one(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced by a mark."""
    small_batches(spark)
    found = secrets.findings(docs, secrets.fit(docs)).where(F.col("probability") >= secrets.THRESHOLD)
    return secrets.redact(docs, found)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row for each time a document is taken, in order of training position."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences, in the order in which the table docs was written: sequence_id grows with it."""
    small_batches(spark)
    # Spark reads files by size; part numbers and rows within a part are the order that mixing gave
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long")
    placed = docs.select("doc_id", "text", part.alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    place = ["_part", "_file", "_row"]
    return packing.pack(placed.repartitionByRange(*place).sortWithinPartitions(*place))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models and tokenizers have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is a table in the shared folder that the next one reads."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
