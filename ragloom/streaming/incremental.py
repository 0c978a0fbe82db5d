"""Evaluation that goes on where it stopped: new samples arrive in a folder, results are appended once."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ragloom.sources.loaders import append_results


def evaluate_stream(spark: SparkSession, samples: str, schema: str, evaluate: Callable[[DataFrame], DataFrame], results: str, checkpoint: str, keys: tuple[str, ...] = ("config", "dataset_id")) -> StreamingQuery:
    """Evaluate every Parquet file that appears in `samples` and append to `results`; rows with known keys are left out, so a repeated batch adds nothing."""
    stream = spark.readStream.schema(schema).parquet(samples)
    return stream.writeStream.foreachBatch(lambda batch, _: append_results(evaluate(batch), results, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
