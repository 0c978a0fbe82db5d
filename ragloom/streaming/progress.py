"""Progress of evaluations as keyed state of a stream: for each configuration the index to go on from, and counters.

Result rows arrive in a folder, in any order and perhaps more than once. The state of a configuration is the first index that has no result yet, the
results beyond it that came early, and counters; a row counts when its index is met for the first time. State and the place in the folder are kept
in the stream's checkpoint, so a stream that stops goes on where it was, and every row counts once.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a row of results needs, and what a row of progress has.
RESULTS = "config string, idx long, is_valid boolean, trace double"
PROGRESS = "config string, next_idx long, early long, n long, n_valid long, trace_sum double"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Progress(StatefulProcessor):
    """State of one configuration: (next index, results, valid ones, sum of their traces), and the indexes that came before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "next_idx long, n long, n_valid long, trace_sum double")
        self.early = handle.getMapState("early", "idx long", "seen boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        at, n, valid, total = self.totals.get() if self.totals.exists() else (0, 0, 0, 0.0)
        for part in rows:
            for idx, is_valid, trace in zip(part["idx"].tolist(), part["is_valid"].tolist(), part["trace"].tolist(), strict=True):
                if pd.isna(idx) or idx < at or self.early.containsKey((idx,)):
                    continue  # counted before
                n += 1
                if is_valid:
                    valid += 1
                    total += 0.0 if pd.isna(trace) else trace
                if idx > at:
                    self.early.updateValue((idx,), (True,))
                    continue
                at += 1
                while self.early.containsKey((at,)):
                    self.early.removeKey((at,))
                    at += 1
        self.totals.update((at, n, valid, total))
        yield pd.DataFrame({"config": [key[0]], "next_idx": [at], "early": [n - at], "n": [n], "n_valid": [valid], "trace_sum": [total]})

    def close(self) -> None:
        pass


def track_progress(spark: SparkSession, results: str, progress: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
    """Follow the result files (Parquet, RESULTS) in the folder `results`, as many at a time as `files` says, until all that are there are counted.

    Each batch writes the new state of the configurations it met to progress/batch=N; a batch that is repeated replaces its own table.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    reader = spark.readStream.schema(RESULTS)
    rows = (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(results)
    states = rows.groupBy("config").transformWithStateInPandas(Progress(), PROGRESS, "Update", "None")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{progress}/batch={number}")

    return states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_progress(spark: SparkSession, progress: str) -> DataFrame:
    """The newest state of each configuration: config, next_idx, early, n, n_valid, avg_trace."""
    rows = spark.read.schema(PROGRESS + ", batch long").parquet(progress)
    newest = rows.groupBy("config").agg(F.max_by(F.struct("next_idx", "early", "n", "n_valid", "trace_sum"), "batch").alias("s"))
    return newest.select("config", "s.next_idx", "s.early", "s.n", "s.n_valid", F.round(F.col("s.trace_sum") / F.nullif("s.n_valid", F.lit(0)), 6).alias("avg_trace"))
