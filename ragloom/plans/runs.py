"""Runs of evaluations to their end: waves, retries, backups, a stop when a service refuses, and going on where a run stopped.

Every wave of a run is a table that Spark commits as a whole; what has one is never asked again. So a run can be stopped, or lose its driver, at any
time and is continued by calling it again with the same folder.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.operators.sampling import first_valid, to_retry
from ragloom.plans.models import NOT_ASKED

#: Retries of rows that failed or scored next to nothing, the score below which they do, and rows that are asked in one job.
ROUNDS, LEAST, WAVE = 2, 0.01, 10_000


class RunStopped(Exception):
    """The service refuses more calls: what was answered is kept, and the same call goes on with the rest."""


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path if its job ended."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return spark.read.parquet(path) if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place) else None


class Run:
    """A run over a pool of samples.

    pool: `by` (a configuration), `key` (unique within it), place (from 1; the first n are the sample, the others its backups) and what evaluate needs.
    evaluate: rows of the pool to rows of results, with by, key, place, is_valid, error and the score, one for each row. folder: where the run's tables are.
    """

    def __init__(self, pool: DataFrame, evaluate: Callable[[DataFrame], DataFrame], folder: str, by: str = "config", key: str = "sample_id", n: int = 10, score: str = "trace", least: float = LEAST, rounds: int = ROUNDS, wave: int = WAVE):
        self.pool, self.evaluate, self.folder, self.spark = pool, evaluate, folder.rstrip("/"), pool.sparkSession
        self.by, self.key, self.n, self.score, self.least, self.rounds, self.wave = by, key, n, score, least, rounds, wave
        self.attempts: list[DataFrame] = []

    def ask(self, rows: DataFrame, turn: int) -> DataFrame:
        """The results of one turn, wave by wave; RunStopped once a wave has rows that a refusing service left unasked."""
        asked_for = rows.count()
        waves = max(1, -(-asked_for // self.wave))
        dealt = rows.withColumn("_wave", F.pmod(F.xxhash64(self.by, self.key), F.lit(waves)))
        made = []
        for w in range(waves if asked_for else 0):
            path = f"{self.folder}/turn={turn}/wave={w}-of-{waves}"
            parts = self._parts(path)
            held = self._union(parts)
            part = dealt.where(F.col("_wave") == w).drop("_wave")
            if held is not None:
                part = part.join(held.select(self.by, self.key), [self.by, self.key], "left_anti")
            if not part.isEmpty():
                whole = f"{path}/part={len(parts)}"
                self.evaluate(part).withColumn("turn", F.lit(turn)).write.mode("overwrite").parquet(f"{whole}-all")
                every = self.spark.read.parquet(f"{whole}-all")
                # rows that weren't asked, or met the refusal, are no results: they are asked when the run goes on
                refused = F.coalesce((F.col("error") == NOT_ASKED) | F.col("error").rlike("^RateLimit(ed|Error):"), F.lit(False))
                every.where(~refused).write.mode("overwrite").parquet(whole)
                parts.append(self.spark.read.parquet(whole))
                left = every.where(refused).count()
                if left:
                    raise RunStopped(f"{left} rows of turn {turn} are to be asked when the service answers again; the others are kept in {self.folder}")
            made += parts
        return self._union(made) if made else self.evaluate(rows).withColumn("turn", F.lit(turn)).limit(0)

    def _parts(self, path: str) -> list[DataFrame]:
        out: list[DataFrame] = []
        while (held := _table(self.spark, f"{path}/part={len(out)}")) is not None:
            out.append(held)
        return out

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame | None:
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        return out

    def latest(self) -> DataFrame:
        """The last result of each row that was asked."""
        every = self._union(self.attempts)
        return every.withColumn("_last", F.row_number().over(Window.partitionBy(self.by, self.key).orderBy(F.desc("turn")))).where("_last = 1").drop("_last")

    def finish(self) -> DataFrame:
        """The first n valid results of each configuration in order of place, with `used`, their number; fewer where the pool ran out.

        The sample is asked, then up to `rounds` times what failed or scored below `least`; then each configuration asks as many of its next backups as it
        lacks results, once each, until it has n or no backups are left. Which rows are asked depends on results alone, not on partitions.
        """
        self.attempts = [self.ask(self.pool.where(F.col("place") <= self.n), 0)]
        for turn in range(1, self.rounds + 1):
            failed = to_retry(self.latest(), self.score, self.least).select(self.by, self.key)
            rows = self.pool.join(failed, [self.by, self.key], "left_semi")
            if rows.isEmpty():
                break
            self.attempts.append(self.ask(rows, turn))
        turn = self.rounds
        while True:
            turn += 1
            good = self._good().groupBy(self.by).agg(F.count("*").alias("_good"))
            rest = self.pool.join(self.latest().select(self.by, self.key), [self.by, self.key], "left_anti").join(good, self.by, "left")
            next_ones = rest.withColumn("_next", F.row_number().over(Window.partitionBy(self.by).orderBy("place")))
            rows = next_ones.where(F.col("_next") <= self.n - F.coalesce("_good", F.lit(0))).select(*self.pool.columns)
            if rows.isEmpty():
                return first_valid(self.latest(), self.by, self.n, *self._valid(), self.least)
            self.attempts.append(self.ask(rows, turn))

    def _valid(self) -> tuple[Column, Column]:
        return F.coalesce("is_valid", F.lit(False)), F.coalesce(self.score, F.lit(0.0))

    def _good(self) -> DataFrame:
        ok, score = self._valid()
        return self.latest().where(ok & (score >= self.least))
