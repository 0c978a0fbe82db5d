"""Writing and finding results, sample caches, exports and a first look at a table."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators.aggregation import config_results
from ragloom.sources.loaders import checkpoints


def write_ranked(results: DataFrame, folder: str, stamp: str, name: str = "results") -> None:
    """Results as JSON lines twice: under the stamp, for good, and as the latest, which replaces the one before."""
    stamped = f"{folder}/{name}_{stamp}"
    results.write.json(stamped)
    results.sparkSession.read.schema(results.schema).json(stamped).write.mode("overwrite").json(f"{folder}/{name}_latest")


def write_comparison(parts: dict[str, DataFrame], path: str) -> None:
    """The tables of a comparison in one: a row of JSON for each row, with the name of its part."""
    out = None
    for name, rows in parts.items():
        one = rows.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("row"))
        out = one if out is None else out.unionByName(one)
    if out is not None:
        out.write.mode("overwrite").parquet(path)


def latest_results(spark: SparkSession, folder: str, pattern: str = "*results_*.json") -> str:
    """The path of the newest file of results; an error if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).drop("content")
    newest = files.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return newest


def reloaded(spark: SparkSession, pattern: str) -> DataFrame:
    """Configuration results computed anew from the checkpoint files with rows."""
    return config_results(checkpoints(spark, pattern).where("is_valid IS NOT NULL"), ["config"])


def save_samples(samples: DataFrame, folder: str, domain: str) -> None:
    """A domain's sample cache as JSON lines; VARIANT columns become JSON texts."""
    plain = [F.to_json(c).alias(c) if t == "variant" else F.col(c) for c, t in samples.dtypes]
    samples.select(*plain).write.mode("overwrite").json(f"{folder}/{domain}")


def cached_samples(spark: SparkSession, folder: str, domain: str, schema: str | None = None) -> DataFrame | None:
    """A domain's sample cache; None if there is none."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.json(f"{folder}/{domain}")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def exported(rows: DataFrame, n: int) -> pd.DataFrame:
    """The first n rows for the driver."""
    return rows.limit(n).toPandas()


def explored(rows: DataFrame, n: int = 1, most_chars: int = 300) -> DataFrame:
    """column, type and n values, cut to most_chars, of every column."""
    head = rows.limit(n)
    values = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.substring((F.to_json(c) if t.startswith(("struct", "array", "map", "variant")) else F.col(c).cast("string")), 1, most_chars).alias("value")) for c, t in rows.dtypes))
    return head.select(F.explode(values).alias("v")).groupBy("v.column", "v.type").agg(F.collect_list("v.value").alias("values"))
