"""Sampling by hash order: the same rows on every run, on any number of machines."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *keys: Column) -> Column:
    """A text to sort by: the md5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def pool(rows: DataFrame, by: str, key: str, n: int, backups: int = 3, seed: int = 42) -> DataFrame:
    """n * backups rows of each group in hash order, with their place; the first n are the sample, the rest replace failures."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(hash_order(seed, F.col(by), F.col(key)), key))
    return rows.withColumn("place", place).where(F.col("place") <= n * backups).withColumn("is_backup", F.col("place") > n)


def first_valid(rows: DataFrame, by: str, n: int, valid: Column, score: Column | None = None, least: float | None = None) -> DataFrame:
    """The first n valid rows of each group, in the order of place. With a score, rows that score below `least`, or 0 where it is None, count as failed too."""
    ok = valid if score is None else valid & ((score != 0) if least is None else (score >= least))
    return rows.where(ok).withColumn("used", F.row_number().over(Window.partitionBy(by).orderBy("place"))).where(F.col("used") <= n)


def to_retry(results: DataFrame, score: str = "trace", least: float = 0.01) -> DataFrame:
    """The result rows that a further pass asks again: invalid ones and those that score below `least`."""
    return results.where(~F.coalesce("is_valid", F.lit(False)) | (F.coalesce(score, F.lit(0.0)) < least))


def noise_mix(records: DataFrame, ratio: float, many: int = 5, seed: int = 42) -> DataFrame:
    """id and documents: floor(many * ratio) of `negative` and the rest of `positive`, each as far as there are so many, in hash order."""
    noise = int(many * ratio)

    def picked(column: str, n: int) -> Column:
        keyed = F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda d, i: F.struct(hash_order(seed, F.col("id"), F.lit(column), i).alias("h"), d.alias("d")))
        return F.slice(F.array_sort(keyed), 1, n) if n else F.array().cast("array<struct<h:string,d:string>>")

    both = F.array_sort(F.concat(picked("negative", noise), picked("positive", many - noise)))
    return records.select("id", F.transform(both, lambda x: x["d"]).alias("documents"))


def noise_mix_of_rows(rows: DataFrame, ratio: float, many: int = 5, seed: int = 42) -> DataFrame:
    """noise_mix() of records as rows (id, kind, document): kind is negative or positive, document a text. No row or task holds all of an id.

    A document's number in its list is that of its group, the documents with its first characters, and its place there.
    """
    noise = int(many * ratio)
    rows = rows.withColumn("group", F.substring("document", 1, 6))
    before = Window.partitionBy("id", "kind").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("id", "kind", "group").agg(F.count("*").alias("n")).select(F.col("id").alias("_id"), F.col("kind").alias("_kind"), F.col("group").alias("_group"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inner = F.row_number().over(Window.partitionBy("id", "kind", "group").orderBy("document")) - 1
    placed = rows.withColumn("at", inner).join(ahead, F.col("id").eqNullSafe(F.col("_id")) & (F.col("kind") == F.col("_kind")) & (F.col("group") == F.col("_group")))
    keyed = placed.select("id", "kind", "document", hash_order(seed, F.col("id"), F.col("kind"), F.col("ahead") + F.col("at")).alias("h"))
    place = F.row_number().over(Window.partitionBy("id", "kind").orderBy("h", "document"))
    # the rank is below a constant first, which tasks cut before rows are dealt
    top = keyed.withColumn("place", place).where(F.col("place") <= max(noise, many - noise)).where(F.col("place") <= F.when(F.col("kind") == "negative", noise).otherwise(many - noise))
    both = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("h", "document"))).alias("d"))
    return both.select("id", F.transform("d", lambda x: x["document"]).alias("documents"))


def negatives_only(records: DataFrame, many: int = 5, seed: int = 42) -> DataFrame:
    return noise_mix(records, 1.0, many, seed)


def counterfactual(records: DataFrame, many: int = 5) -> DataFrame:
    """id and the first documents of positive_wrong, or of positive where there are none."""
    wrong = F.when(F.size(F.coalesce("positive_wrong", F.array().cast("array<string>"))) > 0, F.col("positive_wrong")).otherwise(F.col("positive"))
    return records.select("id", F.slice(wrong, 1, many).alias("documents"))
