"""Aggregation of example results into configuration results, classification measures, rankings and reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.operators.ordering import running_before

SCORES = ("relevance", "utilization", "completeness", "adherence")


def config_results(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means of computed_ and gt_ scores over valid rows, RMSE of all but adherence, counts, and the mean of the four, by configuration."""
    ok = F.col("is_valid")
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    means = [mean(f"{k}_{s}").alias(f"{k}_{s}") for k in ("computed", "gt") for s in SCORES]
    rmse = [F.sqrt(F.avg(F.when(ok, F.pow(F.col(f"computed_{s}") - F.col(f"gt_{s}"), 2)))).alias(f"rmse_{s}") for s in SCORES[:3]]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid"), *means, *rmse)
    return out.withColumn("avg_trace", sum(F.col(f"computed_{s}") for s in SCORES) / 4)


def classification(rows: DataFrame, by: list[str], predicted: Column, truth: Column) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of 0/1 columns; 0 where undefined."""
    counts = rows.groupBy(*by).agg(F.count_if((predicted == 1) & (truth == 1)).alias("tp"), F.count_if((predicted == 1) & (truth == 0)).alias("fp"), F.count_if((predicted == 0) & (truth == 1)).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def auroc(rows: DataFrame, by: list[str], score: Column, truth: Column, default: float = 0.5) -> DataFrame:
    """Area under the ROC curve by mid-ranks; `default` where one class is absent. Rows are summed by score, and ranges of scores are
    counted, before anything is sorted."""
    at = rows.groupBy(*by, score.cast("double").alias("s")).agg(F.count("*").alias("n"), F.sum(truth).alias("p"))
    ranked = running_before(at, by, "s", "n", "before").withColumn("r", (F.col("before") + (F.col("n") + 1) / 2) * F.col("p"))
    sums = ranked.groupBy(*by).agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    p, n = F.col("p"), F.col("n") - F.col("p")
    return sums.select(*by, F.when((p > 0) & (n > 0), (F.col("r") - p * (p + 1) / 2) / (p * n)).otherwise(default).alias("auroc"))


def health(rows: DataFrame, by: list[str], expected: int = 10) -> DataFrame:
    """total, zeros (all four scores 0), valid and status of each checkpoint."""
    zero = F.lit(True)
    for s in SCORES:
        zero = zero & (F.coalesce(F.col(f"computed_{s}"), F.lit(0.0)) == 0)
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(zero).alias("zeros"), F.count_if("is_valid").alias("valid"))
    status = F.when(F.col("total") == 0, "empty").when(F.col("total") != expected, f"less_than_{expected}").when(F.col("zeros") == F.col("total"), "all_zeros").when(F.col("zeros") > 0, "partial_zeros").otherwise("ok")
    return out.withColumn("status", status)


def progress(configs: DataFrame, results: DataFrame, key: str, expected: int) -> DataFrame:
    """Every configuration with the number of its results and whether it is done, begun or not begun."""
    done = results.groupBy(key).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return configs.join(done, key, "left").withColumn("n", n).withColumn("state", F.when(F.col("n") >= expected, "done").when(F.col("n") > 0, "begun").otherwise("not begun"))


def best_by(rows: DataFrame, by: list[str], value: str, name: str, highest: bool = True) -> DataFrame:
    """The row of each group with the best value; of equals the smallest name."""
    order = Window.partitionBy(*by).orderBy(F.desc(value) if highest else F.asc(value), name)
    return rows.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def ability_rates(rows: DataFrame, by: list[str], correct: Column) -> DataFrame:
    """Percent of rows that are correct."""
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(correct).alias("correct")).withColumn("rate", F.round(100.0 * F.col("correct") / F.col("total"), 6))


def pivoted(rates: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """One row for each `row`, a column for each of columns, and their mean."""
    wide = rates.groupBy(row).pivot(column, columns).agg(F.first(value))
    names = [str(c) for c in columns]
    wide = wide.select(row, *(F.col(f"`{c}`").alias("at_" + c.replace(".", "_")) for c in names))
    got = F.array_compact(F.array(*(F.col("at_" + c.replace(".", "_")) for c in names)))
    return wide.withColumn("mean", F.round(F.aggregate(got, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(got), F.lit(0)), 6))


def sample_statistics(samples: DataFrame, by: str) -> DataFrame:
    """By group of samples (documents, context_relevance): their number, the mean length of their joined documents and number of these, and the share whose relevance is known."""
    joined = F.length(F.array_join("documents", " "))
    known = (F.col("context_relevance") != 0.5).cast("double")
    return samples.groupBy(by).agg(F.count("*").alias("num_samples"), F.round(F.avg(joined), 6).alias("avg_doc_length"), F.round(F.avg(F.size("documents")), 6).alias("avg_num_docs"), F.round(F.avg(known), 6).alias("has_relevance_scores"))


def oversize(chunks: DataFrame, limit: int = 20_000, overhead: int = 100) -> DataFrame:
    """The chunks whose request would be longer than the limit, with its length."""
    return chunks.withColumn("request_chars", F.length("text") + overhead).where(F.col("request_chars") > limit)
