"""Abilities of answer models: robustness to noise, rejection, integration and robustness to wrong documents, from recorded answers."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.functions.prompts import bare_prompt, documents_prompt
from ragloom.functions.text import contains_answer, detects_error, is_rejection
from ragloom.operators.sampling import noise_mix
from ragloom.plans.models import ChatModel, asked

# The abilities, and the measure that models rank by in each.
RANKED_BY = {"noise_robustness": "accuracy", "negative_rejection": "rejection_rate", "information_integration": "accuracy", "counterfactual_robustness": "error_correction"}


def first_records(records: DataFrame, n: int | None) -> DataFrame:
    """The records (id: the line's number from 0) of the first n lines; all without n."""
    return records if not n else records.where(F.col("id") < n)


def flat_positives(record: Column) -> Column:
    """The positive documents of a VARIANT record, those that are nested once taken out of their lists."""
    items = F.try_variant_get(record, "$.positive", "array<variant>")
    parts = F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<string>"), F.array(F.try_variant_get(x, "$", "string"))))
    return F.coalesce(F.flatten(parts), F.array().cast("array<string>"))


def integration_documents(records: DataFrame, ratio: float, many: int = 5, seed: int = 42) -> DataFrame:
    """id and documents of VARIANT records (id, record): noise_mix() of the negatives and the positives taken out of their lists."""
    rows = records.select("id", flat_positives(F.col("record")).alias("positive"), F.try_variant_get("record", "$.negative", "array<string>").alias("negative"))
    return noise_mix(rows, ratio, many, seed)


def with_prompts(rows: DataFrame) -> DataFrame:
    """rows (question, documents) with the prompts that ask with documents and without."""
    return rows.withColumn("prompt", documents_prompt(F.col("documents"), F.col("question"))).withColumn("bare_prompt", bare_prompt(F.col("question")))


def asked_both(rows: DataFrame, model: ChatModel, **how) -> DataFrame:
    """rows (question, documents, ...) with the model's response with the documents, response_no_docs without, and error, if either call had one."""
    said = asked(with_prompts(rows), "prompt", model, "response", **how).withColumnRenamed("error", "_error")
    bare = asked(said, "bare_prompt", model, "response_no_docs", **how)
    return bare.withColumn("error", F.coalesce("_error", "error")).select(*rows.columns, "response", "response_no_docs", "error")


def ability_run(rows: DataFrame, models: dict[str, ChatModel], **how) -> DataFrame:
    """evaluated() results of models that answer rows (ability, noise_ratio, question, documents, expected); rows whose calls failed count as wrong answers."""
    parts = [asked_both(rows, m, **how).withColumn("model", F.lit(name)) for name, m in models.items()]
    said = reduce(DataFrame.unionByName, parts)
    return evaluated(judged(said.withColumn("response", F.coalesce("response", F.lit(""))).withColumn("response_no_docs", F.coalesce("response_no_docs", F.lit("")))))


def judged(answers: DataFrame, ascii_only: bool = False, normal: Callable[..., Column] = contains_answer) -> DataFrame:
    """Recorded answers (response, response_no_docs, expected: array of answers) with correct, rejected, correct_no_docs, detected and corrected."""
    right = normal(F.col("response"), F.col("expected"), ascii_only)
    rows = answers.withColumn("correct", right).withColumn("rejected", is_rejection(F.col("response")))
    rows = rows.withColumn("correct_no_docs", normal(F.col("response_no_docs"), F.col("expected"), ascii_only)).withColumn("detected", detects_error(F.col("response")))
    return rows.withColumn("corrected", F.col("detected") & F.col("correct"))


def evaluated(rows: DataFrame) -> DataFrame:
    """ability, model, noise_ratio, total and the percentages of each ability's measures; those of other abilities are null. rows: see judged()."""
    percent = lambda c: 100.0 * F.count_if(F.col(c)) / F.count("*")
    corrected = F.coalesce(100.0 * F.count_if("corrected") / F.nullif(F.count_if("detected"), F.lit(0)), F.lit(0.0))
    of = lambda value, *abilities: F.when(F.col("ability").isin(*abilities), F.round(value, 6))
    wrong = "counterfactual_robustness"
    return rows.groupBy("ability", "model", "noise_ratio").agg(F.count("*").alias("total"), percent("correct").alias("c"), percent("rejected").alias("r"), percent("correct_no_docs").alias("n"), percent("detected").alias("d"), corrected.alias("k")).select(
        "ability", "model", "noise_ratio", "total", of(F.col("c"), "noise_robustness", "information_integration").alias("accuracy"), of(F.col("r"), "negative_rejection").alias("rejection_rate"),
        of(F.col("n"), wrong).alias("acc"), of(F.col("c"), wrong).alias("acc_doc"), of(F.col("d"), wrong).alias("error_detection"), of(F.col("k"), wrong).alias("error_correction"),
    )


def rankings(results: DataFrame) -> DataFrame:
    """ability, model, score and rank: models by the mean of the ability's measure over noise ratios, then by name."""
    measure = F.coalesce(*(F.when(F.col("ability") == a, F.col(m)) for a, m in RANKED_BY.items()))
    scores = results.groupBy("ability", "model").agg(F.round(F.avg(measure), 6).alias("score"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("ability").orderBy(F.desc("score"), "model")))


def best_models(results: DataFrame) -> DataFrame:
    """The first model of each ability."""
    return rankings(results).where("rank = 1").drop("rank")
