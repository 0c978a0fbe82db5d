"""Fields of samples and results that scripts ask for, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragloom.sources.loaders import field

# Candidate names, the first wins.
ID_NAMES = ("id", "idx", "example_id", "qid", "question_id", "index")
ANSWER_NAMES = ("response", "answer", "ground_truth", "expected_answer", "gold_answer", "reference")
TRUTH_NAMES = {"relevance": ("context_relevance", "relevance_score"), "utilization": ("context_utilization", "utilization_score"), "completeness": ("completeness_score", "completeness")}
EVALUATION_WORDS = ("relevance", "utilization", "completeness", "adherence", "supported", "score", "faithfulness")


def usable_documents(documents: Column) -> Column:
    """The documents of an example that are texts and not blank."""
    return F.filter(documents, lambda d: d.isNotNull() & (F.regexp_replace(d, r"\s", "") != ""))


def joined_documents(documents: Column, separator: str = "\n\n") -> Column:
    """All documents as one corpus text."""
    return F.array_join(F.coalesce(documents, F.array().cast("array<string>")), separator)


def ground_truth_answer(original: Column, sample: Column | None = None) -> Column:
    """The first of the answer's names that holds something, in the VARIANT original, then in the VARIANT sample; else empty."""
    tries = [field(original, ANSWER_NAMES), *([field(sample, ANSWER_NAMES)] if sample is not None else []), F.lit("")]
    return F.coalesce(*tries)


def ground_truth_scores(record: Column) -> Column:
    """Struct relevance, utilization, completeness (0.5 where absent) and adherence of a VARIANT sample.

    Adherence is adherence_score, or else 1 if adherence is absent or holds something, and 0 if not.
    """
    number = lambda n: F.try_variant_get(record, f"$.{n}", "double")
    parts = [F.coalesce(*(number(n) for n in names), F.lit(0.5)).alias(k) for k, names in TRUTH_NAMES.items()]
    absent = F.variant_get(record, "$.adherence", "variant").isNull()
    truth = F.when(absent | field(record, ("adherence",)).isNotNull(), 1.0).otherwise(0.0)
    return F.struct(*parts, F.coalesce(number("adherence_score"), truth).alias("adherence"))


def dataset_id(record: Column, domain: Column, at: Column, holding: bool = False) -> Column:
    """The first of the id's names that a VARIANT sample has (holding: that holds something); else domain and place."""
    found = field(record, ID_NAMES) if holding else F.coalesce(*(F.try_variant_get(record, f"$.{n}", "string") for n in ID_NAMES))
    return F.coalesce(found, F.concat_ws("_", domain, at.cast("string")))


def numbered_name(at: Column, config: Column, digits: int = 3) -> Column:
    """The name of a configuration's file: its number, filled up with zeros, and its id."""
    return F.concat_ws("_", F.format_string(f"%0{digits}d", at), config)


def evaluation_key(ability: Column, model: Column, noise_ratio: Column | None = None) -> Column:
    """ability|model|ratio; without a ratio the first two."""
    return F.concat_ws("|", ability, model, *([noise_ratio.cast("string")] if noise_ratio is not None else []))


def collection_id(model: Column, documents: Column) -> Column:
    """The first 8 hex digits of the md5 of a model's name, the number of documents and the beginning of the first, joined by underscores."""
    first = F.substring(F.coalesce(F.get(documents, F.lit(0)), F.lit("")), 1, 30)
    return F.substring(F.md5(F.concat_ws("_", model, F.size(documents).cast("string"), first)), 1, 8)


def context_preview(chunks: Column, most: int = 500) -> Column:
    """The first two chunks, cut."""
    return F.substring(F.array_join(F.slice(chunks, 1, 2), " "), 1, most)


def evaluation_columns(columns: list[str]) -> list[str]:
    """The columns whose name has to do with evaluation."""
    return [c for c in columns if any(w in c.lower() for w in EVALUATION_WORDS)]
