"""Reading a judge model's JSON, also where it is fenced, wrapped in text, badly escaped or broken."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of a judgement's fields, and the shapes of keys and of broken JSON.
SCHEMA = (
    "struct<relevance_explanation:string,all_relevant_sentence_keys:array<string>,overall_supported_explanation:string,overall_supported:boolean,"
    "sentence_support_information:array<struct<response_sentence_key:string,explanation:string,supporting_sentence_keys:array<string>,fully_supported:boolean>>,"
    "all_utilized_sentence_keys:array<string>>"
)


def outermost_object(text: Column) -> Column:
    """From the first opening to the last closing brace; the text itself if there is no such pair."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found == "", text).otherwise(found)


def repaired_escapes(text: Column) -> Column:
    """Backslashes before anything but a JSON escape are dropped, pairs read from the left."""
    return F.regexp_replace(text, r"""(?s)(\\[nrtbf"\\/u])|\\(.)""", "$1$2")


def unfenced(text: Column) -> Column:
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^```(json)?", ""), r"```$|^\s+|\s+$", "")


def parsed_judgement(text: Column) -> Column:
    """Struct of SCHEMA: parsed directly, else the outermost object, else with repaired escapes, else single fields by pattern."""
    clean = unfenced(F.coalesce(text, F.lit("")))
    whole = outermost_object(clean)
    tries = [F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), F.from_json(t, SCHEMA)) for t in (clean, whole, repaired_escapes(whole))]
    got = F.coalesce(*tries, fallback_fields(clean))
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(got["relevance_explanation"], F.lit("")).alias("relevance_explanation"),
        F.coalesce(got["all_relevant_sentence_keys"], none).alias("all_relevant_sentence_keys"),
        F.coalesce(got["overall_supported_explanation"], F.lit("")).alias("overall_supported_explanation"),
        F.coalesce(got["overall_supported"], F.lit(False)).alias("overall_supported"),
        got["sentence_support_information"].alias("sentence_support_information"),
        F.coalesce(got["all_utilized_sentence_keys"], none).alias("all_utilized_sentence_keys"),
    )


def fallback_fields(text: Column) -> Column:
    def keys(field: str) -> Column:
        listed = F.regexp_extract(text, rf'(?s)"{field}"\s*:\s*\[(.*?)\]', 1)
        return F.regexp_extract_all(listed, F.lit(r'"(\d+[a-z])"'), F.lit(1))

    note = F.when(text == "", F.lit("")).otherwise(F.lit("(extracted via fallback)"))
    return F.struct(
        note.alias("relevance_explanation"), keys("all_relevant_sentence_keys").alias("all_relevant_sentence_keys"), note.alias("overall_supported_explanation"),
        F.lower(text).rlike(r'"overall_supported": ?true').alias("overall_supported"),
        F.lit(None).cast("array<struct<response_sentence_key:string,explanation:string,supporting_sentence_keys:array<string>,fully_supported:boolean>>").alias("sentence_support_information"),
        keys("all_utilized_sentence_keys").alias("all_utilized_sentence_keys"),
    ).cast(SCHEMA)
