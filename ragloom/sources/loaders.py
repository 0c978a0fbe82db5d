"""Reading question-answering sets in whatever shape they come, and result tables."""

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.operators.ordering import running_before

#: The domains that are known by name.
DOMAINS = ("finqa", "cuad", "delucionqa", "hotpotqa", "covidqa")
DOMAIN_INFO = {
    "finqa": ("Finance", "Financial question answering from earnings reports and SEC filings"),
    "cuad": ("Legal", "Contract Understanding Atticus Dataset - legal clause extraction"),
    "delucionqa": ("Customer Support", "Technical customer support Q&A from IT domain"),
    "hotpotqa": ("General Knowledge", "Multi-hop reasoning questions from Wikipedia"),
    "covidqa": ("Biomedical", "COVID-19 biomedical research questions"),
}
#: Candidate names of a field, the first that holds something wins.
ALIASES = {"id": ("id", "idx", "example_id"), "question": ("question", "query"), "response": ("response", "answer")}
DOCUMENT_ALIASES = ("documents", "context", "contexts", "retrieved_contexts")
SCORE_ALIASES = {"context_relevance": ("context_relevance", "relevance_score"), "context_utilization": ("context_utilization", "utilization_score"), "completeness": ("completeness", "completeness_score")}

#: The first of these that is there.
ADHERENCE_ALIASES = ("adherence", "adherence_score", "faithfulness")


def domains(spark: SparkSession) -> DataFrame:
    """key, name, description and subset of the domains that are known."""
    return spark.createDataFrame([(d, *DOMAIN_INFO[d], d) for d in DOMAINS], "key string, name string, description string, subset string")


def domain_info(spark: SparkSession, domain: str) -> dict:
    """The known fields of a domain; an error for any other."""
    if domain not in DOMAINS:
        raise ValueError(f"unknown domain {domain}: choose from {', '.join(DOMAINS)}")
    return domains(spark).where(F.col("key") == domain).first().asDict()


def available(spark: SparkSession, root: str) -> DataFrame:
    """The domains and splits that a folder partitioned by them has, and whether they are known by name."""
    return spark.read.parquet(root).select("domain", "split").distinct().withColumn("known", F.col("domain").isin(*DOMAINS))


def load_domain(spark: SparkSession, root: str, domain: str, split: str = "test") -> DataFrame:
    """A domain's Parquet rows, from a folder partitioned by domain and split."""
    if domain not in DOMAINS:
        raise ValueError(f"unknown domain {domain}: choose from {', '.join(DOMAINS)}")
    return spark.read.parquet(root).where((F.col("domain") == domain) & (F.col("split") == split))


def load_domains(spark: SparkSession, root: str, split: str = "test", names: tuple[str, ...] = DOMAINS) -> DataFrame:
    """All rows of the named domains that the folder has, in one table; domains that it lacks give no rows."""
    return spark.read.parquet(root).where(F.col("domain").isin(*names) & (F.col("split") == split))


load_finqa, load_cuad, load_delucionqa, load_hotpotqa, load_covidqa = (partial(load_domain, domain=d) for d in DOMAINS)


#: The files of the three ability sets.
ABILITY_FILES = {"refine": "en_refine.json", "integration": "en_int.json", "fact": "en_fact.json"}


def load_abilities(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The ability sets of a folder by name, each with id, the line number, and record."""
    return {name: load_json_lines(spark, f"{folder}/{file}", with_line=True) for name, file in ABILITY_FILES.items()}


def load_json_lines(spark: SparkSession, path: str, with_line: bool = False) -> DataFrame:
    """Records of a JSON-lines file as VARIANT; with_line adds id, the physical line number from 0 (blank lines count, but give no record)."""
    if not with_line:
        return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("record"))
    # a line's number is its place in its part of the file and the lines of the parts before
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"))
    placed = lines.withColumn("place", F.row_number().over(Window.partitionBy("file", "part").orderBy("at")) - 1)
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lines.groupBy("file", "part").agg(F.count("*").alias("n")).select("file", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    found = placed.join(ahead, ["file", "part"]).where(F.trim("value") != "")
    return found.select((F.col("ahead") + F.col("place")).cast("long").alias("id"), F.parse_json("value").alias("record"))


def _holds_something(record: Column, name: str) -> Column:
    """Whether a VARIANT record has a value of this name that is not null, empty, 0 or false; the texts "0" and "false" are something."""
    value = F.variant_get(record, f"$.{name}", "variant")
    kind, text = F.schema_of_variant(value), F.try_variant_get(record, f"$.{name}", "string")
    number = F.coalesce(text.try_cast("double"), F.lit(1.0)) != 0
    return F.coalesce(
        F.when(kind == "STRING", text != "").when(kind == "BOOLEAN", text == "true").when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), ~text.isin("[]", "{}")).otherwise(number) & text.isNotNull(),
        F.lit(False),
    )


def field(record: Column, names: tuple[str, ...], kind: str = "string") -> Column:
    """The first of the names that a VARIANT record holds with something in it: not null, empty, 0 or false."""
    text = F.coalesce(*(F.when(_holds_something(record, n), F.try_variant_get(record, f"$.{n}", "string")) for n in names))
    return text if kind == "string" else text.cast(kind)


def present(record: Column, names: tuple[str, ...], kind: str, default) -> Column:
    """The first of the names that a VARIANT record has, whatever it holds; `default` where none has a value."""
    return F.coalesce(*(F.try_variant_get(record, f"$.{n}", kind) for n in names), F.lit(default))


def documents_of(record: Column) -> Column:
    """Array of documents: a text, texts, texts nested once, or objects with text or content."""

    def of(name: str) -> Column:
        v = F.variant_get(record, f"$.{name}", "variant")
        text = F.try_variant_get(v, "$", "string")
        items = F.try_variant_get(v, "$", "array<variant>")
        nested = F.flatten(F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))))
        texts = F.transform(nested, lambda x: F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$.content", "string"), F.try_variant_get(x, "$", "string")))
        return F.when(items.isNotNull() & (F.size(items) > 0), texts).when(text.isNotNull() & (text != "") & items.isNull(), F.array(text))

    return F.coalesce(*(of(n) for n in DOCUMENT_ALIASES), F.array().cast("array<string>"))


def adherence_of(record: Column, names: tuple[str, ...] = ADHERENCE_ALIASES) -> Column:
    """Of the first name that is there: 1 if null; booleans and numbers as they are; texts 1 for true, yes and 1, else 0. 1 where no name is there."""

    def of(name: str) -> Column:
        value = F.variant_get(record, f"$.{name}", "variant")
        kind, text = F.schema_of_variant(value), F.try_variant_get(record, f"$.{name}", "string")
        plain = F.when(text.isNull(), 1.0).when(kind == "STRING", F.lower(text).isin("true", "yes", "1").cast("double")).when(kind == "BOOLEAN", (text == "true").cast("double"))
        return F.when(value.isNotNull(), plain.otherwise(F.coalesce(text.try_cast("double"), F.lit(1.0))))

    return F.coalesce(*(of(n) for n in names), F.lit(1.0))


def standardized(records: DataFrame, domain: Column, order: str) -> DataFrame:
    """Samples of one schema from VARIANT records (column record); a missing id becomes domain and place by `order`, a unique number, from 0."""
    r = F.col("record")
    own = running_before(records.withColumn("_domain", domain).withColumn("_one", F.lit(1)), ["_domain"], order, "_one", "_at")
    own = own.withColumn("_id", F.concat_ws("_", "_domain", F.col("_at").cast("string")))
    scores = [present(r, names, "double", 0.5).alias(s) for s, names in SCORE_ALIASES.items()]
    return own.select(
        F.coalesce(field(r, ALIASES["id"]), F.col("_id")).alias("id"), F.coalesce(field(r, ALIASES["question"]), F.lit("")).alias("question"),
        documents_of(r).alias("documents"), F.coalesce(field(r, ALIASES["response"]), F.try_variant_get(r, "$.answers[0]", "string"), F.lit("")).alias("response"),
        *scores, adherence_of(r).alias("adherence"), r.alias("original"), F.col("_domain").alias("domain"),
    )


def checkpoint_files(spark: SparkSession, pattern: str) -> DataFrame:
    """A row for each checkpoint file: config (the file's name without its number), completed, results and skipped_samples, as far as files have them."""
    files = spark.read.option("multiLine", True).json(pattern)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    config = F.regexp_replace(F.regexp_replace(name, r"\.json$", ""), "^[0-9]{2,3}_", "")
    return files.select(config.alias("config"), *(c for c in ("completed", "results", "skipped_samples") if c in files.columns))


def checkpoints(spark: SparkSession, pattern: str) -> DataFrame:
    """Result rows of checkpoint files {completed, results, skipped_samples}, with config."""
    return checkpoint_files(spark, pattern).select("config", F.explode_outer("results").alias("r")).select("config", "r.*")


def skipped_samples(spark: SparkSession, pattern: str) -> DataFrame:
    """config and sample of every skipped sample of checkpoint files."""
    return checkpoint_files(spark, pattern).select("config", F.explode("skipped_samples").alias("sample"))


def completed_configs(spark: SparkSession, pattern: str, expected: int = 10) -> DataFrame:
    """config and n of the checkpoint files with at least `expected` results."""
    return checkpoint_files(spark, pattern).select("config", F.size(F.coalesce("results", F.array())).alias("n")).where(F.col("n") >= expected)


def append_results(results: DataFrame, path: str, keys: tuple[str, ...] = ("config", "dataset_id")) -> DataFrame:
    """Append the rows whose keys the table at path does not hold yet, and return what was appended."""
    spark = results.sparkSession
    try:
        held = spark.read.parquet(path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new = results
    else:
        new = results.join(held, list(keys), "left_anti")
    new = new.dropDuplicates(list(keys))
    new.write.mode("append").partitionBy(keys[0]).parquet(path)
    return new
