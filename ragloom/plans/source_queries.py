"""Queries of sources, sample fields, prompts, model calls and results over the given tables, each with its SQL.

What a source or sink does is shown by a round trip: a table is written in the shared folder as the library writes it, and read back as the
library reads it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import judge_json, prompts, samples, text
from ragloom.functions.sql import register
from ragloom.operators import chunking, sampling
from ragloom.operators.embedding import HashingEmbedder, embedded, index_chunks, not_indexed
from ragloom.plans import ability, compare, queries, registry
from ragloom.plans.evaluation import config_id
from ragloom.plans.models import asked
from ragloom.plans.runs import Run
from ragloom.sources import loaders, results
from ragloom.sources.shared import new_path
from ragloom.streaming.progress import current_progress, track_progress

query, table, documents = queries.query, queries.table, queries.documents


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, and the texts of its turns as documents."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda x: x["text"]).alias("documents"))


_DS = "d AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS ds FROM conversations GROUP BY conv_id)"
_BLANK = r"regexp_replace(x, '\s', '', 'g') <> ''"


@query(f"""WITH {_DS}, u AS (SELECT *, list_filter(ds, lambda x: {_BLANK}) AS us FROM d)
SELECT conv_id, CAST(len(us) AS INTEGER) AS n_usable, md5(array_to_string(us, chr(10) || chr(10))) AS corpus_md5, CASE WHEN conv_id % 2 = 0 THEN ds[1] ELSE 'gold' END AS truth,
CASE WHEN conv_id % 3 = 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS relevance, CASE WHEN conv_id % 4 = 0 THEN 0.0 WHEN conv_id % 4 = 1 THEN 0.75 ELSE 1.0 END::DOUBLE AS adherence,
CASE WHEN conv_id % 5 = 0 THEN 'chat_' || conv_id ELSE 'q' || conv_id END AS id, lpad(CAST(conv_id % 1000 AS VARCHAR), 3, '0') || '_c' AS name, 'noise|m|' || CAST((conv_id % 10 / 10.0)::DOUBLE AS VARCHAR) AS key,
substr(md5('m_' || len(ds) || '_' || substr(ds[1], 1, 30)), 1, 8) AS collection, substr(array_to_string(us[:2], ' '), 1, 500) AS preview FROM u""")
def sample_fields(spark, sf_dir):
    """Conversations as samples of changing shapes, and every field that scripts ask of them."""
    rows = _conversations(spark, sf_dir)
    first, c = F.get("documents", F.lit(0)), F.col("conv_id")
    shape = F.struct(
        "documents", F.when(c % 5 != 0, F.concat(F.lit("q"), c.cast("string"))).alias("qid"), F.when(c % 2 == 0, first).otherwise("").alias("response"), F.lit("gold").alias("ground_truth"),
        F.when(c % 3 == 0, 0.25).alias("relevance_score"), F.when(c % 4 == 1, 0.75).alias("adherence_score"), F.when(c % 4 == 0, False).alias("adherence"),
    )
    record = F.parse_json(F.to_json(shape))
    rows = rows.select("conv_id", record.alias("r")).withColumn("d", loaders.documents_of(F.col("r"))).withColumn("u", samples.usable_documents(F.col("d"))).withColumn("t", samples.ground_truth_scores(F.col("r")))
    return rows.select(
        "conv_id", F.size("u").alias("n_usable"), F.md5(samples.joined_documents(F.col("u"))).alias("corpus_md5"), samples.ground_truth_answer(F.col("r")).alias("truth"), F.col("t.relevance").alias("relevance"), F.col("t.adherence").alias("adherence"),
        samples.dataset_id(F.col("r"), F.lit("chat"), c).alias("id"), samples.numbered_name((c % 1000).cast("int"), F.lit("c")).alias("name"), samples.evaluation_key(F.lit("noise"), F.lit("m"), (c % 10 / 10.0).cast("double")).alias("key"),
        samples.collection_id(F.lit("m"), F.col("d")).alias("collection"), samples.context_preview(F.col("u")).alias("preview"),
    )


def _filled(template: str, **values: str) -> str:
    """A template as SQL that concatenates its parts."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    out = quote(template)
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return out


_KEYED = f"array_to_string(flatten(list_transform(range(1, len(ds) + 1), lambda i: list_transform(range(1, len({queries._judge_sentences('ds[i]')}) + 1), lambda j: (i - 1) || chr(CAST(96 + j AS INTEGER)) || '. ' || ({queries._judge_sentences('ds[i]')})[j]))), chr(10))"
_SAID = f"array_to_string(list_transform(range(1, len({queries._judge_sentences('ds[-1]')}) + 1), lambda j: chr(CAST(96 + j AS INTEGER)) || '. ' || ({queries._judge_sentences('ds[-1]')})[j]), chr(10))"
_CONTEXT = "coalesce(nullif(array_to_string(ds[2:3], chr(10) || chr(10)), ''), substr(ds[1], 1, 2000))"


@query(f"""WITH {_DS}, k AS (SELECT conv_id, ds, {_KEYED} AS keyed, {_SAID} AS said, {_CONTEXT} AS context FROM d)
SELECT conv_id, md5(keyed) AS keyed_md5, md5({_filled(prompts.JUDGE_TEMPLATE, question='ds[1]', documents='keyed', answer='said')}) AS judge_md5,
md5('Answer the question based on the provided context.' || chr(10) || chr(10) || 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || ds[1] || chr(10) || chr(10) || 'Answer:') AS answer_md5,
md5({_filled(prompts.SYSTEM_PROMPT)} || chr(0) || 'Context Documents:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || ds[1]) AS messages_md5, len(context) + len(ds[1]) > 400 AS too_long FROM k""")
def prompts_of_conversations(spark, sf_dir):
    """What a judge, an evaluation and a generator are asked about each conversation: its first turn is the question, the last the answer."""
    rows = _conversations(spark, sf_dir).withColumn("question", F.get("documents", F.lit(0)))
    keyed = text.keyed_documents(F.col("documents"))
    context = prompts.joined_context(F.slice("documents", 2, 2), F.col("question"))
    rows = rows.select("conv_id", "question", keyed.alias("keyed"), text.keyed_response(F.element_at("documents", -1)).alias("said"), context.alias("context"))
    told = prompts.messages(F.col("question"), F.col("context"))
    return rows.select(
        "conv_id", F.md5("keyed").alias("keyed_md5"), F.md5(prompts.judge_prompt(F.col("keyed"), F.col("question"), F.col("said"))).alias("judge_md5"), F.md5(prompts.answer_prompt(F.col("context"), F.col("question"))).alias("answer_md5"),
        F.md5(F.array_join(F.transform(told, lambda m: m["content"]), "\x00")).alias("messages_md5"), prompts.too_long(F.col("context"), F.col("question"), 400).alias("too_long"),
    )


@query(f"""WITH {queries._WINDOWS} SELECT doc_id, chunk_id, start_sentence, end_sentence, md5(text) AS text_md5, CAST(len({queries._TOKENS.format('text')}) AS INTEGER) AS n_tokens FROM chunks""")
def sql_chunks(spark, sf_dir):
    """Sentence windows and their tokens from Spark SQL alone: a table function over the documents, a scalar function on its rows."""
    register(spark)
    documents(spark, sf_dir).createOrReplaceTempView("ragloom_documents")
    return spark.sql("SELECT doc_id, chunk_id, start_sentence, end_sentence, md5(text) AS text_md5, size(content_tokens(text)) AS n_tokens FROM sentence_chunks(TABLE(SELECT doc_id, text FROM ragloom_documents), 5, 2)")


@query(r"""SELECT event_id, regexp_replace('a\_b \n ' || props || '\\\q\"' || chr(92) || event_id, '(\\[nrtbf\"\\/u])|\\(.)', '\1\2', 'gs') AS repaired FROM events""")
def escape_repairs(spark, sf_dir):
    """Texts with right and wrong escapes."""
    said = F.concat(F.lit(r"a\_b \n "), "props", F.lit(r'\\\q\"' + "\\"), F.col("event_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", judge_json.repaired_escapes(said).alias("repaired"))


_PICK = "list_transform(list_sort(list_transform(range(1, len({0}) + 1), lambda i: struct_pack(h := md5(concat_ws('|', '42', CAST(conv_id AS VARCHAR), '{1}', CAST(i - 1 AS VARCHAR))), d := {0}[i])))[:{2}], lambda s: s)"
_MIXED = "list_transform(list_sort(list_concat(" + _PICK.format("neg", "negative", "{0}") + ", " + _PICK.format("pos", "positive", "{1}") + ")), lambda s: s.d)"


@query(f"""WITH r AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) FILTER (role = 'assistant') AS p, list(coalesce(text, '') ORDER BY turn) FILTER (role = 'user') AS n FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, coalesce(p, []) AS pos, coalesce(n, []) AS neg FROM r)
SELECT conv_id, array_to_string({_MIXED.format(5, 0)}, '|') AS negatives, array_to_string({_MIXED.format(2, 3)}, '|') AS integration, array_to_string(CASE WHEN conv_id % 2 = 0 AND len(neg) > 0 THEN neg ELSE pos END[:5], '|') AS counterfactual FROM c""")
def ability_documents(spark, sf_dir):
    """The documents of rejection, integration and counterfactual questions, of conversations as records: answers are positive, questions negative."""
    said = table(spark, sf_dir, "conversations")
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))), lambda x: x["text"])
    rows = said.groupBy(F.col("conv_id").alias("id")).agg(of("assistant").alias("positive"), of("user").alias("negative"))
    # half of the positives are a list in the list
    nested = F.when(F.size("positive") > 0, F.concat(F.lit("["), F.to_json("positive"), F.lit("]"))).otherwise("[]")
    record = F.parse_json(F.concat(F.lit('{"positive":'), nested, F.lit(',"negative":'), F.to_json("negative"), F.lit("}")))
    wrong = rows.withColumn("positive_wrong", F.when(F.col("id") % 2 == 0, F.col("negative")))
    joined = lambda df, name: df.select(F.col("id").alias("conv_id"), F.array_join("documents", "|").alias(name))
    out = joined(sampling.negatives_only(rows), "negatives").join(joined(ability.integration_documents(rows.select("id", record.alias("record")), 0.4), "integration"), "conv_id")
    return out.join(joined(sampling.counterfactual(wrong), "counterfactual"), "conv_id")


@query("SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS line, doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def json_lines_round_trip(spark, sf_dir):
    """Documents as one JSON-lines file of several parts, read with the number of each line."""
    path = new_path(spark, "lines")
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    rows.orderBy("doc_id").coalesce(1).select(F.to_json(F.struct("doc_id", "text"))).write.text(path)  # one file is what is read in parts
    back = loaders.load_json_lines(spark, path, with_line=True)
    return back.select(F.col("id").alias("line"), F.variant_get("record", "$.doc_id", "bigint").alias("doc_id"), F.md5(F.variant_get("record", "$.text", "string")).alias("text_md5"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'finqa' ELSE 'cuad' END AS domain, source FROM documents")
def domain_round_trip(spark, sf_dir):
    """Documents as the sets of two domains, partitioned by domain and split, read by name; a third domain has nothing."""
    root = new_path(spark, "domains")
    table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 2 == 0, "finqa").otherwise("cuad").alias("domain"), F.lit("test").alias("split")).write.partitionBy("domain", "split").parquet(root)
    known = loaders.available(spark, root).where("known").select("domain")
    both = loaders.load_finqa(spark, root).unionByName(loaders.load_cuad(spark, root)).unionByName(loaders.load_covidqa(spark, root))
    return loaders.load_domains(spark, root).join(known, "domain", "left_semi").select("doc_id", "domain", "source").intersectAll(both.select("doc_id", "domain", "source"))


@query("SELECT doc_id, source AS config, false AS second FROM documents JOIN labels USING (doc_id) UNION ALL SELECT doc_id, source, true FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def results_resume(spark, sf_dir):
    """Results appended in two runs: the second brings all rows again, and those that are known are left out."""
    path = new_path(spark, "results")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("config"), F.col("doc_id").alias("dataset_id"))
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("dataset_id")).distinct()
    loaders.append_results(rows.join(done, "dataset_id", "left_semi").withColumn("second", F.lit(False)), path)
    loaders.append_results(rows.withColumn("second", F.lit(True)), path)
    return spark.read.parquet(path).select(F.col("dataset_id").alias("doc_id"), "config", "second")


@query("SELECT conv_id, CAST(count(*) AS INTEGER) AS n_documents, md5(string_agg(coalesce(text, ''), '|' ORDER BY turn)) AS texts_md5 FROM conversations GROUP BY conv_id")
def sample_cache(spark, sf_dir):
    """Samples through a domain's cache."""
    folder = new_path(spark, "samples")
    rows = _conversations(spark, sf_dir)
    results.save_samples(rows, folder, "chat")
    back = results.cached_samples(spark, folder, "chat", "conv_id long, documents array<string>")
    return back.select("conv_id", F.size("documents").alias("n_documents"), F.md5(F.array_join("documents", "|")).alias("texts_md5"))


@query(f"SELECT source AS config, n, n_valid, avg_trace FROM ({queries._CONFIGS})")
def results_files(spark, sf_dir):
    """Configuration results written as the latest and, beside another table, as a comparison, and read back from both."""
    folder = new_path(spark, "ranked")
    rows = queries._configs(spark, sf_dir).withColumnRenamed("source", "config")
    results.write_ranked(rows, folder, "1")
    results.write_comparison({"configs": rows, "none": rows.limit(0)}, f"{folder}/comparison")
    latest = spark.read.schema(rows.schema).json(f"{folder}/results_latest")
    compared = spark.read.parquet(f"{folder}/comparison").where("part = 'configs'").select(F.from_json("row", rows.schema).alias("r")).select("r.*")
    return latest.intersectAll(compared)


@query(f"""WITH {queries._WINDOWS}, docs AS (SELECT doc_id || '_' || chunk_id AS chunk_id, {queries._TOKENS.format('text')} AS ts FROM chunks)
SELECT chunk_id, CAST(len(list_distinct(ts)) > 0 AS BOOLEAN) AS has_vector, true AS held FROM docs""")
def chunk_vectors(spark, sf_dir):
    """Chunks in a table of vectors that is begun with some and completed by the rest."""
    path = new_path(spark, "vectors")
    chunks = chunking.sentence_chunks(documents(spark, sf_dir)).select(F.concat_ws("_", "doc_id", "chunk_id").alias("chunk_id"), "chunk_id", "text").toDF("chunk_id", "at", "text")
    index_chunks(chunks.where("at = 0"), path, HashingEmbedder())
    index_chunks(chunks, path, HashingEmbedder())
    left = not_indexed(chunks, spark.read.parquet(path)).select("chunk_id", F.lit(False).alias("held"))
    held = spark.read.parquet(path).join(left, "chunk_id", "left")
    asks = embedded(chunks.select("chunk_id", "text"), "text", HashingEmbedder(), "again")
    same = held.join(asks.select("chunk_id", "again"), "chunk_id").where(F.col("vector") == F.col("again"))
    # tokens may cancel each other out in a vector, so that it is asked of tokens whether there is one
    return same.select("chunk_id", (F.size(text.content_tokens(F.col("text"))) > 0).alias("has_vector"), F.coalesce("held", F.lit(True)).alias("held"))


class Echoing:
    """A stand-in for a client: the prompt's last forty characters; a prompt without the letter e is an error."""

    def answer(self, prompts: list[str]) -> list[str]:
        if any("e" not in p for p in prompts):
            raise ValueError("no e")
        return [f"Said: {p[-40:]}" for p in prompts]


@query("SELECT conv_id, turn, CASE WHEN contains(text, 'e') THEN 'Said: ' || right(text, 40) END AS response, CASE WHEN NOT contains(text, 'e') THEN 'ValueError: no e' END AS error FROM conversations")
def model_answers(spark, sf_dir):
    """Every turn asked of a client that fails on some, in batches."""
    rows = asked(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "text", Echoing(), tries=1)
    return rows.select("conv_id", "turn", "response", "error")


@query(f"""WITH d AS (SELECT source, lang, quality, count(*) AS n FROM ({queries._RESULTS}) GROUP BY ALL), c AS (SELECT 'sparse_' || lang || '_' || source || '_' || CASE quality WHEN 1 THEN 'compound' ELSE 'model' END AS config_id, n FROM d)
SELECT config_id, CASE WHEN ends_with(config_id, 'compound') THEN 'groq/compound' ELSE 'model' END AS model, n FROM c""")
def configured_models(spark, sf_dir):
    """Results by configuration, named as grids name them, with the full ids of their models."""
    rows = queries._results(spark, sf_dir).select(F.lit("sparse").alias("config_type"), F.col("lang").alias("chunking"), F.col("source").alias("method"), F.when(F.col("quality") == 1, "compound").otherwise("own/model").alias("llm"))
    named = registry.with_models(rows).withColumn("config_id", config_id())
    return named.groupBy("config_id", F.when(F.col("model") == "own/model", "model").otherwise(F.col("model")).alias("model")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT lang AS domain, lang || source AS config, source AS method, quality AS llm FROM ({queries._RESULTS}))
SELECT domain, count(*) AS configs, count(DISTINCT method) AS methods, count(DISTINCT llm) AS models, count(*) * 10 AS evaluations FROM c GROUP BY GROUPING SETS ((domain), ())""")
def configuration_counts(spark, sf_dir):
    """How many configurations, methods, models and evaluations each domain has, and all together."""
    return registry.config_counts(queries._results(spark, sf_dir).select(F.col("lang").alias("domain"), F.col("source").alias("method"), F.col("quality").alias("llm")))


@query(f"""WITH r AS ({queries._RESULTS}), e AS (SELECT lang AS k, round(avg(a), 6) AS s FROM r GROUP BY lang), c AS (SELECT source AS k, round(avg(b), 6) AS s FROM r WHERE lang = (SELECT k FROM e ORDER BY s DESC, k LIMIT 1) GROUP BY source),
m AS (SELECT 'q' || quality AS k, round(avg(a * b), 6) AS s FROM r WHERE source = (SELECT k FROM c ORDER BY s DESC, k LIMIT 1) GROUP BY quality)
SELECT (SELECT k FROM e ORDER BY s DESC, k LIMIT 1) AS embedding, (SELECT k FROM c ORDER BY s DESC, k LIMIT 1) AS chunking, (SELECT k FROM m ORDER BY s DESC, k LIMIT 1) AS model, (SELECT max(s) FROM e) AS embedding_score, (SELECT max(s) FROM c) AS chunking_score, (SELECT max(s) FROM m) AS model_score""")
def best_configuration(spark, sf_dir):
    """The greedy best of three phases, each over the results of the best before it."""
    rows = queries._results(spark, sf_dir)
    mean = lambda df, by, name, value, score: df.groupBy(F.col(by).cast("string").alias(name)).agg(F.round(F.avg(value), 6).alias(score))
    best = compare.best_config(
        mean(rows, "lang", "embedding", "computed_relevance", "avg_score"),
        lambda e: mean(rows.where(F.col("lang") == e), "source", "strategy", "computed_utilization", "avg_score"),
        lambda _, c: mean(rows.where(F.col("source") == c).withColumn("q", F.concat(F.lit("q"), "quality")), "q", "model", "computed_completeness", "avg_similarity"),
    )
    return spark.createDataFrame([(best.embedding, best.chunking, best.model, *best.scores)], "embedding string, chunking string, model string, embedding_score double, chunking_score double, model_score double")


@query(f"""WITH p AS (SELECT r.*, row_number() OVER (PARTITION BY source ORDER BY {queries._h('source', 'doc_id')}, doc_id) AS place FROM ({queries._RESULTS}) r),
v AS (SELECT source, doc_id, place, row_number() OVER (PARTITION BY source ORDER BY place) AS used FROM p WHERE place <= 30 AND toxic = 0 AND (a + b) / 2 >= 0.3)
SELECT source, doc_id, CAST(place AS INTEGER) AS place, CAST(used AS INTEGER) AS used FROM v WHERE used <= 10""")
def evaluation_run(spark, sf_dir):
    """A run over each source's pool: what fails or scores too little is retried, then replaced by backups until ten are right."""
    pool = sampling.pool(queries._results(spark, sf_dir), "source", "doc_id", 10)
    score = ((F.col("computed_relevance") + F.col("computed_utilization")) / 2).alias("trace")
    evaluate = lambda rows: rows.select("source", "doc_id", "place", "is_valid", F.lit(None).cast("string").alias("error"), score)
    return Run(pool, evaluate, new_path(spark, "run"), "source", "doc_id", 10, least=0.3).finish().select("source", "doc_id", "place", "used")


@query(f"""WITH r AS ({queries._RESULTS}) SELECT source AS config, count(*) AS next_idx, 0::BIGINT AS early, count(*) AS n, count(*) FILTER (toxic = 0) AS n_valid, round(avg(a) FILTER (toxic = 0), 6) AS avg_trace FROM r GROUP BY source""")
def streamed_progress(spark, sf_dir):
    """Results as they arrive in files, followed by a stream with state for each configuration."""
    folder = new_path(spark, "stream")
    rows = queries._results(spark, sf_dir).select(F.col("source").alias("config"), "doc_id", "is_valid", F.col("computed_relevance").cast("double").alias("trace"))
    placed = queries.running_before(rows.withColumn("one", F.lit(1)), ["config"], "doc_id", "one", "idx")
    placed.select("config", F.col("idx").cast("long").alias("idx"), "is_valid", "trace").repartition(3, "idx").write.parquet(f"{folder}/results")
    track_progress(spark, f"{folder}/results", f"{folder}/progress", f"{folder}/checkpoint", files=1).awaitTermination()
    return current_progress(spark, f"{folder}/progress")
