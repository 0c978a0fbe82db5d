import json
import time

import pytest
from pyspark.sql import functions as F

from ragloom.functions import prompts, samples
from ragloom.operators import retrieval
from ragloom.operators.ordering import running_before, with_next
from ragloom.plans import ability, compare, registry
from ragloom.plans.evaluation import evaluate_configs
from ragloom.plans.models import asked
from ragloom.sources import loaders, results


def variants(spark, rows):
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "j string").select(F.parse_json("j").alias("r"))


def test_sample_fields(spark):
    rows = [{"qid": 5, "answer": "", "ground_truth": "g", "adherence": 0}, {"id": "", "response": "r", "adherence_score": 0.25, "relevance_score": 0.75}, {"completeness": 0.1, "completeness_score": 0.2, "adherence": None}]
    r, at = F.col("r"), F.lit(3)
    got = variants(spark, rows).select(samples.dataset_id(r, F.lit("d"), at).alias("i"), samples.dataset_id(r, F.lit("d"), at, True).alias("h"), samples.ground_truth_answer(r).alias("a"), samples.ground_truth_scores(r).alias("s")).collect()
    assert [(x.i, x.h, x.a) for x in got] == [("5", "5", "g"), ("", "d_3", "r"), ("d_3", "d_3", "")]
    assert [tuple(x.s) for x in got] == [(0.5, 0.5, 0.5, 0.0), (0.75, 0.5, 0.5, 0.25), (0.5, 0.5, 0.2, 0.0)]


def test_names_and_texts(spark):
    frame = spark.createDataFrame([(["a b", None, " \n", "c"], 7, 0.4, None)], "d array<string>, n int, x double, y double")
    row = frame.select(
        samples.usable_documents(F.col("d")).alias("u"), samples.joined_documents(samples.usable_documents(F.col("d"))).alias("j"), samples.numbered_name(F.col("n"), F.lit("c")).alias("n"),
        samples.evaluation_key(F.lit("a"), F.lit("m"), F.col("x")).alias("k"), samples.evaluation_key(F.lit("a"), F.lit("m"), F.col("y")).alias("l"), samples.context_preview(F.col("d"), 3).alias("p"), samples.collection_id(F.lit("m"), F.col("d")).alias("c"),
    ).first()
    from hashlib import md5

    assert tuple(row) == (["a b", "c"], "a b\n\nc", "007_c", "a|m|0.4", "a|m", "a b", md5(b"m_4_a b").hexdigest()[:8])
    assert samples.evaluation_columns(["id", "Relevance", "x_score", "supported_by"]) == ["Relevance", "x_score", "supported_by"]


def test_prompts_fill_each_place_once(spark):
    frame = spark.createDataFrame([("{question} {answer}", "q", "a")], "d string, q string, a string")
    row = frame.select(prompts.judge_prompt(F.col("d"), F.col("q"), F.col("a"), "D {documents} Q {question} A {answer} {x}").alias("p"), prompts.judge_prompt(F.col("d"), F.col("q"), F.col("a")).alias("j"), prompts.messages(F.col("q"), F.col("d")).alias("m")).first()
    assert row.p == "D {question} {answer} Q q A a {x}" and row.j.count("{question} {answer}") == 1 and all(f in row.j for f in ("all_utilized_sentence_keys:array<string>", "overall_supported:boolean", "supporting_sentence_keys"))
    assert [m.role for m in row.m] == ["system", "user"] and row.m[0].content == prompts.SYSTEM_PROMPT and row.m[1].content == "Context Documents:\n{question} {answer}\n\nQuestion: q"


# classes inside functions travel to workers whole, which can't import the tests


def flaky():
    class Flaky:
        """Fails on whole calls that hold a bad prompt."""

        def answer(self, prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("no")
            return [p.upper() for p in prompts]

    return Flaky()


def test_asked_in_batches(spark):
    frame = spark.createDataFrame([(i, None if i == 3 else f"bad {i}" if i == 7 else f"p{i}") for i in range(20)], "i int, p string")
    got = {r.i: (r.response, r.error) for r in asked(frame, "p", flaky(), batch=5, tries=2).collect()}
    assert got[3] == (None, None) and got[7] == (None, "ValueError: no") and all(got[i] == (f"P{i}", None) for i in range(20) if i not in (3, 7))


def judge():
    class Judge:
        def answer(self, prompts):
            return ['{"all_relevant_sentence_keys": ["0a"], "overall_supported": true, "all_utilized_sentence_keys": ["0a"]}' for p in prompts if "Label the sentences" in p]

    return Judge()


def test_models_and_every_kind_of_configuration(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", f"Planet number{i} has rings. Its moons are cold.") for i in range(8)], "doc_id long, example_id string, text string")
    asks = spark.createDataFrame([(i, f"s{i % 2}", "Which bad moons?" if i == 3 else f"Which planet is number{i}?", "corpus") for i in range(4)], "sample_id long, example_id string, question string, corpus string")
    grid = [("sparse", "none", "bm25"), ("sparse", "sentence", "tfidf"), ("dense", "semantic", "hashed"), ("hybrid", "none", "hashed")]
    got = evaluate_configs(asks, docs, grid, generator=flaky(), judge=judge()).collect()
    assert len(got) == 16 and {r.config for r in got} == {"_".join(g) for g in grid}
    assert all((r.error == "ValueError: no" and not r.is_valid) if r.sample_id == 3 else (r.is_valid and r.computed_adherence == 1.0 and r.generated_response.startswith("ANSWER THE QUESTION")) for r in got)
    best = {(r.config, r.sample_id): r.retrieved_chunks[0] for r in got if r.retrieved_chunks}
    assert all("number2 " in best[("_".join(g), 2)] for g in grid)


def test_registry(spark):
    grids = registry.grids(spark)
    counts = {r.domain: (r.configs, r.evaluations) for r in registry.config_counts(grids).collect()}
    assert counts == {"finqa": (210, 2100), "cuad": (210, 2100), "delucionqa": (180, 1800), "hotpotqa": (180, 1800), "covidqa": (270, 2700), None: (1050, 10500)}
    named = spark.createDataFrame([("compound",), ("own/model",)], "llm string")
    assert sorted(r.model for r in registry.with_models(named).collect()) == ["groq/compound", "own/model"]
    assert registry.final_configs(spark).count() == 10 and registry.methods(spark).where("kind = 'dense'").count() == 16
    spec = registry.retrieval_of("hybrid", "minilm", "final")
    assert (spec.method, spec.sparse, spec.alpha) == ("hybrid", "tfidf", 0.7) and registry.retrieval_of("sparse", "bm25").method == "bm25"
    with pytest.raises(ValueError):
        registry.retrieval_of("other", "bm25")
    assert registry.timed(lambda: 5)[0] == 5


def test_results_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "config string, v double")
    for stamp in ("1", "2"):
        results.write_ranked(rows, str(tmp_path), stamp)
    assert spark.read.json(f"{tmp_path}/results_latest").count() == 2
    results.write_comparison({"x": rows, "y": rows}, f"{tmp_path}/cmp")
    assert spark.read.parquet(f"{tmp_path}/cmp").groupBy("part").count().count() == 2
    for i, name in enumerate(("results_1.json", "results_2.json")):
        (tmp_path / name).write_text("{}")
        if not i:
            time.sleep(1.1)
    assert results.latest_results(spark, str(tmp_path)).endswith("results_2.json")
    with pytest.raises(FileNotFoundError):
        results.latest_results(spark, str(tmp_path / "cmp"))
    results.save_samples(rows, str(tmp_path), "dom")
    assert results.cached_samples(spark, str(tmp_path), "dom").count() == 2 and results.cached_samples(spark, str(tmp_path), "none") is None
    assert len(results.exported(rows, 1)) == 1 and {r.column for r in results.explored(rows).collect()} == {"config", "v"}


def test_checkpoint_files(spark, tmp_path):
    scores = {f"{k}_{s}": 0.5 for k in ("computed", "gt") for s in ("relevance", "utilization", "completeness", "adherence")}
    for i, n in ((1, 10), (22, 3)):
        (tmp_path / f"{i:03d}_c{i}.json").write_text(json.dumps({"completed": list(range(n)), "results": [{"is_valid": True, **scores}] * n, "skipped_samples": ["s1", "s2"]}))
    pattern = f"{tmp_path}/*.json"
    assert [r.config for r in loaders.completed_configs(spark, pattern).collect()] == ["c1"]
    assert loaders.skipped_samples(spark, pattern).count() == 4
    assert {(r.config, r.n) for r in results.reloaded(spark, pattern).collect()} == {("c1", 10), ("c22", 3)}


def test_domains_and_abilities(spark, tmp_path):
    rows = spark.createDataFrame([("finqa", "test", 1), ("cuad", "test", 2), ("cuad", "train", 3)], "domain string, split string, n int")
    rows.write.partitionBy("domain", "split").parquet(f"{tmp_path}/sets")
    assert sorted(r.n for r in loaders.load_domains(spark, f"{tmp_path}/sets").collect()) == [1, 2]
    assert [r.n for r in loaders.load_cuad(spark, f"{tmp_path}/sets", split="train").collect()] == [3]
    for name in loaders.ABILITY_FILES.values():
        (tmp_path / name).write_text("".join(json.dumps({"query": "q", "positive": [["a", "b"], "c"], "negative": []}) + "\n" for _ in range(3)))
    sets = loaders.load_abilities(spark, str(tmp_path))
    assert ability.first_records(sets["integration"], 2).count() == 2
    assert sets["fact"].select(ability.flat_positives(F.col("record")).alias("p")).first().p == ["a", "b", "c"]
    asks = ability.with_prompts(spark.createDataFrame([("q", ["d"])], "question string, documents array<string>")).first()
    assert asks.prompt == "External Documents:\nDocument 1: d\n\nQuestion: q\n\nPlease answer the question based on the provided documents." and asks.bare_prompt == "Answer this question: q"


def test_best_config(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    best = compare.best_config(frame([("x", 0.1), ("y", 0.3)], "embedding string, avg_score double"), lambda e: frame([("none", 0.2)] if e == "y" else [], "strategy string, avg_score double"), lambda e, c: frame([], "model string, avg_similarity double"))
    assert (best.embedding, best.chunking, best.model) == ("y", "none", "llama-3.1-8b")
    answers = frame([("m", [1.0, 0.0], [1.0, 0.0], 5.0, 7, None), ("m", [1.0, 0.0], [0.0, 1.0], 7.0, None, None), ("m", [], [], 1.0, 1, "failed")], "model string, answer_vector array<double>, truth_vector array<double>, ms double, tokens int, error string")
    assert tuple(compare.answer_scores(answers).first()) == ("m", 0.5, 6.0, 7.0, 2)
    assert ability.best_models(frame([("negative_rejection", "a", None, 5.0, None, None), ("negative_rejection", "b", None, 9.0, None, None)], "ability string, model string, accuracy double, rejection_rate double, error_correction double, x double")).first().model == "b"


@pytest.mark.parametrize("least", [10, 5000])
def test_order_over_a_table(spark, monkeypatch, least):
    monkeypatch.setattr("ragloom.operators.ordering.LEAST_ROWS", least)
    rows = spark.range(1000).select((F.col("id") * F.col("id")).alias("k"), (F.col("id") % 3).alias("g"), F.lit(2).alias("v"))
    got = {r.k: r.b for r in running_before(rows, ["g"], "k", "v", "b", parts=7).collect()}
    assert got == {i * i: 2 * (i // 3) for i in range(1000)}
    after = {r.k: r.next_g for r in with_next(rows, "k", "g", parts=7).collect()}
    assert after == {i * i: (i + 1) % 3 if i < 999 else None for i in range(1000)}


def lengths():
    class Lengths:
        def score(self, pairs):
            return [float(len(text)) for _, text in pairs]

    return Lengths()


def test_model_rerank_and_blocks_of_queries(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(6)], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "word")], "query_id long, text string")
    found = spark.createDataFrame([(1, i, 1.0 - i / 10, i + 1) for i in range(5)], "query_id long, doc_id long, score double, rank int")
    got = retrieval.rerank(found, docs, asks, 2, retrieval.model_pair_score(lengths()), most=4).orderBy("new_rank").collect()
    assert [(r.doc_id, r.original_rank) for r in got] == [(3, 4), (2, 3)]
    vectors = spark.createDataFrame([(i, [float(i % 5), float(i % 7)]) for i in range(40)], "doc_id long, vector array<double>")
    queries = vectors.withColumnRenamed("doc_id", "query_id")
    whole = sorted(map(tuple, retrieval.dense_top(vectors, queries, 3, True).collect()))
    monkeypatch.setattr("ragloom.operators.nearest.MOST_QUERIES", 7)
    assert sorted(map(tuple, retrieval.dense_top(vectors, queries, 3, True).collect())) == whole and len(whole) == 120


def test_one_question_and_what_is_there(spark, tmp_path):
    from ragloom.plans.evaluation import answer

    docs = spark.createDataFrame([(1, "Planet one has rings. Its moons are cold."), (2, "Tea is hot. Milk is not.")], "doc_id long, text string")
    got = answer(spark, docs, "Which moons are cold?").collect()
    assert len(got) == 1 and got[0].generated_response == "Its moons are cold." and got[0].computed_relevance > 0
    spark.createDataFrame([("finqa", "test", 1), ("other", "dev", 2)], "domain string, split string, n int").write.partitionBy("domain", "split").parquet(f"{tmp_path}/sets")
    assert {(r.domain, r.split, r.known) for r in loaders.available(spark, f"{tmp_path}/sets").collect()} == {("finqa", "test", True), ("other", "dev", False)}
    assert loaders.domain_info(spark, "cuad")["name"] == "Legal"
    with pytest.raises(ValueError):
        loaders.domain_info(spark, "none")


def test_index_grows_and_answers_nest(spark, tmp_path):
    from ragloom.functions.text import contains_answer, flat_answers
    from ragloom.operators.embedding import HashingEmbedder, index_chunks

    chunks = spark.range(5).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("word number"), "id").alias("text"))
    at = f"{tmp_path}/index"
    assert index_chunks(chunks.where("chunk_id < 3"), at, HashingEmbedder()) == {"added": 3, "held_before": 0, "total": 3}
    assert index_chunks(chunks, at, HashingEmbedder()) == {"added": 2, "held_before": 3, "total": 5}
    assert index_chunks(chunks.where("chunk_id < 2"), at, HashingEmbedder(), clear=True)["total"] == 2
    rows = variants(spark, [["a", ["b", "zz"]], "zz", ["q"]]).select(flat_answers(F.col("r")).alias("f")).withColumn("c", contains_answer(F.lit("x ZZ y"), F.col("f")))
    assert [(r.f, r.c) for r in rows.collect()] == [(["a", "b", "zz"], True), (["zz"], True), (["q"], False)]
    hard = 'x \\ "q" [1,2], {z}'
    deep = [[[[[[hard]], "é\n"]], 5, True, [], None], [], "", "a" * 30_000]
    assert [r.f for r in variants(spark, [deep, None]).select(flat_answers(F.col("r")).alias("f")).collect()] == [[hard, "é\n", "5", "true", "None", "", "a" * 30_000], []]
    record = variants(spark, [{"positive": [["p1", "p2"], "p3"], "negative": ["n1"]}]).select(F.lit(1).alias("id"), F.col("r").alias("record"))
    assert sorted(ability.integration_documents(record, 0.4).first().documents) == ["n1", "p1", "p2", "p3"]


def test_retrieve_knows_every_method(spark):
    docs = spark.createDataFrame([(i, f"planet number{i} with moons", "en" if i % 2 else "fr") for i in range(8)], "doc_id long, text string, lang string")
    asks = spark.createDataFrame([(0, "planet number3")], "query_id long, text string")
    for method in ("bm25", "tfidf", "tfidf_ngram", "dense", "hybrid", "hybrid_rerank"):
        got = retrieval.retrieve(docs, asks, retrieval.RetrievalSpec(method=method, top_k=2), keep=F.col("lang") == "en").orderBy("rank").collect()
        assert got[0].doc_id == 3 and len(got) == 2 and all(r.doc_id % 2 for r in got), method
    with pytest.raises(ValueError):
        retrieval.retrieve(docs, asks, retrieval.RetrievalSpec(method="other"))
