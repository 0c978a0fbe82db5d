import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.operators import aggregation, chunking, retrieval, sampling
from ragloom.plans.evaluation import config_grid, index_range
from ragloom.plans.models import asked
from ragloom.sources import loaders
from ragloom.streaming.incremental import evaluate_stream


def test_windows(spark):
    said = " ".join(f"S{i}." for i in range(15))
    docs = spark.createDataFrame([(1, said), (2, "One."), (3, ""), (4, None)], "doc_id long, text string")
    got = [(r.doc_id, r.start_sentence, r.end_sentence) for r in chunking.sentence_chunks(docs).orderBy("doc_id", "chunk_id").collect()]
    assert got == [(1, 0, 4), (1, 3, 7), (1, 6, 10), (1, 9, 13), (1, 12, 14), (2, 0, 0)]
    wide = chunking.sentence_chunks(docs.where("doc_id = 1"), 3, 5).collect()
    assert [r.start_sentence for r in sorted(wide, key=lambda r: r.chunk_id)][:3] == [0, 1, 2]


def test_greedy_bounds():
    sizes = lambda sims: [b - a + 1 for a, b in chunking.greedy_bounds(np.array(sims), 0.5, 2, 10)]
    assert sizes([1.0] * 19) == [9, 9, 2] and sizes([0.0] * 4) == [1] * 5


@given(st.lists(st.floats(0, 1), max_size=40))
def test_greedy_bounds_partition(sims):
    bounds = chunking.greedy_bounds(np.array(sims), 0.5, 2, 10)
    assert [i for a, b in bounds for i in range(a, b + 1)] == list(range(len(sims) + 1)) and all(b - a < 9 for a, b in bounds)


def test_semantic(spark):
    docs = spark.createDataFrame([(1, "Cats purr softly. Cats purr loudly. Rates rose again. Rates fell again."), (2, None), (3, "One. Two.")], "doc_id long, text string")
    got = [(r.doc_id, r.start_sentence, r.end_sentence) for r in chunking.semantic_chunks(docs).orderBy("doc_id", "chunk_id").collect()]
    assert got == [(1, 0, 1), (1, 2, 3), (3, 0, 1)]


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "apple")], "doc_id long, text string")
    one, two = (spark.createDataFrame([(1, t)], "query_id long, text string") for t in ("apple", "apple apple"))
    assert retrieval.bm25_scores(docs, one).first().score == pytest.approx(math.log(4 / 3))
    assert retrieval.bm25_scores(docs, two).first().score == pytest.approx(2 * math.log(4 / 3))
    with pytest.raises(ValueError):
        retrieval.retrieve(docs, one, retrieval.RetrievalSpec(method="none"))


def test_fusion(spark):
    leg = lambda ids: spark.createDataFrame([(1, d, 1.0, i) for i, d in enumerate(ids, 1)], "query_id int, doc_id string, score double, rank int")
    got = {r.doc_id: r.score for r in retrieval.rrf(leg("ab"), leg("bc")).collect()}
    assert got == pytest.approx({"a": 0.5 / 61, "b": 0.5 / 62 + 0.5 / 61, "c": 0.5 / 62})
    got = {r.doc_id: r.score for r in retrieval.linear_fusion(leg("ab"), leg("bc")).collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": 0.5}


def test_classification_and_auroc(spark):
    rows = spark.createDataFrame([("x", 0.9, 1), ("x", 0.4, 0), ("x", 0.4, 1), ("y", 0.3, 1)], "g string, s double, y int")
    got = {r.g: r.auroc for r in aggregation.auroc(rows, ["g"], F.col("s"), F.col("y")).collect()}
    assert got == {"x": 0.75, "y": 0.5}
    f1 = {r.g: (r.precision, r.recall, r.f1) for r in aggregation.classification(rows, ["g"], (F.col("s") >= 0.5).cast("int"), F.col("y")).collect()}
    assert f1["x"] == (1.0, 0.5, pytest.approx(2 / 3)) and f1["y"] == (0.0, 0.0, 0.0)


def test_health(spark):
    zero, good = (0.0, 0.0, 0.0, 0.0, True), (0.5, 0.0, 0.0, 1.0, True)
    files = {"few": [good] * 9, "zeros": [zero] * 10, "some": [good] * 9 + [zero], "fine": [good] * 10}
    rows = spark.createDataFrame([(k, *r) for k, v in files.items() for r in v], "f string, computed_relevance double, computed_utilization double, computed_completeness double, computed_adherence double, is_valid boolean")
    assert {r.f: r.status for r in aggregation.health(rows, ["f"]).collect()} == {"few": "less_than_10", "zeros": "all_zeros", "some": "partial_zeros", "fine": "ok"}


def test_noise(spark):
    record = spark.createDataFrame([(1, [f"p{i}" for i in range(6)], [f"n{i}" for i in range(6)], None)], "id int, positive array<string>, negative array<string>, positive_wrong array<string>")
    got = sampling.noise_mix(record, 0.4).first().documents
    assert sorted(d[0] for d in got) == ["n", "n", "p", "p", "p"]
    assert all(d[0] == "n" for d in sampling.negatives_only(record).first().documents)
    assert sampling.counterfactual(record).first().documents == ["p0", "p1", "p2", "p3", "p4"]


def test_configs(spark):
    grid = config_grid(spark, "finqa", [f"e{i}" for i in range(6)], ["a/m1", "m2", "m3", "m4", "m5"])
    assert grid.count() == 210
    assert grid.where("config_index = 31").first().config_id == "sparse_none_bm25_m1"
    assert index_range("1,3-5") == [1, 3, 4, 5]


def test_standardized(spark):
    said = ['{"id": 0, "idx": "k", "query": "q", "documents": [["a", "b"], {"text": "c"}], "adherence": "Yes", "answers": ["z"]}', '{"context": "solo", "relevance_score": 0.25, "adherence": false, "response": "r"}', "{}"]
    frame = spark.createDataFrame(list(enumerate(said)), "at int, t string").select("at", F.parse_json("t").alias("record"))
    got = sorted(loaders.standardized(frame, F.lit("d"), "at").drop("original").collect(), key=lambda r: r.id)
    assert [(r.id, r.documents, r.response, r.context_relevance, r.adherence) for r in got] == [("d_1", ["solo"], "r", 0.25, 0.0), ("d_2", [], "", 0.5, 1.0), ("k", ["a", "b", "c"], "z", 0.5, 1.0)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}\n\n{"a": 2}\n')
    got = loaders.load_json_lines(spark, f"file://{tmp_path}/x.json", True).select("id", F.variant_get("record", "$.a", "int").alias("a")).collect()
    assert sorted(map(tuple, got)) == [(0, 1), (2, 2)]


def test_models(spark):
    class Flaky:
        def answer(self, prompts):
            if prompts[0] == "bad":
                raise RuntimeError("no")
            return [p.upper() for p in prompts]

    rows = spark.createDataFrame([("good",), ("bad",)], "p string")
    got = {r.p: (r.response, r.error) for r in asked(rows, "p", Flaky()).collect()}
    assert got == {"good": ("GOOD", None), "bad": (None, "RuntimeError: no")}


def test_stream_appends_once(spark, tmp_path):
    samples, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("c", str(i)) for i in range(5)], "config string, dataset_id string")
    rows.write.parquet(samples)
    for n in range(2):
        evaluate_stream(spark, samples, "config string, dataset_id string", lambda b: b.withColumn("score", F.lit(1.0)), out, f"file://{tmp_path}/at{n}").awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_vocabulary_is_that_of_all_runs(spark):
    """Runs are counted only where their tokens are frequent enough; before anything of a document is shuffled, it is cut to the vocabulary."""
    import random
    from collections import Counter

    from ragloom.functions.text import content_tokens
    from ragloom.operators.retrieval import tfidf_scores, vocabulary

    r = random.Random(3)
    words = [f"word{i:02}" for i in range(40)]
    texts = [" ".join(r.choices(words, weights=[1 / (j + 1) for j in range(40)], k=r.randrange(0, 30))) for _ in range(200)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for most in (1, 2, 3):
        cf = Counter(" ".join(t[i : i + n]) for t in ((x or "").split() for x in texts) for n in range(1, most + 1) for i in range(len(t) - n + 1))
        order = sorted(cf, key=lambda t: (-cf[t], t))
        for k in (5, 30, 60, 10_000):  # more than there are tokens, more than there are runs
            got = vocabulary(docs, k, content_tokens, most).collect()
            assert {x.term for x in got} == set(order[:k]) and len({x.no for x in got}) == len(got) == min(k, len(order))
    asks = spark.createDataFrame([(0, "word00 word01 word07"), (1, "none")], "query_id long, text string")
    scores = tfidf_scores(docs, asks, content_tokens, 30, 2)
    plan = scores._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [doc_id")[1]
    assert "Join Inner" in plan.split("Generate explode")[0] and {x.query_id for x in scores.collect()} == {0}
