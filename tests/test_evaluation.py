import pytest

from ragloom.plans import queries


@pytest.mark.parametrize(("sources", "items"), [(3, 7), (7, 3)])
def test_every_item_and_source_is_evaluated(spark, tmp_path, sources, items):
    docs = [(i, f"Planet number{i % sources} has rings. Its moons are small and cold. Weather changes daily.", "en", f"s{i % sources}") for i in range(4 * sources)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    asks = [(i, f"Which moons are cold around number{i}?") for i in range(items)]
    spark.createDataFrame(asks, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.end_to_end_eval(spark, str(tmp_path)).collect()
    assert sorted((r.query_id, r.example_id) for r in got) == sorted((k % items, f"s{k % sources}") for k in range(max(items, sources)))
    assert all(r.computed_relevance > 0 for r in got)


def test_terms_are_counted_in_a_chunks_row(spark):
    """No row for a token is shuffled; TF-IDF of all terms goes in parts and gives the scores of a plain count."""
    import math
    import random
    from collections import Counter

    from ragloom.operators.retrieval import RetrievalSpec
    from ragloom.plans.evaluation import GridScores, grid_chunks

    r = random.Random(1)
    words = [f"word{i}" for i in range(30)]
    docs = [(f"e{i % 2}", i, " ".join(r.choices(words, k=r.randrange(1, 20)))) for i in range(40)] + [("e0", 90, "of the"), ("e1", 91, None)]
    chunks = grid_chunks(spark.createDataFrame(docs, "example_id string, doc_id long, text string"), ["none"])
    got = {x.chunk_id: (x.length, {t.term: t.tf for t in x.terms}) for x in chunks.collect()}
    want = {f"{i}_0": Counter(t.split()) for _, i, t in docs if t and i != 90} | {"90_0": Counter()}
    assert got == {k: (c.total(), dict(c)) for k, c in want.items()} and chunks.select("no").distinct().count() == len(want)
    scores = GridScores(chunks, spark.createDataFrame([(7, "e0", "word1 word1 word2")], "sample_id long, example_id string, question string"), RetrievalSpec(), {})
    assert "Exchange" not in scores.counts(asked=False)._jdf.queryExecution().executedPlan().toString()
    own = {k: c for k, c in want.items() if int(k[:-2]) % 2 == 0}
    df = Counter(t for c in own.values() for t in c)
    idf = {t: math.log((1 + len(own)) / (1 + n)) + 1 for t, n in df.items()}
    q = {"word1": 2 * idf["word1"], "word2": idf["word2"]}
    size = lambda v: math.sqrt(sum(x * x for x in v))
    plain = {k: sum(c[t] * idf[t] * x for t, x in q.items()) / size(q.values()) / size(n * idf[t] for t, n in c.items()) for k, c in own.items() if c.keys() & q.keys()}
    found = {x.chunk_id: x.score for x in scores.tfidf().collect()}
    assert found.keys() == plain.keys() and all(abs(found[k] - plain[k]) < 1e-9 for k in plain)
