from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.operators import nearest as N
from ragloom.operators.nearest import nearest, ranked
from ragloom.operators.vector_index import VectorIndex, kmeans
from ragloom.sources.shared import new_path


def clustered(seed, n, dims=8, clusters=20, spread=0.3):
    r = np.random.default_rng(seed)
    return (r.normal(size=(clusters, dims))[r.integers(clusters, size=n)] + spread * r.normal(size=(n, dims))).tolist()


def brute(vectors, queries, k, others_only=False):
    """(group, id, vector) and (group, query id, vector): the k best of each query over all its groups."""
    unit = lambda v: np.array(v) / np.linalg.norm(v) if np.linalg.norm(v) else np.array(v)
    found = {}
    for g, q, v in queries:
        for h, i, w in vectors:
            if g == h and not (others_only and i == q):
                found.setdefault(q, set()).add((-round(float(unit(v) @ unit(w)), 6), i))
    return {q: [i for _, i in sorted(x)[:k]] for q, x in found.items()}


@pytest.mark.parametrize("most", [0, 5000])
@pytest.mark.parametrize("by", [(), ("g", "h")])
def test_nearest_against_all_pairs(spark, monkeypatch, most, by):
    monkeypatch.setattr(N, "VECTORS_A_BLOCK", 40)
    monkeypatch.setattr(N, "QUERIES_A_BLOCK", 7)
    data = clustered(1, 300) + [[0.0] * 8, [1.0] * 8, [1.0] * 8]
    group = lambda i: "hot" if i % 3 else f"g{i % 5}"
    vectors = [(group(i), i, v) for i, v in enumerate(data)]
    queries = [(group(i), i, v) for i, v in enumerate(data) if i % 7 == 0] + [("hot", 0, data[0]), ("nowhere", 1000, data[5])]
    frame = lambda rows, name: spark.createDataFrame([(g, 1, i, v) for g, i, v in rows], f"g string, h int, {name} long, vector array<double>").repartition(3)
    got = ranked(nearest(frame(vectors, "doc_id"), frame(queries, "query_id"), 4, by, True, most).distinct(), 4)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.doc_id)
    flat = lambda rows: rows if by else [("", i, v) for _, i, v in rows]
    assert found == brute(flat(vectors), flat(queries), 4, True)


def test_nearest_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, vector array<double>")
    one = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert nearest(none, one, 3).count() == 0 and nearest(none, one, 3, most_queries=0).count() == 0
    assert nearest(one.withColumnRenamed("query_id", "doc_id"), one.limit(0), 3).count() == 0


def test_kmeans_keeps_every_centre():
    x = np.array([[1.0, 0.0]] * 50 + [[0.0, 1.0], [-1.0, 0.0]])
    centres = kmeans(x, 3)
    assert len(centres) == 3 and {tuple(np.round(c)) for c in centres} == {(1, 0), (0, 1), (-1, 0)}


def test_index_finds_neighbours_in_few_cells(spark):
    rows = [(i, v) for i, v in enumerate(clustered(3, 2000))] + [(5000, None)]
    vectors = spark.createDataFrame(rows, "doc_id long, vector array<float>").repartition(4)
    path = new_path(spark, "index")
    index = VectorIndex.build(vectors.where("doc_id < 1200 OR doc_id = 5000"), path, k=5)
    assert index.append(vectors.where("doc_id >= 1000")) == {"added": 800, "total": 2000} and index.append(vectors) == {"added": 0, "total": 2000}
    again = VectorIndex(spark, path)
    assert len(again.centres) == 34 and 1 <= again.probes < 20
    asks = vectors.where("doc_id % 20 = 0 AND vector IS NOT NULL").withColumnRenamed("doc_id", "query_id")
    exact = {(r.query_id, r.doc_id) for r in ranked(nearest(vectors.where("vector IS NOT NULL"), asks, 5, others_only=True), 5).collect()}
    got = again.search(asks, 5, others_only=True)
    assert len(exact & {(r.query_id, r.doc_id) for r in got.collect()}) >= 0.9 * len(exact)
    assert {(r.query_id, r.doc_id) for r in again.search(asks, 5, len(again.centres), others_only=True).collect()} == exact
    # one question reads the folders of its cells alone
    plan = again.search(asks.limit(1), 5, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell#") or "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, vector array<double>")
    index = VectorIndex.build(none, new_path(spark, "index"))
    one = spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")
    assert index.search(one, 3).count() == 0


# stored postings


def corpus(spark, n, seed=5):
    import random

    r = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(60)], k=r.randrange(1, 40)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def rows_of(frame):
    return sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in frame.collect())


def test_postings_index_equals_a_scan(spark, monkeypatch):
    from ragloom.operators import postings_index as P
    from ragloom.operators.retrieval import RetrievalSpec, bm25_scores, top_k

    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "BUCKETS", 4)
    docs = corpus(spark, 1500).unionByName(spark.createDataFrame([(9000, None), (9001, ""), (9002, "lonely"), (9002, "lonely")], "doc_id long, text string"))
    whole = docs.dropDuplicates(["doc_id"])
    asks = spark.createDataFrame([(0, "word0"), (1, "word0 word1"), (2, "word2 word2 word59"), (3, "lonely nobody"), (4, "the"), (5, None), (6, " ".join(f"word{i}" for i in range(20)))], "query_id long, text string")
    index = P.PostingsIndex.build(docs.where("doc_id < 900"), new_path(spark, "postings"))
    assert index.append(docs) == {"added": 603, "total": 1503} and index.append(docs) == {"added": 0, "total": 1503}
    for spec in (RetrievalSpec(), RetrievalSpec(top_k=1, k1=0.9, b=0.3), RetrievalSpec(top_k=2000)):
        want = top_k(bm25_scores(whole, asks, spec).where(F.round("score", 6) > 0), spec.top_k)
        assert rows_of(index.search(asks, spec)) == rows_of(want)
    left = {r.query_id: (r.blocks, r.left_out) for r in index.skipped(asks).collect()}
    assert left[0][1] > 0.4 * left[0][0] and left[1][1] > 0 and 4 not in left and 5 not in left
    again = P.PostingsIndex.build(docs, new_path(spark, "postings"))
    assert rows_of(again.search(asks)) == rows_of(index.search(asks)) and again.statistics().first() == index.statistics().first()


def test_an_append_that_failed_is_never_read(spark):
    from ragloom.operators.postings_index import PostingsIndex

    index = PostingsIndex.build(corpus(spark, 50), new_path(spark, "postings"))
    ask = spark.createDataFrame([(0, "word0 word1")], "query_id long, text string")
    before = rows_of(index.search(ask))
    stray = spark.read.parquet(f"{index.path}/blocks").where("term = 'word0'")
    stray.selectExpr("term", "'stray' AS segment", "level", "part", "n", "max_tf", "min_tf", "max_length", "min_length", "postings", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{index.path}/blocks")
    assert rows_of(index.search(ask)) == before
    plan = index.table("blocks").where("bucket = 3").select("term", "max_tf")._jdf.queryExecution().toString()
    assert "postings" not in plan.split("ReadSchema")[-1] and "PartitionFilters: [isnotnull(bucket" in plan


def test_postings_index_of_nothing(spark):
    from ragloom.operators.postings_index import PostingsIndex

    none = spark.createDataFrame([], "doc_id long, text string")
    index = PostingsIndex.build(none, new_path(spark, "postings"))
    assert index.search(none.withColumnRenamed("doc_id", "query_id")).count() == 0
    assert index.append(corpus(spark, 20))["added"] == 20 and index.search(spark.createDataFrame([(0, "word0")], "query_id long, text string")).count() == 5


def test_an_append_sends_no_list_of_terms_or_blocks(spark, monkeypatch):
    """Only very frequent terms are sent to tasks, and a search sends its own terms alone; an append leaves no tables of its own behind."""
    from ragloom.operators import postings_index as P
    from ragloom.operators.retrieval import bm25_scores, top_k

    monkeypatch.setattr(P, "BLOCK", 4)
    monkeypatch.setattr(P, "POSTINGS_A_TASK", 2_000)
    monkeypatch.setattr(P, "SHARES", 16)
    docs = corpus(spark, 800)
    index = P.PostingsIndex(spark, new_path(spark, "postings"))
    counts = docs.select("doc_id", F.explode(index.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.lit(1).cast("long").alias("length"))
    terms = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = counts.count()
    waves = index._blocks(counts, terms, n)
    assert len(waves) == P.WAVES and sum(w.agg(F.sum("n")).first()[0] or 0 for w in waves) == n
    assert terms.where(F.col("df") > max(4, n // 16 + 1)).count() <= 16 < terms.where("df > 4").count()
    assert max(w.agg(F.max("n")).first()[0] or 0 for w in waves) == 4
    plan = waves[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1 and f" > {n // 16 + 1})" in plan

    folder = Path(new_path(spark, "x").removeprefix("file://")).parent
    before = set(folder.iterdir())
    index = P.PostingsIndex.build(docs, new_path(spark, "kept"))
    asks = spark.createDataFrame([(0, "word0 word1"), (1, "word2 word59")], "query_id long, text string")
    assert rows_of(index.search(asks)) == rows_of(top_k(bm25_scores(docs, asks).where(F.round("score", 6) > 0), 5))
    assert [p.name[:4] for p in set(folder.iterdir()) - before] == ["kept"]
