import hashlib

from ragloom.plans import queries


def _tables(spark, path):
    docs = [(i, f"text {i} ü" * (1 + i % 7) if i % 13 else None, None if i % 10 == 9 else f"s{i % 3}", 37 * i) for i in range(400)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 5 % 2) for i in range(400)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return docs


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prompts_hold_an_items_best_documents(spark, tmp_path):
    docs = [(0, "moon moon moon", "en", "s"), (1, "moon and sun", "en", "s"), (2, "sea", "en", "s"), (3, None, "en", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "moon"), (8, "nothing here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hits = {r.doc_id: r.score for r in queries.bm25_topk(spark, str(tmp_path)).where("query_id = 7").collect()}
    assert hits[0] > hits[1]
    ranked = "\n\n".join(f"[Document {i}] (relevance: {hits[d]:.2f})\n{docs[d][1]}" for i, d in enumerate((0, 1), 1))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    got = {r.query_id: r for r in queries.prompt_context(spark, str(tmp_path)).collect()}
    assert (got[7].n_documents, got[7].context_md5) == (2, md5(ranked)) and (got[8].n_documents, got[8].context_md5) == (0, md5("No relevant context found."))


def test_windows_go_over_documents(spark):
    """Against the sentences of the joined text, cut by plain code; sentences without an end go on in the next document."""
    import random
    import re

    from pyspark.sql import functions as F

    from ragloom.operators import chunking, ordering

    r = random.Random(4)
    bits = ["One. ", "two", " three?", "  ", "Mr.", "Mr. X", "\n", "etc. end!", "Four five.  ", "Dr", ". "]
    rows = [(f"g{r.randrange(3)}", i * 3, None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randrange(0, 6)))) for i in range(120)] + [("blank", 1000, " "), ("blank", 1001, None), ("hot", 2000, "A. " * 40), (None, 3000, "no group. here")]
    frame = spark.createDataFrame(rows, "example_id string, doc_id long, text string").repartition(4)
    want = set()
    for group in {x[0] for x in rows}:
        joined = "\n\n".join(x[2] or "" for x in rows if x[0] == group)
        guarded = re.sub(r"\b(Mr|Mrs|Ms|Dr|Prof|Inc|Ltd|Corp|vs|etc)\.\s", "\\1\x01 ", joined)
        parts = [s for p in re.split(r"(?<=[.!?])\s+", guarded) if (s := p.replace("\x01", ".").strip())]
        starts = range(0, 1 if len(parts) <= 5 else -(-(len(parts) - 5) // 3) * 3 + 1, 3)
        want |= {(group, k, " ".join(parts[a : a + 5]), a, min(a + 5, len(parts)) - 1) for k, a in enumerate(starts) if parts}
    for least in (10, 5000):
        ordering.LEAST_ROWS, before = least, ordering.LEAST_ROWS
        got = chunking.corpus_chunks(frame).select("example_id", "chunk_id", "text", "start_sentence", "end_sentence").collect()
        ordering.LEAST_ROWS = before
        assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert chunking.corpus_chunks(frame.where(F.lit(False))).count() == 0


def test_noise_mix_ranks_rows(spark, tmp_path):
    docs = _tables(spark, tmp_path)
    out = queries.noise_mix(spark, str(tmp_path))
    want = set()
    for source in {d[2] for d in docs}:
        top = []
        for kind, quality, n in (("negative", 0, 2), ("positive", 1, 3)):
            ids = [f"{d[0]:09}" for d in docs if d[2] == source and d[0] % 5 % 2 == quality]
            keyed = [(hashlib.md5("|".join(["42", *([source] if source else []), kind, str(i)]).encode()).hexdigest(), d) for i, d in enumerate(ids)]
            top += sorted(keyed)[:n]
        want.add((source, "|".join(d for _, d in sorted(top))))
    assert {tuple(r) for r in out.collect()} == want
    plan = _plan(out)
    assert plan.index("collect_list") < plan.index("WindowGroupLimit")  # what is collected was cut by rank before


def test_a_chunks_row_holds_no_other_sentences(spark):
    """What goes to an embedder is a chunk's text: with a document's sentences in each of its chunks' rows, queues of rows grew with the square of its length."""
    from ragloom.operators.chunking import semantic_chunks, sentence_chunks
    from ragloom.operators.embedding import HashingEmbedder, embedded

    rows = [(0, " ".join(f"Sentence number word{i} stands here." for i in range(40))), (1, None), (2, " \n"), (3, "One. Two!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for chunks in (sentence_chunks(docs), semantic_chunks(docs)):
        plan = embedded(chunks.select("doc_id", "text"), "text", HashingEmbedder()).select("doc_id", "vector")._jdf.queryExecution().optimizedPlan().toString()
        above = plan.split("Generate")[0]
        assert "ArrowEvalPython" in above and "parts#" not in above
        assert {r.doc_id for r in chunks.collect()} == {0, 3}
    first = sentence_chunks(docs).orderBy("doc_id", "chunk_id").first()
    assert (first.text, first.start_sentence, first.end_sentence, first.num_sentences) == (" ".join(f"Sentence number word{i} stands here." for i in range(5)), 0, 4, 5)


def test_best_of_equals_go_by_id():
    import numpy as np

    from ragloom.operators.nearest import _best

    ids, own = np.arange(100, 150), np.eye(2)[[i % 2 for i in range(50)]]
    got = _best(ids, own, np.array([7, 8, 9]), np.array([[1.0, 0.0], [0.0, 0.0], [0.0, 1.0]]), 3, False)
    assert got.groupby("query_id")["doc_id"].apply(list).to_dict() == {7: [100, 102, 104], 8: [100, 101, 102], 9: [101, 103, 105]}
    assert len(_best(ids[:2], own[:2], np.array([100]), own[:1], 5, True)) == 1


def test_hashing_embedder_counts_words():
    import hashlib

    import numpy as np

    from ragloom.operators.embedding import HashingEmbedder

    want = np.zeros((3, 16))
    for word in ["words", "words", "house_no"[:5], "x9y"]:
        digest = hashlib.md5(word.encode()).hexdigest()
        want[0, int(digest[:8], 16) % 16] += 1 if int(digest[8], 16) < 8 else -1
    want[0] /= np.linalg.norm(want[0])
    assert np.allclose(HashingEmbedder(16).embed(["Words, the WORDS house_no x9y é ünd of", "", "the"]), want)
