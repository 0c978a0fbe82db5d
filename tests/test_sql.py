import pytest
from pyspark.sql import functions as F

from ragloom.functions import metrics, sql, text
from ragloom.operators import chunking

TEXTS = ["Mr. Smith went. He saw Dr. Who!  Was it? Yes.\n\nNew line.", "one two three", "", None, " ", "e.g. this. U.S. law. ", "I cannot answer. <think>a. b</think>Inaccurate.\n\n\n\n\nEnd", "a b. c. d! e? f. g. h. i. j. k. l.", "The Quick-brown fox_1 über 22 333."]


@pytest.fixture(scope="module")
def docs(spark):
    sql.register(spark)
    sql.register(spark)
    rows = [(i, t, f"e{i % 2}", i * 10) for i, t in enumerate(TEXTS)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, example_id string, chunk_id int").repartition(3)
    frame.createOrReplaceTempView("sql_docs")
    return frame


def test_scalar_functions_are_the_same(spark, docs):
    t = F.col("text")
    same = {
        "content_tokens": text.content_tokens(t), "blank_tokens": text.blank_tokens(t), "text_sentences": text.sentences(t), "judge_text_sentences": text.judge_sentences(t),
        "is_rejection": text.is_rejection(t), "detects_error": text.detects_error(t), "without_reasoning": text.without_reasoning(t),
    }
    got = spark.sql(f"SELECT doc_id, {', '.join(f'{n}(text) AS {n}' for n in same)} FROM sql_docs").orderBy("doc_id").collect()
    want = docs.select("doc_id", *(c.alias(n) for n, c in same.items())).orderBy("doc_id").collect()
    assert got == want
    a, b = F.array(*map(F.lit, (1.0, 2.0))), F.array(*map(F.lit, (2.0, -1.5)))
    r, u = F.array(*map(F.lit, ("0a", "0a", "1b"))), F.array(*map(F.lit, ("1b",)))
    row = spark.sql("SELECT vector_cosine(array(1, 2), array(2, -1.5)) AS c, vector_cosine(array(0), array(1)) AS z, trace_scores(array('0a', '0a', '1b'), array('1b'), true, 4) AS s").first()
    assert row == spark.range(1).select(metrics.cosine(a, b).alias("c"), F.lit(0.0).alias("z"), metrics.trace_scores(r, u, F.lit(True), F.lit(4)).alias("s")).first()


def test_table_functions_cut_as_the_library_does(spark, docs):
    rows = lambda df: sorted((r.doc_id, r.chunk_id, r.start_sentence, r.end_sentence, r.text) for r in df.collect())
    plain = docs.select("doc_id", "text")
    assert rows(spark.sql("SELECT * FROM sentence_chunks(TABLE(sql_docs), 5, 2)")) == rows(chunking.sentence_chunks(plain))
    assert rows(spark.sql("SELECT * FROM semantic_chunks(TABLE(SELECT doc_id, text FROM sql_docs), 0.5)")) == rows(chunking.semantic_chunks(plain))
    whole = {(r.doc_id, r.text) for r in spark.sql("SELECT * FROM whole_chunks(TABLE(sql_docs))").collect()}
    assert whole == {(r.doc_id, r.text) for r in chunking.no_chunks(plain).collect()}


def test_chunks_are_numbered_through_an_example(spark, docs):
    got = spark.sql("SELECT * FROM sentence_chunks(TABLE(sql_docs) PARTITION BY example_id ORDER BY (doc_id), 2, 0)")
    assert got.columns == ["doc_id", "example_id", "chunk_id", "global_chunk_id", "start_sentence", "end_sentence", "text"]
    for e in ("e0", "e1"):
        own = sorted((r.doc_id, r.chunk_id, r.global_chunk_id) for r in got.where(F.col("example_id") == e).collect())
        assert own and [x[2] for x in own] == list(range(len(own)))
    with pytest.raises(Exception, match="doc_id and text"):
        spark.sql("SELECT * FROM whole_chunks(TABLE(SELECT doc_id FROM sql_docs))")
