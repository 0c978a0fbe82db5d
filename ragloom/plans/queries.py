"""The queries of the library's own operators over the given tables, each with its SQL where SQL can say it.

Scores are rounded to six digits and equal ones rank by id, so that both engines give the same rows.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions import judge_json, prompts, text
from ragloom.functions.metrics import cosine, trace_average, trace_scores
from ragloom.operators import aggregation, chunking, retrieval, sampling
from ragloom.operators.embedding import HashingEmbedder, embedded, not_indexed
from ragloom.operators.ordering import running_before, with_next
from ragloom.operators.postings_index import PostingsIndex
from ragloom.operators.retrieval import RetrievalSpec
from ragloom.operators.vector_index import VectorIndex
from ragloom.plans import ability, compare
from ragloom.plans.evaluation import evaluate_configs
from ragloom.sources.loaders import standardized
from ragloom.sources.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt over all cores where the files have fewer parts than these: a file may be one row group, which one task reads."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores, "doc_id") if docs.rdd.getNumPartitions() < cores else docs


def docs_and_asks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return docs, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# SQL of the column functions
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_matches(t, '^[a-z0-9]+$') AND len(t) > 2 AND t NOT IN (" + _STOP + "))"
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_CUT = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(2), 'g'), chr(2))"


def _sentences(of: str) -> str:
    guarded = f"regexp_replace({of}, '\\b({'|'.join(text.ABBREVIATIONS)})\\.\\s', '\\1' || chr(1) || ' ', 'g')"
    return f"list_filter(list_transform({_CUT.format(guarded)}, lambda s: {_TRIM.format('replace(s, chr(1), chr(46))')}), lambda s: s <> '')"


def _judge_sentences(of: str) -> str:
    guarded = _TRIM.format(of)
    for a in text.JUDGE_ABBREVIATIONS:
        guarded = f"replace({guarded}, '{a}', replace('{a}', '.', chr(1)))"
    return f"list_filter(list_transform({_CUT.format(guarded)}, lambda s: {_TRIM.format('replace(s, chr(1), chr(46))')}), lambda s: s <> '')"


_DOCS_TOKENS = f"docs AS (SELECT doc_id, lang, source, {_TOKENS.format('text')} AS ts FROM documents), asks AS (SELECT item_id AS query_id, {_TOKENS.format('text')} AS ts FROM benchmark)"
_BM25 = f"""
{_DOCS_TOKENS},
q AS (SELECT query_id, t AS term, count(*) AS qtf FROM (SELECT query_id, unnest(ts) AS t FROM asks) GROUP BY ALL),
p AS (SELECT doc_id, t AS term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(ts) AS n, unnest(ts) AS t FROM docs) GROUP BY doc_id, t),
st AS (SELECT count(*) AS docs, avg(len(ts)) AS mean FROM docs),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
bm25 AS (SELECT query_id, doc_id, sum(qtf * ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / mean))) AS score
         FROM q JOIN p USING (term) JOIN df USING (term), st GROUP BY query_id, doc_id)
"""
_RANKED = "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM {0})) WHERE rank <= {1}"


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ({_RANKED.format('bm25 WHERE round(score, 6) > 0', 5)})")
def bm25_topk(spark, sf_dir):
    docs, asks = docs_and_asks(spark, sf_dir)
    return retrieval.retrieve(docs, asks).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ({_RANKED.format('''bm25 JOIN docs USING (doc_id) WHERE lang = 'en' AND round(score, 6) > 0''', 5)})")
def bm25_topk_filtered(spark, sf_dir):
    docs, asks = docs_and_asks(spark, sf_dir)
    return retrieval.retrieve(docs, asks, keep=F.col("lang") == "en").select("query_id", "doc_id", "score", "rank")


@query(f"SELECT doc_id, CAST(len(ts) AS INTEGER) AS n_tokens, CAST(len(list_distinct(ts)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {_TOKENS.format('text')} AS ts FROM documents)")
def tokenize_stats(spark, sf_dir):
    tokens = documents(spark, sf_dir).select("doc_id", text.content_tokens(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY term")
def doc_frequency(spark, sf_dir):
    tokens = documents(spark, sf_dir).select("doc_id", F.explode(text.content_tokens(F.col("text"))).alias("term"))
    return tokens.groupBy("doc_id", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def _postings(spark: SparkSession, sf_dir: str) -> PostingsIndex:
    """A stored index of all documents: those in one language first, then the others by a further append, which also meets known ones again."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    index = PostingsIndex.build(docs.where("lang = 'en'"), new_path(spark, "postings-index"))
    index.append(docs)
    return index


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ({_RANKED.format('bm25 WHERE round(score, 6) > 0', 5)})")
def bm25_indexed(spark, sf_dir):
    """The top five of every benchmark item from the stored index."""
    return _postings(spark, sf_dir).search(docs_and_asks(spark, sf_dir)[1]).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {_BM25.replace('AS ts FROM benchmark', '[:2] AS ts FROM benchmark')}
SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ({_RANKED.format('bm25 WHERE round(score, 6) > 0', 5)})""")
def bm25_indexed_short(spark, sf_dir):
    """Of questions of two words, for which most blocks needn't be read."""
    asks = docs_and_asks(spark, sf_dir)[1].select("query_id", F.array_join(F.slice(text.content_tokens(F.col("text")), 1, 2), " ").alias("text"))
    return _postings(spark, sf_dir).search(asks).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH t AS (SELECT {_TOKENS.format("coalesce(text, '')")} AS ts FROM documents) SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_tokens, round(avg(len(ts)), 6) AS mean_tokens,
(SELECT count(DISTINCT term) FROM (SELECT unnest(ts) AS term FROM t)) AS n_terms FROM t""")
def stored_index_statistics(spark, sf_dir):
    """What the index holds, by the sums of its appends."""
    return _postings(spark, sf_dir).statistics()


_TFIDF = f"""
{_DOCS_TOKENS},
c AS (SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM docs) GROUP BY ALL),
i AS (SELECT term, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY term),
w AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN i USING (term)),
l AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
q0 AS (SELECT query_id, term, count(*) * any_value(idf) AS q FROM (SELECT query_id, unnest(ts) AS term FROM asks) JOIN i USING (term) GROUP BY query_id, term),
q AS (SELECT query_id, term, q / sqrt(sum(q * q) OVER (PARTITION BY query_id)) AS q FROM q0),
tfidf AS (SELECT query_id, doc_id, sum(w * q) / any_value(norm) AS score FROM w JOIN q USING (term) JOIN l USING (doc_id) GROUP BY query_id, doc_id)
"""


@query(f"WITH {_TFIDF} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ({_RANKED.format('tfidf WHERE round(score, 6) > 0', 5)})")
def tfidf_topk(spark, sf_dir):
    docs, asks = docs_and_asks(spark, sf_dir)
    return retrieval.retrieve(docs, asks, RetrievalSpec(method="tfidf")).select("query_id", "doc_id", "score", "rank")


_HASHED = """
{0}_v AS (SELECT id, list_transform(range(64), lambda b: coalesce(list_sum(list_transform(list_filter(ts, lambda t: CAST(concat('0x', substr(md5(t), 1, 8)) AS BIGINT) % 64 = b),
       lambda t: CASE WHEN substr(md5(t), 9, 1) < '8' THEN 1.0 ELSE -1.0 END)), 0.0)) AS v FROM (SELECT {1} AS id, ts FROM {0}))
"""
_COSINE = "CASE WHEN list_dot_product(a.v, a.v) > 0 AND list_dot_product(b.v, b.v) > 0 THEN list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) ELSE 0 END"
_DENSE = f"{_HASHED.format('docs', 'doc_id')}, {_HASHED.format('asks', 'query_id')}, dense AS (SELECT b.id AS query_id, a.id AS doc_id, CAST({_COSINE} AS DOUBLE) AS score FROM docs_v a, asks_v b)"
_LEGS = f"x AS ({_RANKED.format('dense', 10)}), y AS ({_RANKED.format('bm25 WHERE round(score, 6) > 0', 10)})"


def _legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The dense leg, cut to what a hybrid of five takes, and the scores of the sparse one."""
    docs, asks = docs_and_asks(spark, sf_dir)
    return _dense_leg(docs, asks, 10), retrieval.bm25_scores(docs, asks)


def _dense_leg(docs: DataFrame, asks: DataFrame, k: int, embedder: HashingEmbedder | None = None) -> DataFrame:
    embedder = embedder or HashingEmbedder()
    return retrieval.dense_top(embedded(docs.select("doc_id", "text"), "text", embedder), embedded(asks, "text", embedder), k)


@query(f"""WITH {_BM25}, {_DENSE}, {_LEGS}, f AS (SELECT query_id, doc_id, sum(part) AS score FROM (SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) AS part FROM x UNION ALL
SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) FROM y) GROUP BY query_id, doc_id) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ({_RANKED.format('f', 5)})""")
def hybrid_rrf(spark, sf_dir):
    return retrieval.hybrid(*_legs(spark, sf_dir)).select("query_id", "doc_id", "score", "rank")


_RRF = """f AS (SELECT query_id, doc_id, sum(part) AS score FROM (SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) AS part FROM x UNION ALL
SELECT query_id, doc_id, 0.5::DOUBLE / (60 + rank) FROM y) GROUP BY query_id, doc_id)"""


@query(f"""WITH {_TFIDF}, {_DENSE}, x AS ({_RANKED.format('dense', 10)}), y AS ({_RANKED.format('tfidf WHERE round(score, 6) > 0', 10)}), {_RRF}
SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ({_RANKED.format('f', 5)})""")
def hybrid_tfidf(spark, sf_dir):
    """The hybrid that evaluation runs use: its sparse leg is TF-IDF of single tokens."""
    docs, asks = docs_and_asks(spark, sf_dir)
    return retrieval.hybrid(_dense_leg(docs, asks, 10), retrieval.tfidf_scores(docs, asks)).select("query_id", "doc_id", "score", "rank")


_BLANK = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda t: t <> '')"


@query(f"""WITH {_BM25.replace(_DOCS_TOKENS, _DOCS_TOKENS.replace(_TOKENS.format('text'), _BLANK.format("coalesce(text, '')")))} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ({_RANKED.format('bm25 WHERE round(score, 6) > 0', 10)})""")
def hybrid_bm25_leg(spark, sf_dir):
    """The BM25 leg of a hybrid: tokens between white space, twice the top-k."""
    docs, asks = docs_and_asks(spark, sf_dir)
    scores = retrieval.bm25_scores(docs, asks, tokens=text.blank_tokens)
    return retrieval.top_k(scores.where(F.round("score", 6) > 0), 10).select("query_id", "doc_id", "score", "rank")


@query(f"""WITH {_TFIDF}, {_DENSE}, x AS ({_RANKED.format('dense', 40)}), y AS ({_RANKED.format('tfidf WHERE round(score, 6) > 0', 40)}), {_RRF}, few AS ({_RANKED.format('f', 20)}),
r AS (SELECT few.query_id, few.doc_id, few.score AS original_score, CAST(few.rank AS INTEGER) AS original_rank, round(coalesce(len(list_intersect(list_distinct(a.ts), list_distinct(d.ts))) / nullif(len(list_distinct(a.ts)), 0), 0), 6) AS rerank_score
      FROM few JOIN docs d USING (doc_id) JOIN asks a USING (query_id))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, original_rank) AS INTEGER) AS new_rank FROM r) WHERE new_rank <= 5""")
def hybrid_rerank(spark, sf_dir):
    docs, asks = docs_and_asks(spark, sf_dir)
    return retrieval.hybrid_reranked(_dense_leg(docs, asks, 40), retrieval.tfidf_scores(docs, asks), docs, asks)


_TFIDF_GRAMS = _TFIDF.replace(_DOCS_TOKENS, "t AS (SELECT doc_id, " + _TOKENS.format("text") + " AS t FROM documents), u AS (SELECT item_id AS query_id, " + _TOKENS.format("text") + " AS t FROM benchmark), "
    + ", ".join(f"{name} AS (SELECT {key}, list_concat(t, list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) AS ts FROM {of})" for name, key, of in (("docs", "doc_id", "t"), ("asks", "query_id", "u")))
    ).replace("FROM c GROUP BY term)", "FROM c GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000)")


@query(f"WITH {_TFIDF_GRAMS} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ({_RANKED.format('tfidf WHERE round(score, 6) > 0', 5)})")
def tfidf_ngram_topk(spark, sf_dir):
    """TF-IDF of single tokens and pairs of neighbours, over the 10,000 that occur most often."""
    docs, asks = docs_and_asks(spark, sf_dir)
    return retrieval.retrieve(docs, asks, RetrievalSpec(method="tfidf_ngram")).select("query_id", "doc_id", "score", "rank")


_SCALED = "{0}s AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM {0} WINDOW w AS (PARTITION BY query_id))"


@query(f"""WITH {_BM25}, {_DENSE}, {_LEGS}, {_SCALED.format('x')}, {_SCALED.format('y')}, f AS (SELECT query_id, doc_id, 0.5 * coalesce(xs.s, 0) + 0.5 * coalesce(ys.s, 0) AS score
FROM xs FULL JOIN ys USING (query_id, doc_id)) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ({_RANKED.format('f', 5)})""")
def hybrid_linear(spark, sf_dir):
    return retrieval.hybrid(*_legs(spark, sf_dir), RetrievalSpec(fusion="linear")).select("query_id", "doc_id", "score", "rank")


_VECTORS = "SELECT vec_id AS id, label, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS v FROM embeddings"


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vector"))
    asks = vectors.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return retrieval.dense_top(vectors, asks, 5, others_only=True).select("query_id", "doc_id", "score", "rank")


_DENSE_TOP = f"e AS ({_VECTORS}), s AS (SELECT b.id AS query_id, a.id AS doc_id, {_COSINE} AS score FROM e a, e b WHERE b.id % 20 = 0 AND a.id <> b.id), t AS ({_RANKED.format('s', 5)})"


@query(f"WITH {_DENSE_TOP} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM t")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir)


def _index(spark: SparkSession, sf_dir: str) -> tuple[VectorIndex, DataFrame]:
    """An index of all vectors, built of those of the labels below five and appended to by the others; and the stated queries."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    index = VectorIndex.build(vectors.where("label < 5"), new_path(spark, "vector-index"))
    index.append(vectors.where("NOT coalesce(label < 5, false)"))
    index.calibrate(5, 0.95)
    return index, vectors.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")


@query()
def ann_topk(spark, sf_dir):
    """The nearest five by a stored index, in as many cells as were measured."""
    index, asks = _index(spark, sf_dir)
    return index.search(asks, 5, others_only=True)


@query(f"WITH {_DENSE_TOP} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM t")
def ann_all_cells(spark, sf_dir):
    """The index with every cell opened holds every row once: its rows are the exact ones."""
    index, asks = _index(spark, sf_dir)
    return index.search(asks, 5, probes=len(index.centres), others_only=True)


@query(f"WITH {_DENSE_TOP} SELECT count(*) AS neighbours, true AS recall_of_nine_tenths FROM t")
def ann_recall(spark, sf_dir):
    """Of the exact five nearest of each query, how many there are and whether the index finds nine of ten."""
    exact, found = _dense(spark, sf_dir), ann_topk(spark, sf_dir).select("query_id", "doc_id", F.lit(True).alias("hit"))
    return exact.join(found, ["query_id", "doc_id"], "left").agg(F.count("*").alias("neighbours"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_of_nine_tenths"))


@query(f"WITH {_DENSE_TOP} SELECT query_id, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS precision_at_5, round(avg(score), 6) AS mean_score FROM t JOIN e a ON a.id = query_id JOIN e b ON b.id = doc_id GROUP BY query_id")
def dense_precision(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _dense(spark, sf_dir).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked")), "query_id").join(labels.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id")
    return hits.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("asked")).cast("double")), 6).alias("precision_at_5"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"""WITH {_BM25}, c AS ({_RANKED.format('bm25 WHERE round(score, 6) > 0', 20)}),
r AS (SELECT c.query_id, c.doc_id, c.score AS original_score, CAST(c.rank AS INTEGER) AS original_rank, round(coalesce(len(list_intersect(list_distinct(a.ts), list_distinct(d.ts))) / nullif(len(list_distinct(a.ts)), 0), 0), 6) AS rerank_score
      FROM c JOIN docs d USING (doc_id) JOIN asks a USING (query_id))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, original_rank) AS INTEGER) AS new_rank FROM r) WHERE new_rank <= 5""")
def rerank_topk(spark, sf_dir):
    docs, asks = docs_and_asks(spark, sf_dir)
    return retrieval.rerank(retrieval.retrieve(docs, asks, RetrievalSpec(top_k=20)), docs, asks, 5)


@query(f"SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, md5(array_to_string(s, chr(3))) AS sentences_md5 FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    s = documents(spark, sf_dir).select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\x03")).alias("sentences_md5"))


_WINDOWS = f"""s AS (SELECT doc_id, {_sentences('text')} AS s FROM documents), w AS (SELECT doc_id, s, unnest(range(CASE WHEN len(s) <= 5 THEN 1 ELSE CAST(ceil((len(s) - 5) / 3) AS BIGINT) + 1 END)) AS k FROM s WHERE len(s) > 0),
chunks AS (SELECT doc_id, CAST(k AS INTEGER) AS chunk_id, array_to_string(s[k * 3 + 1:least(k * 3 + 5, len(s))], ' ') AS text, CAST(k * 3 AS INTEGER) AS start_sentence, CAST(least(k * 3 + 5, len(s)) - 1 AS INTEGER) AS end_sentence FROM w)"""


@query(f"WITH {_WINDOWS} SELECT doc_id, chunk_id, start_sentence, end_sentence, substr(md5(doc_id || '_' || chunk_id || '_' || text), 1, 16) AS chunk_key FROM chunks")
def sentence_chunks(spark, sf_dir):
    chunks = chunking.sentence_chunks(documents(spark, sf_dir))
    return chunks.select("doc_id", "chunk_id", "start_sentence", "end_sentence", chunking.chunk_key(F.col("text"), F.col("doc_id"), F.col("chunk_id")).alias("chunk_key"))


@query(f"""WITH c AS (SELECT source, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY source), s AS (SELECT source, {_sentences('text')} AS s FROM c),
w AS (SELECT source, s, unnest(range(CASE WHEN len(s) <= 5 THEN 1 ELSE CAST(ceil((len(s) - 5) / 3) AS BIGINT) + 1 END)) AS k FROM s WHERE len(s) > 0)
SELECT source, k AS chunk_id, k * 3 AS start_sentence, least(k * 3 + 5, len(s)) - 1 AS end_sentence, md5(array_to_string(s[k * 3 + 1:least(k * 3 + 5, len(s))], ' ')) AS text_md5 FROM w""")
def corpus_chunks(spark, sf_dir):
    """Sentence windows over the joined documents of each source, sentences across documents included."""
    chunks = chunking.corpus_chunks(documents(spark, sf_dir).select("source", "doc_id", "text"), "source")
    return chunks.select("source", "chunk_id", "start_sentence", "end_sentence", F.md5("text").alias("text_md5"))


_SEMANTIC = f"""s AS (SELECT doc_id, {_sentences('text')} AS s FROM documents), parts AS (SELECT doc_id AS d, unnest(range(len(s))) AS i, len(s) AS n, unnest(s) AS text FROM s WHERE len(s) > 0),
docs AS (SELECT d * 1000000 + i AS doc_id, {_TOKENS.format('text')} AS ts FROM parts), {_HASHED.format('docs', 'doc_id')},
pairs AS (SELECT d, i, n, text, b.v AS bv, a.v AS av FROM parts JOIN docs_v b ON b.id = d * 1000000 + i LEFT JOIN docs_v a ON a.id = d * 1000000 + i - 1 AND i > 0),
c AS (SELECT d, i, n, text, CASE WHEN n > 2 AND i > 0 AND round({_COSINE.replace('a.v', 'av').replace('b.v', 'bv')}, 6) < 0.2 THEN 1 ELSE 0 END AS cut FROM pairs),
r AS (SELECT *, sum(cut) OVER (PARTITION BY d ORDER BY i) AS run FROM c), p AS (SELECT *, row_number() OVER (PARTITION BY d, run ORDER BY i) - 1 AS pos FROM r),
g AS (SELECT d, run, CASE WHEN n > 2 THEN pos // 9 ELSE 0 END AS k, min(i) AS a, max(i) AS b, string_agg(text, ' ' ORDER BY i) AS t FROM p GROUP BY ALL)"""


@query(f"WITH {_SEMANTIC} SELECT d AS doc_id, CAST(row_number() OVER (PARTITION BY d ORDER BY a) - 1 AS INTEGER) AS chunk_id, CAST(a AS INTEGER) AS start_sentence, CAST(b AS INTEGER) AS end_sentence, md5(t) AS text_md5 FROM g")
def semantic_chunks(spark, sf_dir):
    chunks = chunking.semantic_chunks(documents(spark, sf_dir), threshold=0.2)
    return chunks.select("doc_id", "chunk_id", "start_sentence", "end_sentence", F.md5("text").alias("text_md5"))


@query(f"""WITH {_WINDOWS}, n AS (SELECT 'none' AS strategy, len(text) AS n FROM documents WHERE regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> '' UNION ALL SELECT 'sentence', len(text) FROM chunks)
SELECT strategy, count(*) AS n_chunks, CAST(min(n) AS INTEGER) AS min_chars, CAST(max(n) AS INTEGER) AS max_chars, round(avg(n), 6) AS mean_chars, count(*) FILTER (n + 100 > 4000) AS over_4k, count(*) FILTER (n + 100 > 10000) AS over_10k, count(*) FILTER (n + 100 > 20000) AS over_20k FROM n GROUP BY strategy""")
def request_size_profile(spark, sf_dir):
    docs = documents(spark, sf_dir)
    both = chunking.no_chunks(docs).select("strategy", "text").union(chunking.sentence_chunks(docs).select("strategy", "text")).withColumn("n", F.length("text"))
    over = lambda n: F.count_if(F.col("n") + 100 > n)
    return both.groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.min("n").alias("min_chars"), F.max("n").alias("max_chars"), F.round(F.avg("n"), 6).alias("mean_chars"), over(4000).alias("over_4k"), over(10_000).alias("over_10k"), over(20_000).alias("over_20k"))


@query(f"""WITH s AS (SELECT conv_id, turn, {_judge_sentences("coalesce(text, '')")} AS s FROM conversations)
SELECT conv_id, turn, CAST(len(s) AS INTEGER) AS n_sentences, md5(array_to_string(list_transform(range(1, len(s) + 1), lambda i: chr(CAST(96 + i AS INTEGER)) || '. ' || s[i]), chr(10))) AS keyed_md5 FROM s""")
def keyed_sentences(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    return said.select("conv_id", "turn", F.size(text.judge_sentences(F.col("text"))).alias("n_sentences"), F.md5(text.keyed_response(F.coalesce("text", F.lit("")))).alias("keyed_md5"))


def _sql_normal(of: str) -> str:
    out = f"lower({of})"
    for p, to in (("\\*\\*([^*]+)\\*\\*", "\\1"), ("\\*([^*]+)\\*", "\\1"), ("__([^_]+)__", "\\1"), ("_([^_]+)_", "\\1"), ("[–—−]", "-"), ('["„]', '"'), ("[''`]", "''"), ("\\s+", " ")):
        out = f"regexp_replace({out}, '{p}', '{to}', 'g')"
    return f"trim({out}, ' ')"


@query(f"SELECT doc_id, md5({_sql_normal('text')}) AS normal_md5, contains({_sql_normal('text')}, 'token = \"') AS has_answer FROM documents")
def normalize_answers(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", F.md5(text.normalized_answer(F.col("text"), True)).alias("normal_md5"), text.contains_answer(F.col("text"), F.array(F.lit('TOKEN  = "')), True).alias("has_answer"))


_ANSWER = "text || CASE WHEN doc_id % 3 = 0 THEN ' I cannot answer this.' WHEN doc_id % 3 = 1 THEN ' It is not accurate.' ELSE '' END"
_PHRASES = {k: " OR ".join("contains(lower(r), '" + p.replace("'", "''") + "')" for p in v) for k, v in (("r", text.REJECTION_PHRASES), ("e", text.ERROR_PHRASES))}


@query(f"SELECT doc_id, {_PHRASES['r']} AS rejected, {_PHRASES['e']} AS error_detected FROM (SELECT doc_id, {_ANSWER} AS r FROM documents)")
def response_checks(spark, sf_dir):
    said = documents(spark, sf_dir).select("doc_id", F.expr(_ANSWER).alias("r"))
    return said.select("doc_id", text.is_rejection(F.col("r")).alias("rejected"), text.detects_error(F.col("r")).alias("error_detected"))


_THOUGHT = "'<think>' || text || '</THINK>' || chr(10) || chr(10) || chr(10) || chr(10) || text || '<reasoning>x</reasoning> '"


@query(f"SELECT doc_id, md5({_TRIM.format('''regexp_replace(regexp_replace(t, '(?is)<(think|reasoning)>.*?</(think|reasoning)>', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')''')}) AS said_md5 FROM (SELECT doc_id, {_THOUGHT} AS t FROM documents)")
def strip_reasoning(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(text.without_reasoning(F.expr(_THOUGHT))).alias("said_md5"))


_JUDGED = r"""CASE event_id % 6 WHEN 0 THEN '```json {"all_relevant_sentence_keys": ["0a", "' || user_id || 'b"], "overall_supported": true, "all_utilized_sentence_keys": ["0a"]} ```'
WHEN 1 THEN 'Sure: {"all_relevant_sentence_keys": ["1a"], "overall_supported": false, "all_utilized_sentence_keys": []} Done' WHEN 2 THEN props
WHEN 3 THEN '{"relevance_explanation": "a \\_bad\\_ escape \\"' || event_id || '\\" costs \\$5", "all_relevant_sentence_keys": ["' || user_id || 'a"], "overall_supported": true, "all_utilized_sentence_keys": ["3\\u0062"]}'
WHEN 4 THEN 'no judgement at all' ELSE '{"all_relevant_sentence_keys": ["2a", "3b"], "overall_supported": true, "all_utilized_sentence_keys": ["' || user_id || 'c"], broken' END"""
_JUDGED_SQL = _JUDGED.replace("\\\\", "\\")
_TRIES = ", ".join(f"CASE WHEN json_valid({t}) AND starts_with({t}, chr(123)) THEN CAST({t} AS JSON) END" for t in ("c", "o", r"regexp_replace(o, '(\\[nrtbf\"\\/u])|\\(.)', '\1\2', 'gs')"))


def _judge_keys(field: str) -> str:
    fallback = rf"""regexp_extract_all(regexp_extract(c, '"{field}"\s*:\s*\[(.*?)\]', 1, 's'), '"(\d+[a-z])"', 1)"""
    return f"array_to_string(CASE WHEN j IS NULL THEN {fallback} ELSE coalesce(CAST(json_extract(j, '$.{field}') AS VARCHAR[]), []) END, '|')"


@query(rf"""WITH e AS (SELECT event_id, trim(regexp_replace(regexp_replace(trim({_JUDGED_SQL}), '^```(json)?', ''), '```$', '')) AS c FROM events),
o AS (SELECT *, coalesce(nullif(regexp_extract(c, '\{{.*\}}', 0, 's'), ''), c) AS o FROM e), j AS (SELECT *, coalesce({_TRIES}) AS j FROM o)
SELECT event_id, {_judge_keys('all_relevant_sentence_keys')} AS relevant, {_judge_keys('all_utilized_sentence_keys')} AS utilized,
CASE WHEN j IS NULL THEN regexp_matches(lower(c), '"overall_supported": ?true') ELSE coalesce(CAST(json_extract(j, '$.overall_supported') AS BOOLEAN), false) END AS supported,
CASE WHEN j IS NULL THEN CASE c WHEN '' THEN '' ELSE '(extracted via fallback)' END ELSE coalesce(json_extract_string(j, '$.relevance_explanation'), '') END AS explanation FROM j""")
def judge_json_parse(spark, sf_dir):
    said = table(spark, sf_dir, "events").select("event_id", judge_json.parsed_judgement(F.expr(_JUDGED)).alias("j"))
    return said.select("event_id", F.array_join("j.all_relevant_sentence_keys", "|").alias("relevant"), F.array_join("j.all_utilized_sentence_keys", "|").alias("utilized"), F.col("j.overall_supported").alias("supported"), F.col("j.relevance_explanation").alias("explanation"))


@query(f"""WITH {_BM25}, h AS (SELECT query_id, doc_id, score, rank FROM ({_RANKED.format('bm25 WHERE round(score, 6) > 0', 5)})),
c AS (SELECT a.item_id AS query_id, any_value(a.text) AS question, coalesce(list(d.text ORDER BY h.rank) FILTER (h.rank IS NOT NULL), []) AS ts, coalesce(list(h.score ORDER BY h.rank) FILTER (h.rank IS NOT NULL), []) AS ss
      FROM benchmark a LEFT JOIN h ON h.query_id = a.item_id LEFT JOIN documents d ON d.doc_id = h.doc_id GROUP BY a.item_id),
m AS (SELECT *, CASE WHEN len(ts) = 0 THEN 'No relevant context found.' ELSE array_to_string(list_transform(range(1, len(ts) + 1), lambda i: '[Document ' || i || '] (relevance: ' || printf('%.2f', ss[i]) || ')' || chr(10) || ts[i]), chr(10) || chr(10)) END AS ranked,
      array_to_string(list_transform(range(1, len(ts) + 1), lambda i: 'Document ' || i || ': ' || ts[i]), chr(10)) AS numbered FROM c)
SELECT query_id, CAST(len(ts) AS INTEGER) AS n_documents, md5(ranked) AS context_md5, md5('Context Documents:' || chr(10) || ranked || chr(10) || chr(10) || 'Question: ' || question) AS user_md5,
md5('External Documents:' || chr(10) || numbered || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Please answer the question based on the provided documents.') AS documents_md5,
md5('Answer this question: ' || question) AS bare_md5, len(ranked) + len(question) > 20000 AS too_long FROM m""")
def prompt_context(spark, sf_dir):
    """The prompts of every benchmark item over its five best documents."""
    docs, asks = docs_and_asks(spark, sf_dir)
    hits = retrieval.retrieve(docs, asks)
    texts = hits.join(docs.select("doc_id", "text"), "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "score"))).alias("chunks"))
    rows = asks.withColumnRenamed("text", "question").join(texts, "query_id", "left")
    rows = rows.withColumn("chunks", F.coalesce("chunks", F.array().cast("array<struct<rank:int,text:string,score:double>>")))
    rows = rows.withColumn("ranked", prompts.ranked_context(F.col("chunks")))
    numbered = prompts.documents_prompt(F.transform("chunks", lambda c: c["text"]), F.col("question"))
    return rows.select(
        "query_id", F.size("chunks").alias("n_documents"), F.md5("ranked").alias("context_md5"), F.md5(prompts.user_prompt(F.col("ranked"), F.col("question"))).alias("user_md5"),
        F.md5(numbered).alias("documents_md5"), F.md5(prompts.bare_prompt(F.col("question"))).alias("bare_md5"), prompts.too_long(F.col("ranked"), F.col("question")).alias("too_long"),
    )


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, CAST(repeat('[', d) || to_json(coalesce(text, '')) || ', [[' || to_json(role || ' "' || turn || '"') || ']], ' || turn || ', []' || repeat(']', d) AS JSON) AS j FROM (SELECT *, 1 + (conv_id + turn) % 6 AS d FROM conversations)),
r(conv_id, turn, j) AS (SELECT * FROM s UNION ALL SELECT conv_id, turn, unnest(CAST(j AS JSON[])) FROM r WHERE json_type(j) = 'ARRAY')
SELECT conv_id, turn, count(*) AS n, md5(string_agg(j ->> '$', '|' ORDER BY j ->> '$')) AS texts_md5 FROM r WHERE json_type(j) <> 'ARRAY' GROUP BY conv_id, turn""")
def nested_answers(spark, sf_dir):
    """Expected answers that are nested one to eight lists deep."""
    said = table(spark, sf_dir, "conversations").withColumn("d", (1 + (F.col("conv_id") + F.col("turn")) % 6).cast("int"))
    quoted = lambda x: F.to_json(F.array(x))
    json = F.concat(F.repeat(F.lit("["), F.col("d") - 1), F.regexp_replace(quoted(F.coalesce("text", F.lit(""))), r"\]$", ", ["), quoted(F.concat("role", F.lit(' "'), F.col("turn").cast("string"), F.lit('"'))), F.lit("], "), F.col("turn").cast("string"), F.lit(", []"), F.repeat(F.lit("]"), F.col("d")))
    flat = text.flat_answers(F.parse_json(json))
    return said.select("conv_id", "turn", F.size(flat).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(flat), "|")).alias("texts_md5"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn with the turn before it as its question."""
    said = table(spark, sf_dir, "conversations")
    return said.withColumn("question", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant' AND question IS NOT NULL")


@query(f"""WITH p AS (SELECT * FROM (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations) WHERE role = 'assistant' AND question IS NOT NULL),
t AS (SELECT conv_id, turn, {_TOKENS.format('question')} AS q, {_TOKENS.format('text')} AS a, len({_judge_sentences('text')}) AS n FROM p),
k AS (SELECT conv_id, turn, n, list_distinct(q) AS r, list_distinct(a) AS u FROM t),
s AS (SELECT conv_id, turn, CASE WHEN n > 0 THEN least(len(r) / n, 1.0) ELSE 0 END AS x, CASE WHEN n > 0 THEN least(len(u) / n, 1.0) ELSE 0 END AS y, CASE WHEN n > 0 AND len(r) > 0 THEN len(list_intersect(r, u)) / len(r) ELSE 0 END AS z, CASE WHEN len(list_intersect(r, u)) > 0 THEN 1.0 ELSE 0.0 END AS w FROM k)
SELECT conv_id, turn, round(x, 6) AS context_relevance, round(y, 6) AS context_utilization, round(z, 6) AS completeness, w::DOUBLE AS adherence, round((x + y + z + w) / 4, 6) AS trace FROM s""")
def trace_metrics(spark, sf_dir):
    q, a = text.content_tokens(F.col("question")), text.content_tokens(F.col("text"))
    s = _pairs(spark, sf_dir).withColumn("s", trace_scores(q, a, F.arrays_overlap(q, a), F.size(text.judge_sentences(F.col("text")))))
    names = ("context_relevance", "context_utilization", "completeness", "adherence")
    return s.select("conv_id", "turn", *(F.round(f"s.{n}", 6).alias(n) for n in names), F.round(trace_average(*(F.col(f"s.{n}") for n in names)), 6).alias("trace"))


def _h(*keys: str) -> str:
    return "md5(concat_ws('|', '42', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "))"


@query(f"SELECT source, doc_id, CAST(place AS INTEGER) AS place, place > 10 AS is_backup FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_h('source', 'doc_id')}, doc_id) AS place FROM documents) WHERE place <= 30")
def sample_pool(spark, sf_dir):
    return sampling.pool(table(spark, sf_dir, "documents"), "source", "doc_id", 10).select("source", "doc_id", "place", "is_backup")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality IN (0, 1)")
    return rows.select(F.col("source").alias("id"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("kind"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("document"))


@query("""WITH r AS (SELECT source AS id, quality, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS d FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)),
n AS (SELECT id, d, CASE quality WHEN 1 THEN 'positive' ELSE 'negative' END AS k, row_number() OVER (PARTITION BY id, quality ORDER BY d) - 1 AS i FROM r),
h AS (SELECT *, md5(concat_ws('|', '42', id, k, CAST(i AS VARCHAR))) AS h FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY h, d) AS place FROM h)
SELECT id, string_agg(d, '|' ORDER BY h, d) FILTER (place <= CASE k WHEN 'negative' THEN 2 ELSE 3 END) AS documents FROM p GROUP BY id""")
def noise_mix(spark, sf_dir):
    return sampling.noise_mix_of_rows(_records(spark, sf_dir), 0.4).select("id", F.array_join("documents", "|").alias("documents"))


_RESULTS = "SELECT doc_id, source, lang, (n_chars % 101) / 100.0 AS a, (n_chars % 89) / 88.0 AS b, quality, toxic FROM documents JOIN labels USING (doc_id)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Example results in place of a model's: scores are features of documents, the truth comes from labels."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    a, b = F.col("n_chars") % 101 / 100.0, F.col("n_chars") % 89 / 88.0
    scores = {"computed_relevance": a, "computed_utilization": b, "computed_completeness": a * b, "computed_adherence": F.col("quality").cast("double"), "gt_relevance": b, "gt_utilization": a, "gt_completeness": F.lit(0.5), "gt_adherence": F.lit(1.0)}
    return rows.select("doc_id", "source", "lang", "quality", "toxic", (F.col("toxic") == 0).alias("is_valid"), *(v.alias(k) for k, v in scores.items()))


@query(f"""SELECT source, count(*) AS n, count(*) FILTER (toxic = 0) AS n_valid, round(avg(a) FILTER (toxic = 0), 6) AS computed_relevance, round(avg(b) FILTER (toxic = 0), 6) AS computed_utilization, round(avg(a * b) FILTER (toxic = 0), 6) AS computed_completeness,
round(sqrt(avg((a - b) * (a - b)) FILTER (toxic = 0)), 6) AS rmse_relevance, round(sqrt(avg((a * b - 0.5) * (a * b - 0.5)) FILTER (toxic = 0)), 6) AS rmse_completeness,
round((avg(a) FILTER (toxic = 0) + avg(b) FILTER (toxic = 0) + avg(a * b) FILTER (toxic = 0) + avg(quality) FILTER (toxic = 0)) / 4, 6) AS avg_trace FROM ({_RESULTS}) GROUP BY source""")
def config_aggregate(spark, sf_dir):
    out = aggregation.config_results(_results(spark, sf_dir), ["source"])
    names = ("computed_relevance", "computed_utilization", "computed_completeness", "rmse_relevance", "rmse_completeness", "avg_trace")
    return out.select("source", "n", "n_valid", *(F.round(c, 6).alias(c) for c in names))


@query(f"""WITH c AS (SELECT lang, count(*) FILTER (a >= 0.5 AND quality = 1) AS tp, count(*) FILTER (a >= 0.5 AND quality = 0) AS fp, count(*) FILTER (a < 0.5 AND quality = 1) AS fn FROM ({_RESULTS}) GROUP BY lang)
SELECT lang, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def classification_metrics(spark, sf_dir):
    out = aggregation.classification(_results(spark, sf_dir), ["lang"], (F.col("computed_relevance") >= 0.5).cast("int"), F.col("quality"))
    return out.select("lang", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"""WITH r AS ({_RESULTS}), g AS (SELECT lang, a, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 0) AS n FROM r GROUP BY lang, a),
w AS (SELECT x.lang, sum(x.p * y.n * CASE WHEN x.a > y.a THEN 1.0 WHEN x.a = y.a THEN 0.5 ELSE 0 END) AS s FROM g x JOIN g y ON x.lang = y.lang GROUP BY x.lang), t AS (SELECT lang, sum(p) AS p, sum(n) AS n FROM g GROUP BY lang)
SELECT lang, round(CASE WHEN p > 0 AND n > 0 THEN s / (p * n) ELSE 0.5 END, 6) AS auroc FROM w JOIN t USING (lang)""")
def auroc(spark, sf_dir):
    return aggregation.auroc(_results(spark, sf_dir), ["lang"], F.col("computed_relevance"), F.col("quality")).select("lang", F.round("auroc", 6).alias("auroc"))


@query("SELECT source, count(*) AS samples, round(avg(len(coalesce(text, ''))), 6) AS mean_chars, count(DISTINCT lang) AS langs, round(avg(CASE WHEN n_chars % 2 = 1 THEN 1.0 ELSE 0.0 END), 6) AS odd_share FROM documents GROUP BY source")
def domain_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("samples"), F.round(F.avg(F.length(F.coalesce("text", F.lit("")))), 6).alias("mean_chars"), F.countDistinct("lang").alias("langs"), F.round(F.avg((F.col("n_chars") % 2 == 1).cast("double")), 6).alias("odd_share"))


@query(f"""WITH r AS (SELECT lang, doc_id % 5 AS k, round(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS rate FROM ({_RESULTS}) GROUP BY ALL)
SELECT lang, any_value(rate) FILTER (k = 0) AS at_0, any_value(rate) FILTER (k = 1) AS at_1, any_value(rate) FILTER (k = 2) AS at_2, any_value(rate) FILTER (k = 3) AS at_3, any_value(rate) FILTER (k = 4) AS at_4, round(avg(rate), 6) AS mean FROM r GROUP BY lang""")
def ability_pivot(spark, sf_dir):
    rows = _results(spark, sf_dir).withColumn("ratio", F.col("doc_id") % 5)
    return aggregation.pivoted(aggregation.ability_rates(rows, ["lang", "ratio"], F.col("quality") == 1), "lang", "ratio", "rate", [0, 1, 2, 3, 4])


@query(f"""WITH c AS (SELECT lang, source, round(avg(a), 6) AS score FROM ({_RESULTS}) GROUP BY lang, source) SELECT lang, source, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, source) AS r FROM c) WHERE r = 1""")
def best_per_domain(spark, sf_dir):
    scores = _results(spark, sf_dir).groupBy("lang", "source").agg(F.round(F.avg("computed_relevance"), 6).alias("score"))
    return aggregation.best_by(scores, ["lang"], "score", "source")


@query(f"""WITH c AS (SELECT source, count(*) AS total, count(*) FILTER (a = 0 AND b = 0 AND quality = 0) AS zeros, count(*) FILTER (toxic = 0) AS valid FROM ({_RESULTS}) GROUP BY source)
SELECT *, CASE WHEN total <> 10 THEN 'less_than_10' WHEN zeros = total THEN 'all_zeros' WHEN zeros > 0 THEN 'partial_zeros' ELSE 'ok' END AS status FROM c""")
def checkpoint_health(spark, sf_dir):
    return aggregation.health(_results(spark, sf_dir), ["source"])


@query("""SELECT source, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 20 THEN 'done' WHEN coalesce(n, 0) > 0 THEN 'begun' ELSE 'not begun' END AS state
FROM (SELECT DISTINCT source FROM documents) LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source) USING (source)""")
def evaluation_progress(spark, sf_dir):
    return aggregation.progress(table(spark, sf_dir, "documents").select("source").distinct(), _results(spark, sf_dir), "source", 20)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return not_indexed(docs, table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT coalesce(nullif(CAST(conv_id AS VARCHAR), '0'), role || '_' || (row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1)) AS id, turn, role AS domain, text AS question, 0.5::DOUBLE AS context_relevance, CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS adherence FROM conversations""")
def standardize_samples(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    made = said.select("conv_id", "turn", "role", (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("at"), F.parse_json(F.to_json(F.struct(F.col("conv_id").alias("idx"), F.col("text").alias("query"), (F.col("turn") % 2 == 0).alias("adherence"), "turn"))).alias("record"))
    out = standardized(made, F.col("role"), "at")
    return out.select("id", F.variant_get("original", "$.turn", "bigint").alias("turn"), "domain", "question", "context_relevance", "adherence")


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Samples that ask every source's documents the benchmark items in turn, and the documents by example.

    Items are dealt to sources by turns until every item is asked and every source has an item. A corpus is the beginning of a source's
    documents in order of doc_id, as far as a context takes it.
    """
    docs, asks = docs_and_asks(spark, sf_dir)
    items = asks.select((F.row_number().over(Window.orderBy("query_id")) - 1).cast("long").alias("item"), "query_id", F.col("text").alias("question"))
    sized = docs.select("source", "doc_id", "text", (F.length(F.coalesce("text", F.lit(""))) + 2).cast("long").alias("size"))
    # the documents of a corpus are those that begin before its end, each of which is two characters long at least
    head = running_before(sized, ["source"], "doc_id", "size", "before").where(F.col("before") < 2000)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 2000).alias("text")))), lambda x: x["text"]), "\n\n")
    groups = head.groupBy(F.col("source").alias("example_id")).agg(F.substring(joined, 1, 2000).alias("corpus"))
    groups = groups.withColumn("place", (F.row_number().over(Window.orderBy("example_id")) - 1).cast("long"))
    n_items, n_groups = items.count(), docs.select("source").distinct().count()
    turns = spark.range(max(n_items, n_groups) if n_items and n_groups else 0).select(F.col("id").alias("sample_id"), (F.col("id") % max(1, n_items)).alias("item"), (F.col("id") % max(1, n_groups)).alias("place"))
    samples = turns.join(items, "item").join(groups, "place")
    samples = samples.select("sample_id", "example_id", "query_id", "question", "corpus", *(F.lit(0.5).alias(f"gt_{s}") for s in aggregation.SCORES))
    return samples, docs.select(F.col("source").alias("example_id"), "doc_id", "text")


# SQL of an evaluation: samples, chunks by strategy, a leg for each method, configurations, answers, judgements, scores
_LEG = "{0} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, sample_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT strategy, sample_id, chunk_id, round(score, 6) AS score FROM {1}) {2}) WHERE rank <= 10)"
_EVALUATION = f"""items AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS item, item_id AS query_id, text AS question FROM benchmark),
heads AS (SELECT source, doc_id, text, coalesce(sum(len(coalesce(text, '')) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents),
corpora AS (SELECT source AS example_id, row_number() OVER (ORDER BY source) - 1 AS place, substr(string_agg(substr(coalesce(text, ''), 1, 2000), chr(10) || chr(10) ORDER BY doc_id), 1, 2000) AS corpus FROM heads WHERE before < 2000 GROUP BY source),
samples AS (SELECT sample_id, example_id, query_id, question, corpus, {_TOKENS.format('question')} AS qs FROM (SELECT unnest(range(greatest((SELECT count(*) FROM items), (SELECT count(*) FROM corpora)))) AS sample_id)
            JOIN items ON item = sample_id % (SELECT count(*) FROM items) JOIN corpora ON place = sample_id % (SELECT count(*) FROM corpora)),
{_WINDOWS},
parts AS (SELECT 'sentence' AS strategy, doc_id, doc_id || '_' || chunk_id AS chunk_id, text FROM chunks UNION ALL SELECT 'none', doc_id, doc_id || '_0', text FROM documents WHERE regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> ''),
cs AS (SELECT strategy, source AS example_id, chunk_id, parts.text, {_TOKENS.format('parts.text')} AS ts FROM parts JOIN documents USING (doc_id)),
n AS (SELECT strategy, example_id, count(*) AS n, avg(len(ts)) AS mean FROM cs GROUP BY ALL),
tf AS (SELECT strategy, example_id, chunk_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT strategy, example_id, chunk_id, len(ts) AS length, unnest(ts) AS term FROM cs) GROUP BY ALL),
df AS (SELECT strategy, example_id, term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT sample_id, example_id, term, count(*) AS qtf FROM (SELECT sample_id, example_id, unnest(qs) AS term FROM samples) GROUP BY ALL),
bm AS (SELECT strategy, sample_id, chunk_id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean))) AS score FROM q JOIN tf USING (example_id, term) JOIN df USING (strategy, example_id, term) JOIN n USING (strategy, example_id) GROUP BY ALL),
ww AS (SELECT strategy, example_id, chunk_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (strategy, example_id, term) JOIN n USING (strategy, example_id)),
l AS (SELECT strategy, example_id, chunk_id, sqrt(sum(w * w)) AS norm FROM ww GROUP BY ALL),
qw AS (SELECT strategy, sample_id, example_id, term, qtf * (ln((1 + n) / (1 + df)) + 1) AS q FROM q JOIN df USING (example_id, term) JOIN n USING (strategy, example_id)),
qn AS (SELECT *, q / sqrt(sum(q * q) OVER (PARTITION BY strategy, sample_id)) AS u FROM qw),
ti AS (SELECT strategy, sample_id, chunk_id, sum(w * u) / any_value(norm) AS score FROM ww JOIN qn USING (strategy, example_id, term) JOIN l USING (strategy, example_id, chunk_id) GROUP BY ALL),
hc AS (SELECT strategy, example_id, chunk_id, CAST(concat('0x', substr(md5(t), 1, 8)) AS BIGINT) % 64 AS b, sum(CASE WHEN substr(md5(t), 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM (SELECT strategy, example_id, chunk_id, unnest(ts) AS t FROM cs) GROUP BY ALL),
hq AS (SELECT sample_id, example_id, CAST(concat('0x', substr(md5(t), 1, 8)) AS BIGINT) % 64 AS b, sum(CASE WHEN substr(md5(t), 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM (SELECT sample_id, example_id, unnest(qs) AS t FROM samples) GROUP BY ALL),
dots AS (SELECT strategy, chunk_id, sample_id, sum(hc.v * hq.v) AS d FROM hc JOIN hq USING (example_id, b) GROUP BY ALL),
lc AS (SELECT strategy, chunk_id, sqrt(sum(v * v)) AS l FROM hc GROUP BY ALL), lq AS (SELECT sample_id, sqrt(sum(v * v)) AS m FROM hq GROUP BY ALL),
de AS (SELECT strategy, sample_id, chunk_id, coalesce(CASE WHEN l > 0 AND m > 0 THEN d / (l * m) END, 0) AS score FROM cs JOIN samples USING (example_id) LEFT JOIN dots USING (strategy, chunk_id, sample_id) LEFT JOIN lc USING (strategy, chunk_id) LEFT JOIN lq USING (sample_id)),
{_LEG.format('bml', 'bm', 'WHERE score > 0')}, {_LEG.format('til', 'ti', 'WHERE score > 0')}, {_LEG.format('del', 'de', '')},
fu AS (SELECT sample_id, chunk_id, round(sum(p), 6) AS score FROM (SELECT sample_id, chunk_id, 0.5::DOUBLE / (60 + rank) AS p FROM del WHERE strategy = 'sentence' UNION ALL SELECT sample_id, chunk_id, 0.5::DOUBLE / (60 + rank) FROM til WHERE strategy = 'sentence') GROUP BY ALL),
hits AS (SELECT 'sparse_sentence_bm25' AS config, 'sentence' AS strategy, sample_id, chunk_id, rank FROM bml WHERE strategy = 'sentence' UNION ALL SELECT 'sparse_none_tfidf', strategy, sample_id, chunk_id, rank FROM til WHERE strategy = 'none'
         UNION ALL SELECT 'dense_sentence_hashed', strategy, sample_id, chunk_id, rank FROM del WHERE strategy = 'sentence' UNION ALL SELECT 'hybrid_sentence_hashed', 'sentence', sample_id, chunk_id, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, chunk_id) FROM fu),
got AS (SELECT config, sample_id, list(text ORDER BY rank) AS ds FROM hits JOIN cs USING (strategy, chunk_id) WHERE rank <= 5 GROUP BY ALL),
asked AS (SELECT s.*, config, coalesce(ds, []) AS ds, coalesce(nullif(array_to_string(coalesce(ds, []), chr(10) || chr(10)), ''), substr(corpus, 1, 2000)) AS context FROM samples s CROSS JOIN (SELECT unnest(['sparse_sentence_bm25', 'sparse_none_tfidf', 'dense_sentence_hashed', 'hybrid_sentence_hashed']) AS config) LEFT JOIN got USING (config, sample_id)),
told AS (SELECT *, len(context) + len(question) > 20000 AS is_skipped, {_judge_sentences('context')} AS ss FROM asked),
picked AS (SELECT config, sample_id, first(s ORDER BY shared DESC, i) AS s FROM (SELECT config, sample_id, i, s, len(list_intersect(list_distinct(qs), list_distinct({_TOKENS.format('s')}))) AS shared FROM (SELECT config, sample_id, qs, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM told)) GROUP BY ALL),
answered AS (SELECT told.*, CASE WHEN NOT is_skipped THEN coalesce(s, '') END AS response, {_TOKENS.format("coalesce(s, '')")} AS rs, {_judge_sentences("coalesce(s, '')")} AS rss FROM told LEFT JOIN picked USING (config, sample_id)),
keyed AS (SELECT config, sample_id, qs, rs, {_TOKENS.format('s')} AS ts FROM (SELECT config, sample_id, qs, rs, unnest({_judge_sentences('d')}) AS s FROM (SELECT config, sample_id, qs, rs, unnest(ds) AS d FROM answered))),
near AS (SELECT config, sample_id, flatten(list(ts)) AS every, count(*) AS total, count(*) FILTER (a) AS r, count(*) FILTER (b) AS u, count(*) FILTER (a AND b) AS x
         FROM (SELECT *, len(list_intersect(list_distinct(ts), list_distinct(qs))) >= 2 AS a, len(list_intersect(list_distinct(ts), list_distinct(rs))) >= 2 AS b FROM keyed) GROUP BY ALL),
judged AS (SELECT answered.*, coalesce(total, 0) AS total, CASE WHEN is_skipped THEN 0 ELSE coalesce(r, 0) END AS r, CASE WHEN is_skipped THEN 0 ELSE coalesce(u, 0) END AS u, CASE WHEN is_skipped THEN 0 ELSE coalesce(x, 0) END AS x,
           NOT is_skipped AND len(list_filter(rss, lambda t: NOT list_has_any({_TOKENS.format('t')}, coalesce(every, [])))) = 0 AS supported FROM answered LEFT JOIN near USING (config, sample_id)),
rated AS (SELECT *, CASE WHEN total > 0 THEN least(r / total, 1.0) ELSE 0.0 END::DOUBLE AS c1, CASE WHEN total > 0 THEN least(u / total, 1.0) ELSE 0.0 END::DOUBLE AS c2, CASE WHEN total > 0 AND r > 0 THEN x / r ELSE 0.0 END::DOUBLE AS c3, CASE WHEN supported THEN 1.0 ELSE 0.0 END::DOUBLE AS c4 FROM judged),
evaluated AS (SELECT sample_id, example_id, query_id, response AS generated_response, round(c1, 6) AS computed_relevance, round(c2, 6) AS computed_utilization, round(c3, 6) AS computed_completeness, c4 AS computed_adherence, NOT is_skipped AS is_valid, is_skipped,
              CASE WHEN is_skipped THEN 'context too long' END AS error, config, round((round(c1, 6) + round(c2, 6) + round(c3, 6) + c4) / 4, 6) AS trace FROM rated)"""


@query(f"""WITH {_EVALUATION} SELECT e.* EXCLUDE (sample_id), 0.5::DOUBLE AS gt_relevance, 0.5::DOUBLE AS gt_utilization, 0.5::DOUBLE AS gt_completeness, 0.5::DOUBLE AS gt_adherence FROM evaluated e WHERE config = 'sparse_sentence_bm25'""")
def end_to_end_eval(spark, sf_dir):
    """Every sample through retrieval (sparse, sentences, BM25), the offline answer and judgement, and scores."""
    samples, docs = _samples(spark, sf_dir)
    return evaluate_configs(samples, docs, [("sparse", "sentence", "bm25")]).drop("sample_id", "corpus", "question", "retrieved_chunks")


@query(f"""WITH {_EVALUATION} SELECT config, count(*) AS n, count(*) FILTER (is_valid) AS n_valid, round(avg(computed_relevance) FILTER (is_valid), 6) AS avg_relevance, round(avg(computed_utilization) FILTER (is_valid), 6) AS avg_utilization,
round(avg(computed_completeness) FILTER (is_valid), 6) AS avg_completeness, round(avg(computed_adherence) FILTER (is_valid), 6) AS avg_adherence,
round((avg(computed_relevance) FILTER (is_valid) + avg(computed_utilization) FILTER (is_valid) + avg(computed_completeness) FILTER (is_valid) + avg(computed_adherence) FILTER (is_valid)) / 4, 6) AS avg_trace FROM evaluated GROUP BY config""")
def grid_eval(spark, sf_dir):
    """Configuration results of sparse, dense and hybrid configurations over whole documents and sentence windows, in one plan."""
    samples, docs = _samples(spark, sf_dir)
    grid = [("sparse", "sentence", "bm25"), ("sparse", "none", "tfidf"), ("dense", "sentence", "hashed"), ("hybrid", "sentence", "hashed")]
    out = aggregation.config_results(evaluate_configs(samples, docs, grid, {"hashed": HashingEmbedder()}), ["config"])
    return out.select("config", "n", "n_valid", *(F.round(f"computed_{s}", 6).alias(f"avg_{s}") for s in aggregation.SCORES), F.round("avg_trace", 6).alias("avg_trace"))


@query(f"WITH v AS ({_VECTORS}), n AS (SELECT id, v, lead(v) OVER (ORDER BY id) AS nv FROM v) SELECT a.id AS vec_id, round({_COSINE.replace('b.v', 'a.nv')}, 6) AS similarity FROM n a WHERE nv IS NOT NULL")
def consecutive_similarity(spark, sf_dir):
    """Each vector and the one next in order of vec_id, whatever gaps the ids have."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    pairs = with_next(v, "vec_id", "v")
    return pairs.where("next_v IS NOT NULL").select("vec_id", F.round(cosine(F.col("v"), F.col("next_v")), 6).alias("similarity"))


_CONFIGS = f"""SELECT source, count(*) AS n, count(*) FILTER (toxic = 0) AS n_valid, round((avg(a) FILTER (toxic = 0) + avg(b) FILTER (toxic = 0) + avg(a * b) FILTER (toxic = 0) + avg(quality) FILTER (toxic = 0)) / 4, 6) AS avg_trace FROM ({_RESULTS}) GROUP BY source"""


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregation.config_results(_results(spark, sf_dir), ["source"]).select("source", "n", "n_valid", F.round("avg_trace", 6).alias("avg_trace"))


@query(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY avg_trace DESC NULLS LAST, source) AS INTEGER) AS rank FROM ({_CONFIGS})) WHERE rank <= 10")
def top_configs(spark, sf_dir):
    return compare.ranked(_configs(spark, sf_dir), "avg_trace", "source", n=10)


@query(f"""SELECT sum(n)::BIGINT AS total, sum(n_valid)::BIGINT AS valid, (sum(n) - sum(n_valid))::BIGINT AS failed, round(100.0 * sum(n_valid) / sum(n), 6) AS valid_percent,
round(100.0 * (sum(n) - sum(n_valid)) / sum(n), 6) AS failed_percent FROM ({_CONFIGS})""")
def evaluation_statistics(spark, sf_dir):
    return compare.statistics(_configs(spark, sf_dir))


@query("""SELECT count(*) AS total, count(*) FILTER (n >= 20) AS done, count(*) FILTER (n > 0 AND n < 20) AS begun, count(*) FILTER (n = 0) AS not_begun, round(100.0 * count(*) FILTER (n >= 20) / count(*), 6) AS percent,
CAST(sum(least(n, 20)) AS BIGINT) AS examples, CAST(2.0 * (count(*) * 20 - sum(least(n, 20))) AS DOUBLE) AS seconds_left FROM (SELECT d.source, coalesce(r.n, 0) AS n FROM (SELECT DISTINCT source FROM documents) d
LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source) r USING (source))""")
def progress_totals(spark, sf_dir):
    return compare.progress_totals(evaluation_progress(spark, sf_dir), 20, 2.0)


@query(f"""SELECT lang, source, score, CASE WHEN k % 3 = 0 THEN 'Sparse (' || source || ') optimal - lexical matching effective' WHEN k % 3 = 1 THEN 'Hybrid (' || source || ') optimal - benefits from semantic + lexical'
ELSE 'Dense (' || source || ') optimal - semantic understanding is key' END AS insight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, source) AS r
FROM (SELECT lang, source, round(avg(a), 6) AS score, sum(n_chars) AS k FROM (SELECT r.*, n_chars FROM ({_RESULTS}) r JOIN documents USING (doc_id)) GROUP BY ALL)) WHERE r = 1""")
def best_per_domain_insight(spark, sf_dir):
    rows = _results(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    scores = rows.groupBy("lang", "source").agg(F.round(F.avg("computed_relevance"), 6).alias("score"), F.sum("n_chars").alias("k"))
    best = aggregation.best_by(scores, ["lang"], "score", "source")
    kind = F.element_at(F.array(F.lit("sparse"), F.lit("hybrid"), F.lit("dense")), (F.col("k") % 3 + 1).cast("int"))
    return best.select("lang", "source", "score", compare.insight(kind, F.col("source")).alias("insight"))


_SAID = "CASE WHEN doc_id % 4 = 1 AND doc_id % 3 = 0 THEN 'I cannot answer this.' ELSE " + _ANSWER + " END"
_EXPECTED = "CASE WHEN doc_id % 7 < 4 THEN substring(text, 1, 12) ELSE 'zzqx' END"
_ABILITIES = ("noise_robustness", "negative_rejection", "information_integration", "counterfactual_robustness")
_ABILITY = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ABILITIES)) + " END"
_HAS = f"contains({_sql_normal('{0}')}, {_sql_normal('e')})"
_ABILITY_SQL = f"""j AS (SELECT ability, lang AS model, noise, {_HAS.format('r')} AS c, {_PHRASES['r']} AS j, {_HAS.format('b')} AS b, {_PHRASES['e']} AS d
FROM (SELECT {_ABILITY} AS ability, lang, CASE WHEN doc_id % 4 IN (0, 2) THEN doc_id % 5 * 2 / 10.0 END::DOUBLE AS noise, {_SAID} AS r, reverse(text) AS b, {_EXPECTED} AS e FROM documents WHERE text IS NOT NULL)),
p AS (SELECT ability, model, noise, count(*) AS total, round(100.0 * count(*) FILTER (c) / count(*), 6) AS c, round(100.0 * count(*) FILTER (j) / count(*), 6) AS j, round(100.0 * count(*) FILTER (b) / count(*), 6) AS b,
round(100.0 * count(*) FILTER (d) / count(*), 6) AS d, round(coalesce(100.0 * count(*) FILTER (c AND d) / nullif(count(*) FILTER (d), 0), 0), 6) AS k FROM j GROUP BY ability, model, noise),
results AS (SELECT ability, model, noise AS noise_ratio, total, CASE WHEN ability IN ('noise_robustness', 'information_integration') THEN c END AS accuracy, CASE WHEN ability = 'negative_rejection' THEN j END AS rejection_rate,
CASE WHEN ability = 'counterfactual_robustness' THEN b END AS acc, CASE WHEN ability = 'counterfactual_robustness' THEN c END AS acc_doc, CASE WHEN ability = 'counterfactual_robustness' THEN d END AS error_detection,
CASE WHEN ability = 'counterfactual_robustness' THEN k END AS error_correction FROM p)"""


def _abilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers in place of models': a language answers with its documents."""
    rows = documents(spark, sf_dir).where("text IS NOT NULL").select(
        F.expr(_ABILITY).alias("ability"), F.col("lang").alias("model"), F.expr("CASE WHEN doc_id % 4 IN (0, 2) THEN double(doc_id % 5 * 2 / 10.0) END").alias("noise_ratio"),
        F.expr(_SAID).alias("response"), F.reverse("text").alias("response_no_docs"), F.array(F.expr(_EXPECTED)).alias("expected"),
    )
    return ability.evaluated(ability.judged(rows, ascii_only=True))


@query(f"WITH {_ABILITY_SQL} SELECT * FROM results")
def ability_evaluation(spark, sf_dir):
    return _abilities(spark, sf_dir)


@query(f"""WITH {_ABILITY_SQL}, s AS (SELECT ability, model, round(avg(CASE ability WHEN 'negative_rejection' THEN rejection_rate WHEN 'counterfactual_robustness' THEN error_correction ELSE accuracy END), 6) AS score FROM results GROUP BY ability, model)
SELECT *, CAST(row_number() OVER (PARTITION BY ability ORDER BY score DESC, model) AS INTEGER) AS rank FROM s""")
def ability_rankings(spark, sf_dir):
    return ability.rankings(_abilities(spark, sf_dir))


_HASHED_128 = _HASHED.replace("range(64)", "range(128)").replace("% 64", "% 128").replace("{0}_v AS", "{0}_w AS")
_DENSE_128 = _DENSE.replace(_HASHED.format("docs", "doc_id"), _HASHED_128.format("docs", "doc_id")).replace(_HASHED.format("asks", "query_id"), _HASHED_128.format("asks", "query_id")).replace("dense AS", "dense2 AS").replace("docs_v a, asks_v b", "docs_w a, asks_w b")


@query(f"""WITH {_DOCS_TOKENS}, {_DENSE}, {_DENSE_128}, h AS (SELECT 'hashed-64' AS embedding, * FROM ({_RANKED.format('dense', 5)}) UNION ALL SELECT 'hashed-128', * FROM ({_RANKED.format('dense2', 5)})),
e AS (SELECT embedding, query_id, avg(score) AS s FROM h GROUP BY ALL) SELECT embedding, round(avg(s), 6) AS avg_score, count(*) AS n FROM e GROUP BY embedding""")
def compare_embeddings(spark, sf_dir):
    """Two embedders by the mean score of their five nearest documents of every benchmark item."""
    docs, asks = docs_and_asks(spark, sf_dir)
    hits = [_dense_leg(docs, asks, 5, HashingEmbedder(d)).withColumn("embedding", F.lit(f"hashed-{d}")) for d in (64, 128)]
    return compare.retrieval_scores(hits[0].unionByName(hits[1]), "embedding")


_HASHED_SPARSE = "{0} AS (SELECT {1}, CAST(concat('0x', substr(md5(t), 1, 8)) AS BIGINT) % 64 AS b, sum(CASE WHEN substr(md5(t), 9, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM (SELECT {1}, unnest({2}) AS t FROM {3}) GROUP BY ALL)"


@query(f"""WITH {_WINDOWS.replace('s AS (SELECT doc_id', 's0 AS (SELECT doc_id', 1).replace('FROM s WHERE len(s) > 0)', 'FROM s0 WHERE len(s) > 0)').replace('w AS (SELECT', 'w0 AS (SELECT').replace('FROM w)', 'FROM w0)')}, {_SEMANTIC},
c3 AS (SELECT 'sentence' AS strategy, doc_id, chunk_id::VARCHAR AS c, text FROM chunks UNION ALL SELECT 'none', doc_id, '0', text FROM documents WHERE regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> ''
       UNION ALL SELECT 'semantic', d, row_number() OVER (PARTITION BY d ORDER BY a)::VARCHAR, t FROM g),
{_HASHED_SPARSE.format('hc', 'strategy, doc_id, c', _TOKENS.format('text'), 'c3')}, {_HASHED_SPARSE.format('hq', 'item_id', _TOKENS.format('text'), 'benchmark')},
lc AS (SELECT strategy, doc_id, c, sqrt(sum(v * v)) AS l FROM hc GROUP BY ALL), lq AS (SELECT item_id, sqrt(sum(v * v)) AS m FROM hq GROUP BY ALL),
dt AS (SELECT strategy, doc_id, c, item_id, sum(hc.v * hq.v) AS d FROM hc JOIN hq USING (b) GROUP BY ALL),
sc AS (SELECT c3.strategy, benchmark.item_id, round(coalesce(CASE WHEN l > 0 AND m > 0 THEN d / (l * m) END, 0), 6) AS score FROM c3 CROSS JOIN benchmark LEFT JOIN dt USING (strategy, doc_id, c, item_id) LEFT JOIN lc USING (strategy, doc_id, c) LEFT JOIN lq USING (item_id)),
tp AS (SELECT strategy, item_id, avg(score) AS s FROM (SELECT *, row_number() OVER (PARTITION BY strategy, item_id ORDER BY score DESC) AS rank FROM sc) WHERE rank <= 5 GROUP BY ALL)
SELECT strategy, (SELECT round(avg(n), 6) FROM (SELECT doc_id, count(*) AS n FROM c3 x WHERE x.strategy = tp.strategy GROUP BY doc_id)) AS avg_chunks, round(avg(s), 6) AS avg_score, count(*) AS n FROM tp GROUP BY strategy""")
def compare_chunkings(spark, sf_dir):
    """Whole documents, sentence windows and semantic chunks by the number of chunks of a document and the mean score of the nearest five of every benchmark item."""
    docs, asks = docs_and_asks(spark, sf_dir)
    made = (chunking.no_chunks(docs), chunking.sentence_chunks(docs), chunking.semantic_chunks(docs, threshold=0.2))
    chunks = reduce(DataFrame.unionByName, (c.select("strategy", F.col("doc_id").alias("example_id"), F.concat_ws("_", "doc_id", "chunk_id").alias("doc_id"), "text") for c in made))
    counts = compare.chunk_counts(chunks)
    return compare.chunking_scores(compare.nearest_by_strategy(chunks, counts, asks, HashingEmbedder()), counts)


@query(f"""WITH p AS (SELECT * FROM (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations) WHERE role = 'assistant' AND question IS NOT NULL),
docs AS (SELECT conv_id * 1000 + turn AS doc_id, {_TOKENS.format("coalesce(text, '')")} AS ts FROM p), asks AS (SELECT conv_id * 1000 + turn AS query_id, {_TOKENS.format('question')} AS ts FROM p), {_HASHED.format('docs', 'doc_id')}, {_HASHED.format('asks', 'query_id')}
SELECT a.id AS pair, round({_COSINE}, 6)::DOUBLE AS similarity FROM docs_v a JOIN asks_v b USING (id)""")
def answer_similarity(spark, sf_dir):
    """The cosine of an answer's and a question's vectors, as answers are compared with the truth."""
    pairs = _pairs(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), "text", "question")
    both = embedded(embedded(pairs, "text", HashingEmbedder(), "a"), "question", HashingEmbedder(), "b")
    return both.select("pair", F.round(cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""WITH s AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn) AS ds, any_value(conv_id % 3) AS k FROM conversations GROUP BY conv_id)
SELECT k AS domain, count(*) AS num_samples, round(avg(len(array_to_string(ds, ' '))), 6) AS avg_doc_length, round(avg(len(ds)), 6) AS avg_num_docs, round(avg(CASE WHEN conv_id % 2 = 0 THEN 1.0 ELSE 0.0 END), 6) AS has_relevance_scores FROM s GROUP BY k""")
def sample_statistics(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("documents"))
    samples = said.select((F.col("conv_id") % 3).alias("domain"), "documents", F.when(F.col("conv_id") % 2 == 0, 0.25).otherwise(0.5).alias("context_relevance"))
    return aggregation.sample_statistics(samples, "domain")


@query(f"""WITH d AS (SELECT conv_id AS example_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS doc_idx, text FROM conversations),
s AS (SELECT example_id, doc_idx, {_sentences('text')} AS s FROM d WHERE regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> ''),
w AS (SELECT example_id, doc_idx, s, unnest(range(CASE WHEN len(s) <= 2 THEN 1 ELSE CAST(len(s) - 2 AS BIGINT) + 1 END)) AS k FROM s WHERE len(s) > 0)
SELECT example_id, CAST(doc_idx AS INTEGER) AS doc_idx, CAST(k AS INTEGER) AS chunk_id, CAST(row_number() OVER (PARTITION BY example_id ORDER BY doc_idx, k) - 1 AS INTEGER) AS global_chunk_id,
md5(array_to_string(s[k + 1:least(k + 2, len(s))], ' ')) AS text_md5 FROM w""")
def example_chunks(spark, sf_dir):
    """Conversations as examples whose turns are documents, in windows of two sentences that begin at every sentence."""
    said = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("example_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("documents"))
    chunks = chunking.chunk_examples(said, "sentence", size=2, overlap=1)
    return chunks.select("example_id", "doc_idx", "chunk_id", "global_chunk_id", F.md5("text").alias("text_md5"))


@query(f"SELECT doc_id, source FROM ({_RESULTS}) WHERE toxic <> 0 OR (a + b + a * b + quality) / 4 < 0.3")
def retry_rows(spark, sf_dir):
    """The results that a further pass asks again."""
    rows = _results(spark, sf_dir).withColumn("trace", trace_average(*(F.col(f"computed_{s}") for s in aggregation.SCORES)))
    return sampling.to_retry(rows, least=0.3).select("doc_id", "source")


@query(f"""WITH p AS (SELECT r.*, row_number() OVER (PARTITION BY source ORDER BY {_h('source', 'doc_id')}, doc_id) AS place FROM ({_RESULTS}) r),
v AS (SELECT source, doc_id, place, row_number() OVER (PARTITION BY source ORDER BY place) AS used FROM p WHERE place <= 30 AND toxic = 0 AND a <> 0)
SELECT source, doc_id, CAST(place AS INTEGER) AS place, CAST(used AS INTEGER) AS used FROM v WHERE used <= 10""")
def first_valid(spark, sf_dir):
    """Ten results of each source from its pool, invalid and zero ones replaced by the next backups."""
    pool = sampling.pool(_results(spark, sf_dir), "source", "doc_id", 10)
    return sampling.first_valid(pool, "source", 10, F.col("is_valid"), F.col("computed_relevance")).select("source", "doc_id", "place", "used")


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_h('source', 'doc_id')}, doc_id) AS place FROM documents) WHERE place <= 10")
def demo_samples(spark, sf_dir):
    """Ten documents of each source to show."""
    return sampling.pool(table(spark, sf_dir, "documents"), "source", "doc_id", 10, backups=1).select("source", "doc_id")


@query(f"""SELECT doc_id, md5({_sql_normal("text || ' fi1a2 km'")}) AS normal_md5, contains({_sql_normal("text || ' fi1a2 km'")}, 'fi1a2') AS has_answer FROM documents""")
def compatible_answers(spark, sf_dir):
    """Answers that end in ligatures, circled and wide characters, which normalising takes apart."""
    said = documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit(" \ufb01\u2460\uff21\u00b2 \u339e")).alias("t"))
    return said.select("doc_id", F.md5(text.normalized_answer(F.col("t"))).alias("normal_md5"), text.contains_answer(F.col("t"), F.array(F.lit("\ufb01\u2460\uff21\u00b2"))).alias("has_answer"))


@query(f"""WITH t AS (SELECT {_TOKENS.format("coalesce(text, '')")} AS ts FROM documents) SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_tokens, round(avg(len(ts)), 6) AS mean_tokens,
(SELECT count(DISTINCT term) FROM (SELECT unnest(ts) AS term FROM t)) AS n_terms FROM t""")
def index_statistics(spark, sf_dir):
    return retrieval.corpus_statistics(documents(spark, sf_dir))


@query(f"WITH {_DOCS_TOKENS}, {_DENSE} SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM ({_RANKED.format("dense JOIN docs USING (doc_id) WHERE lang = 'en'", 5)})")
def dense_text_filtered(spark, sf_dir):
    """The nearest documents of a language by vectors of their texts."""
    docs, asks = docs_and_asks(spark, sf_dir)
    return retrieval.retrieve(docs, asks, RetrievalSpec(method="dense"), keep=F.col("lang") == "en").select("query_id", "doc_id", "score", "rank")
