"""A stored inverted index: postings by term in blocks, statistics as sums of what each append adds, searches that leave blocks out.

A block holds about BLOCK postings of one term that count about the same, and the largest and smallest of what its postings' scores depend
on. A search reads these bounds first, without any posting: for each query they give a score that at least k documents reach. A block whose best
posting, together with the best of all the query's other terms, stays below it has no document of the result and is not read.

Tables at the path: `blocks` by bucket of terms, `terms` (df), `documents` (length), `segments` (documents and tokens). All rows carry the
segment of their append; its row in `segments` is written last, and what has none (an append that failed) is never read.
"""

import uuid
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.functions.text import content_tokens
from ragloom.operators.retrieval import MOST_SENT, RetrievalSpec, Tokens, query_terms, top_k
from ragloom.sources.shared import cleaned, scratch, written

BLOCK, BUCKETS = 128, 64
#: Steps by which reached scores are counted.
STEPS = 64
#: Postings that one task makes into blocks, more or less, and parts of an append that are shuffled one after the other, so that the disk holds one at a time.
POSTINGS_A_TASK, WAVES = 1_000_000, 4
#: Terms with more than this share of an append's postings are dealt to several tasks; they are no more than so many.
SHARES = 1_024
#: Values of tf that a frequent term's blocks keep apart; higher ones count as one.
MOST_TF = 8
#: Scores have six digits: a block is left out only if it stays below the result by more than they show.
SLACK = 2e-6
_KINDS = {
    "blocks": "term string, segment string, level int, part int, n int, max_tf long, min_tf long, max_length long, min_length long, postings array<struct<doc_id:bigint,tf:bigint,length:bigint>>, bucket int",
    "terms": "term string, df long, segment string, bucket int", "documents": "doc_id long, length long, segment string", "segments": "segment string, docs long, tokens long",
}
_BOUNDS = ["max_tf", "min_tf", "max_length", "min_length"]


def _sent(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= MOST_SENT else rows


def _weight(tf: Column, length: Column, mean: Column, spec: RetrievalSpec) -> Column:
    return tf * (spec.k1 + 1) / (tf + spec.k1 * (1 - spec.b + spec.b * length / mean))


def _bounds(mean: Column, spec: RetrievalSpec) -> tuple[Column, Column]:
    """The most and the least that a posting of a block can add to a score."""
    return F.col("weight") * _weight(F.col("max_tf"), F.col("min_length"), mean, spec), F.col("weight") * _weight(F.col("min_tf"), F.col("max_length"), mean, spec)


class PostingsIndex:
    def __init__(self, spark: SparkSession, path: str, tokens: Tokens = content_tokens):
        self.spark, self.path, self.tokens = spark, path.rstrip("/"), tokens

    @classmethod
    def build(cls, documents: DataFrame, path: str, tokens: Tokens = content_tokens) -> "PostingsIndex":
        """An index of documents (doc_id, text) at a path that holds none."""
        index = cls(documents.sparkSession, path, tokens)
        for name in ("documents", "segments"):
            index.spark.createDataFrame([], _KINDS[name]).write.mode("errorifexists").parquet(f"{index.path}/{name}")
        index.append(documents)
        return index

    def table(self, name: str) -> DataFrame:
        """A table's rows of the appends that ended."""
        rows = self.spark.read.schema(_KINDS[name]).parquet(f"{self.path}/{name}")
        if name == "segments":
            return rows
        return rows.join(F.broadcast(self.table("segments").select("segment")), "segment", "left_semi")  # a row for each append

    def append(self, documents: DataFrame) -> dict[str, int]:
        """Add the documents whose doc_id the index lacks; rows with one doc_id count once, null texts are empty. Returns how many came and how many it holds."""
        segment = uuid.uuid4().hex
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        rows = rows.join(self.table("documents").select("doc_id"), "doc_id", "left_anti").select("doc_id", self.tokens(F.col("text")).alias("tokens"))
        rows = rows.select("doc_id", F.size("tokens").cast("long").alias("length"), "tokens")
        # tokenised once: a document's row for no term tells its length
        every = rows.select("doc_id", "length", F.explode_outer("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
        with scratch(self.spark, "append") as place, cleaned(self.spark):
            counts = written(every, "postings", place)
            held = counts.groupBy("doc_id").agg(F.max("length").alias("length"))
            totals = held.agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
            counts = counts.where("term IS NOT NULL")
            terms = written(counts.groupBy("term").agg(F.count("*").alias("df")), "terms", place)
            named = lambda df: df.withColumn("segment", F.lit(segment))
            n = terms.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
            for made in self._blocks(counts, terms, n):
                named(made).sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/blocks")
            kept = named(terms).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
            kept.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/terms")
            named(held).write.mode("append").parquet(f"{self.path}/documents")
            self.spark.createDataFrame([(segment, totals["docs"], totals["tokens"])], _KINDS["segments"]).write.mode("append").parquet(f"{self.path}/segments")
        return {"added": totals["docs"], "total": self.table("segments").agg(F.sum("docs")).first()[0]}

    def _blocks(self, counts: DataFrame, terms: DataFrame, n: int) -> list[DataFrame]:
        """The blocks of n postings (term, doc_id, tf, length) in waves, each with one shuffle: a task has whole terms (and a very frequent term's share,
        its level), which it sorts by tf and length and cuts into blocks. Nothing that grows with the documents goes to the driver."""
        homes = BUCKETS * max(1, ceil(n / (BUCKETS * POSTINGS_A_TASK)))
        # n postings have no more than SHARES such terms, whatever the documents
        share = max(64 * BLOCK, n // SHARES + 1)
        hot = F.broadcast(terms.where(F.col("df") > share).select(F.col("term").alias("of"), F.ceil(F.col("df") / share).cast("int").alias("shares")))
        level = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("shares")), F.lit(0)).cast("int")
        dealt = counts.select(F.pmod(F.xxhash64("term"), F.lit(homes)).cast("int").alias("home"), "term", "doc_id", "tf", "length")
        own = Window.partitionBy("home", "level", "term")
        at = F.row_number().over(own.orderBy(F.desc("tf"), "length", "doc_id"))
        # a block of a frequent term has one tf, so that its bounds are close
        alike = F.when(F.count("*").over(own) > BLOCK, F.least("tf", F.lit(MOST_TF))).otherwise(0)
        waves = min(WAVES, max(1, ceil(n / POSTINGS_A_TASK)))
        out = []
        for wave in range(waves):
            here = dealt.where(F.col("home") % waves == wave).join(hot, F.col("term") == F.col("of"), "left").select("home", level.alias("level"), "term", "doc_id", "tf", "length")
            cut = here.repartition("home", "level").select("*", F.floor((at - 1) / BLOCK).cast("int").alias("part"), alike.alias("alike"))
            made = cut.groupBy("home", "level", "term", "part", "alike").agg(
                F.count("*").cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("tf").alias("min_tf"), F.max("length").alias("max_length"), F.min("length").alias("min_length"), F.array_sort(F.collect_list(F.struct("doc_id", "tf", "length"))).alias("postings"),
            )
            out.append(made.withColumn("bucket", F.col("home") % BUCKETS).drop("home", "alike"))
        return out

    def _weights(self, queries: DataFrame, k: int, spec: RetrievalSpec) -> tuple[DataFrame, Column, list[int]]:
        """A row for each query and term, and so no more than the queries have terms (query_id, term, weight: what a posting's part is multiplied with, floor: a score that k
        documents reach, others: what the query's other terms can add; sent to all tasks if they are few), the mean length, and the buckets to read."""
        docs, length = self.table("segments").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        mean = F.lit(length / docs if docs else 1.0)
        asked = query_terms(queries, self.tokens)
        few = asked.limit(MOST_SENT + 1).count()
        asked = asked.withColumn("in", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        buckets = [r[0] for r in asked.select("in").distinct().collect()]
        held = lambda name: self.table(name).where(F.col("bucket").isin(buckets))
        # df of the queries' terms alone is shuffled
        df = held("terms").join(_sent(asked.select("term").distinct(), few), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        weights = df.join(_sent(asked, few), "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"))
        # bounds alone are read here
        bounds = held("blocks").select("term", "n", *_BOUNDS)
        most, least = _bounds(mean, spec)
        found = bounds.join(_sent(weights, few), "term").select("query_id", "term", "n", "weight", most.alias("most"), least.alias("least"))
        # a term alone gives so many documents at least so much
        steps = found.groupBy("query_id", "term", F.floor(F.col("least") * STEPS).alias("step")).agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.max("weight").alias("weight"))
        from_top = Window.partitionBy("query_id", "term").orderBy(F.desc("step"))
        steps = steps.withColumn("reached", F.when(F.sum("n").over(from_top) >= k, F.col("step") / STEPS))
        by_term = steps.groupBy("query_id", "term").agg(F.max("reached").alias("reached"), F.max("most").alias("top"), F.max("weight").alias("weight"))
        whole = Window.partitionBy("query_id")
        by_term = by_term.select("query_id", "term", "weight", F.max("reached").over(whole).alias("floor"), (F.sum("top").over(whole) - F.col("top")).alias("others"))
        return _sent(by_term, few), mean, buckets

    def _chosen(self, queries: DataFrame, spec: RetrievalSpec, columns: list[str]) -> tuple[DataFrame, Column]:
        """Each query's blocks (query_id, weight, columns, kept: whether one can have a document of the result) and the mean length. A block's own bounds decide, so no list of blocks is made."""
        by_term, mean, buckets = self._weights(queries, spec.top_k, spec)
        blocks = self.table("blocks").where(F.col("bucket").isin(buckets)).select("term", *_BOUNDS, *columns)
        kept = F.coalesce(_bounds(mean, spec)[0] + F.col("others") >= F.col("floor") - SLACK, F.lit(True))
        return blocks.join(by_term, "term").select("query_id", "weight", *columns, kept.alias("kept")), mean

    def search(self, queries: DataFrame, spec: RetrievalSpec = RetrievalSpec()) -> DataFrame:
        """query_id, doc_id, score, rank: the BM25 top-k of queries (query_id, text), the same as of the documents themselves."""
        chosen, mean = self._chosen(queries, spec, ["postings"])
        read = chosen.where("kept").select("query_id", "weight", F.explode("postings").alias("p"))
        part = F.col("weight") * _weight(F.col("p.tf"), F.col("p.length"), mean, spec)
        scores = read.select("query_id", "p.doc_id", part.alias("part")).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
        return top_k(scores.where(F.round("score", 6) > 0), spec.top_k)

    def skipped(self, queries: DataFrame, spec: RetrievalSpec = RetrievalSpec()) -> DataFrame:
        """query_id, blocks and left_out: how many blocks of its terms a query's search doesn't read."""
        return self._chosen(queries, spec, [])[0].groupBy("query_id").agg(F.count("*").alias("blocks"), F.count_if(~F.col("kept")).alias("left_out"))

    def statistics(self) -> DataFrame:
        """Documents, tokens, terms and the mean number of tokens, from the sums that appends left."""
        terms = self.table("terms").agg(F.countDistinct("term").alias("n_terms"))
        sums = self.table("segments").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"))
        return sums.withColumn("mean_tokens", F.round(F.col("n_tokens") / F.nullif("n_docs", F.lit(0)), 6)).join(F.broadcast(terms))
