"""Substring deduplication: units of text are hashed, digests grouped over all documents, the earliest occurrence stays.

Units are lines, and where a line is long, pieces of it: it is cut where a pair of words has the smallest hash among its
neighbours in the line. A cut depends on the few words around it only, so a passage that repeats in the middle of other text
falls into the same pieces in every document; and a line falls into the same pieces whatever lines stand beside it, so that a line
repeats if all its pieces do.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.store import materialise
from ragloom.llm.wordhash import chunks, encode, mix, ngram_hashes, word_hashes

_U = np.uint64
#: A pair of words cuts if its hash is smaller than those of so many pairs on either side: a piece has 7 words on average.
RADIUS = 3
#: Neighbouring repeated units are removed if they have so many words together.
LEAST_WORDS = 15
#: A unit that more than one in so many repeated units is counts as frequent: there are no more of these.
FREQUENT = 1000
UNIT = "doc_id long, body long, unit int, first_word int, last_word int, start int, end int, line int, line_words int, digest long, again boolean"


def cuts(words: np.ndarray, line: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each word (line: the number of its line, ascending) whether a piece ends after it. Each line is cut by its own words alone."""
    if len(words) < 2:
        return np.ones(len(words), dtype=bool)
    out = np.zeros(len(words), dtype=bool)
    # each pair of words has a place; between lines are places of 0, which nothing is smaller than
    inner = line[1:] == line[:-1]
    place = np.arange(len(words) - 1) + radius * (1 + np.cumsum(~inner))
    hashes = np.zeros(int(place[-1]) + radius + 1, dtype=_U)
    at = place[inner]
    hashes[at] = ngram_hashes(words, 2)[inner]
    least = np.ones(len(at), dtype=bool)
    for i in range(1, radius + 1):
        least &= (hashes[at] < hashes[at - i]) & (hashes[at] < hashes[at + i])
    out[1:][inner] = least
    out[:-1] |= ~inner
    out[-1] = True
    return out


def units(docs: DataFrame) -> DataFrame:
    """A row for each unit: body (a hash of the text), unit (number from 0), first_word and last_word (numbers, the last
    exclusive), start and end (code points), line (number from 0) and line_words (its words in all), digest of its lower-case
    words, again: this document has it earlier."""

    def of_words(raw: bytes, words: np.ndarray) -> tuple:
        buf = np.frombuffer(raw, dtype=np.uint8)
        white = (buf == 32) | ((buf >= 9) & (buf <= 13))
        edge = np.flatnonzero(np.diff(np.r_[True, white, True].view(np.int8)))
        begins, stops = edge[0::2], edge[1::2]
        line = np.searchsorted(np.flatnonzero(buf == 10), begins)
        ends = cuts(words, line)
        in_line = np.bincount(line)
        last = np.flatnonzero(ends) + 1
        first = np.r_[0, last[:-1]]
        inside = np.arange(len(words)) - np.repeat(first, last - first)
        digest = mix(np.add.reduceat(mix(words + inside.astype(_U) * _U(0x9E3779B97F4A7C15)), first) + (last - first).astype(_U)).view(np.int64)
        starts, ends_at = begins[first], stops[last - 1]
        if not raw.isascii():
            points = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
            starts, ends_at = points[starts], points[ends_at]
        again = np.ones(len(digest), dtype=bool)
        again[np.unique(digest, return_index=True)[1]] = False
        return np.arange(len(first)), first, last, starts, ends_at, line[first], in_line[line[first]], digest, again

    def table(ids: list, bodies: list, found: list[tuple]) -> pd.DataFrame:
        many = [len(f[0]) for f in found]
        out = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64").repeat(many), "body": np.repeat(np.array(bodies, dtype=np.int64), many)})
        for i, name in enumerate(("unit", "first_word", "last_word", "start", "end", "line", "line_words", "digest", "again")):
            out[name] = np.concatenate([f[i] for f in found])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [encode(t) for t in batch["text"]]
            own_ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            own_bodies = batch["body"].tolist()
            for a, b in chunks(parts, 1 << 20):
                words, at = word_hashes([p.lower() for p in parts[a:b]])
                rows = [i for i in range(a, b) if at[i - a + 1] > at[i - a]]
                if rows:
                    yield table([own_ids[i] for i in rows], [own_bodies[i] for i in rows], [of_words(parts[i], words[at[i - a] : at[i - a + 1]]) for i in rows])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), F.col("text").cast("string").alias("text")).mapInPandas(run, UNIT)


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS, least_line_words: int | None = None) -> DataFrame:
    """The spans to remove: doc_id, body (hash of the text), start, end (code points, end exclusive), n_words, first_id.

    A unit repeats if a document with a smaller doc_id, or its own document earlier, has the same lower-case words; runs
    of neighbouring repeats with least_words words or more become one span, and, with least_line_words, runs that hold all units of a
    line of so many words. first_id is the smallest doc_id that has one of its units. Rows with equal doc_id rank alike and
    don't repeat each other; null doc_ids rank last. Null, empty and blank texts have no units; an empty table gives an empty
    result; other columns are ignored.
    """
    found = units(docs)
    rank = F.coalesce("doc_id", F.lit(2**63 - 1))
    firsts = materialise(found.groupBy(F.col("digest").alias("of")).agg(F.min(rank).alias("first_id"), F.count("*").alias("n")).where("n > 1"), "firsts")
    # of all repeated units at most FREQUENT are frequent: these meet theirs where they are, the others in a shuffle
    least = F.lit((firsts.agg(F.sum("n")).first()[0] or 0) // FREQUENT)
    frequent, rest = (firsts.where(F.coalesce(F.col("n") > least, F.lit(False)) == F.lit(x)).drop("n") for x in (True, False))
    met = found.join(F.broadcast(frequent.toDF("of_frequent", "frequent_first")), F.col("digest") == F.col("of_frequent"), "left")
    common = met.where("of_frequent is not null").withColumnRenamed("frequent_first", "first_id").drop("of_frequent")
    others = met.where("of_frequent is null").drop("of_frequent", "frequent_first").join(rest, F.col("digest") == F.col("of")).drop("of")
    repeats = common.unionByName(others).where((rank > F.col("first_id")) | F.col("again"))
    run = F.col("unit") - F.dense_rank().over(Window.partitionBy("doc_id", "body").orderBy("unit"))
    # rows that are alike have every unit as often as there are rows
    words, line = F.col("last_word") - F.col("first_word"), Window.partitionBy("doc_id", "body", "line")
    whole = F.sum(words).over(line) >= F.col("line_words") * F.count("*").over(Window.partitionBy("doc_id", "body", "unit")) if least_line_words else F.lit(False)
    runs = repeats.withColumn("run", run).withColumn("whole", F.when(whole, F.col("line_words")).otherwise(0)).groupBy("doc_id", "body", "run")
    spans = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last_word") - F.min("first_word")).alias("n_words"), F.min("first_id").alias("first_id"), F.max("whole").alias("whole"))
    return spans.where((F.col("n_words") >= least_words) | (F.col("whole") >= (least_line_words or 2**31 - 1))).drop("run", "whole")


def remove_spans(docs: DataFrame, spans: DataFrame, name: str = "removed") -> DataFrame:
    """docs without the spans, and `name`: array of their (start, end) in the original text, in order; empty where there are none.

    A null text stays null, an empty one empty, repeated rows lose the same spans. A column of docs of that name is replaced;
    the other columns stay as they are, n_chars too.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))  # docs may have columns of any name
    kept = spans.groupBy(F.col("doc_id").alias("of_id"), F.col("body").alias("of_body")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("gone"))
    rows = docs.toDF(*names).join(kept, F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("of_id")) & (F.xxhash64(at["text"]) == F.col("of_body")), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        def one(text: str | None, spans: list | None) -> str | None:
            if text is None or spans is None:
                return text
            out, at = [], 0
            for s in spans:
                out.append(text[at : s["start"]])
                at = s["end"]
            return "".join([*out, text[at:]])

        return pd.Series([one(t, r) for t, r in zip(texts, removed, strict=True)], dtype=object)

    whole: Column = F.when(F.col("gone").isNull(), F.col(at["text"])).otherwise(cut(at["text"], "gone"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    own = [(whole if c == "text" else F.col(at[c])).alias(c) for c in docs.columns if c != name]
    return rows.select(*own, F.coalesce("gone", none).alias(name))
