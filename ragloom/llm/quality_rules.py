"""Quality rules on lines that many documents of a host share.

Lines are normalised and hashed; for each host and line the distinct documents that have it are counted; lines
above the limit are boilerplate and go; a document that little is left of is depleted and rejected. A few rules on the
document alone come first.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.wordhash import chunks, encode, ngram_hashes, word_hashes

#: A line is boilerplate of its host if more than LINE_DOCS distinct documents and more than LINE_SHARE of the host's documents have it.
LINE_DOCS, LINE_SHARE = 20, 0.005
#: A document is depleted if less than this share of its words is left.
LEFT_SHARE = 0.3
#: Base rules: at least so many words, and at most this share of them in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
SYMBOLS = "#*$%&|<>"


def _repeated(words: np.ndarray, n: int = 3) -> int:
    """Words that lie in an n-word window which occurs twice or more."""
    grams = ngram_hashes(words, n)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for i in range(n):
        covered[i : len(grams) + i] |= twice
    return int(covered.sum())


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text; zeros for null."""
    white = b" \t\n\r\x0b\x0c"

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            parts = [encode(t) for t in texts]
            for a, b in chunks(parts):
                words, at = word_hashes(parts[a:b])
                for i in range(a, b):
                    raw = parts[i]
                    own = words[at[i - a] : at[i - a + 1]]
                    letters = raw.translate(None, white)
                    code_points = len(letters) if letters.isascii() else len(letters.decode("utf-8", "surrogatepass"))
                    symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
                    lines = [x for x in raw.split(b"\n") if x.translate(None, white)]
                    rows.append((len(own), code_points, symbols, len(lines) - len(set(lines)), _repeated(own)))
            yield pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return run(text)


def line_key(line: Column) -> Column:
    """Hash of a line in lower case with runs of white space as one blank, ends trimmed, digits as 0; null for a blank line."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "), r"[0-9]+", "0"))
    return F.when(plain != "", F.xxhash64(plain))


def line_rows(docs: DataFrame) -> DataFrame:
    """_host, _body, at (line number from 0), key and words of every line that has a word."""
    lines = docs.select("_host", "_body", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.select("_host", "_body", "at", line_key(F.col("line")).alias("key"), F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).where("key is not null")


def common_lines(lines: DataFrame, bodies: DataFrame, most_docs: int = LINE_DOCS, most_share: float = LINE_SHARE) -> DataFrame:
    """_host and key of the lines above the limits. Every step sums before rows move, so a line that all documents have is no load."""
    counts = lines.groupBy("_host", "key", "_body").agg(F.lit(1).alias("one")).groupBy("_host", "key").agg(F.count("*").alias("n"))
    sizes = bodies.groupBy("_host", "_body").agg(F.lit(1).alias("one")).groupBy(F.col("_host").alias("of")).agg(F.count("*").alias("all"))
    found = counts.where(F.col("n") > most_docs).join(sizes, F.col("_host").eqNullSafe(F.col("of")))
    return found.where(F.col("n") > most_share * F.col("all")).select(F.col("_host").alias("host"), F.col("key").alias("common"))


def assess(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """Every row of docs with _counts (see base_counts), base_failed, _gone (struct at, words of each common line) and kept.

    Documents of a host are distinct if their texts are: copies count a line once. A null host is a host of its own, a
    null or empty text has no lines and fails the base rules; rows that are alike are judged alike; an empty table
    gives an empty result. Columns of docs named base_failed or kept are replaced, the others stay; names that begin with
    an underscore are this function's.
    """
    docs = docs.withColumn("_host", F.col(host).cast("string")).withColumn("_body", F.xxhash64("text"))
    lines = line_rows(docs)
    common = common_lines(lines, docs.select("_host", "_body"), **limits)
    hit = lines.join(common, (F.col("key") == F.col("common")) & F.col("_host").eqNullSafe(F.col("host")))
    gone = hit.groupBy(F.col("_host").alias("_of"), F.col("_body").alias("_in")).agg(F.collect_set(F.struct("at", "words")).alias("_gone"))
    judged = docs.withColumn("_counts", base_counts(F.col("text")))
    judged = judged.join(gone, F.col("_host").eqNullSafe(F.col("_of")) & (F.col("_body") == F.col("_in")), "left").drop("_of", "_in", "_host", "_body")
    c = F.col("_counts")
    failed = (c["n_words"] < LEAST_WORDS) | (c["n_repeat_words"] > MOST_REPEATED * c["n_words"])
    lost = F.aggregate(F.coalesce("_gone", F.array().cast("array<struct<at:int,words:int>>")), F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (c["n_words"] - lost >= LEFT_SHARE * c["n_words"]))


def clean(docs: DataFrame, host: str = "source", **limits) -> DataFrame:
    """The kept documents without their common lines; columns and their values as in docs, but for text.

    Null, empty and short texts fail the base rules and go; repeated rows stay or go alike; an empty table gives an empty result.
    """
    own = {c: f"_own_{c}" for c in ("base_failed", "kept") if c in docs.columns}
    judged = assess(docs.withColumnsRenamed(own), host, **limits).where("kept").drop("base_failed", "kept").withColumnsRenamed({v: k for k, v in own.items()})
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.transform("_gone", lambda g: g["at"]), i)), "\n")
    return judged.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left)).select(*docs.columns)
