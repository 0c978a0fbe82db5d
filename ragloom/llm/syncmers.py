"""Document fingerprints from closed syncmers, with SQL functions only.

A text's words are hashed; of every K neighbouring words the hashes of the S-word pieces inside are compared, and the K
words are chosen if the smallest lies at either edge. Whether they are chosen depends on them alone, so a passage keeps
its anchors whatever surrounds it. A fingerprint is the KEPT smallest hashes of a text's anchors.
"""

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of an anchor, words of the pieces compared inside it, hashes that a fingerprint keeps.
K, S, KEPT = 5, 2, 64
#: Rows between two bounds of the split by doc_id, and the most bounds.
ROWS_A_PART, MOST_PARTS = 500, 10_000
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def _once(value: Column, body) -> Column:
    """body(value) with value computed once, not again for every use inside."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Struct (at: index of the first word, hash: int) of the closed syncmers of a text's lower-case words, in order.

    A text of fewer than k words, or one of whose words no k are chosen, has one anchor, its words in all; a null or blank text has none.
    """
    none = F.array().cast("array<struct<at:int,hash:int>>")
    plain = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WHITE))

    def of_words(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        whole = F.array(F.struct(F.lit(0).alias("at"), F.hash(F.array_join(words, " ")).alias("hash")))
        chosen = F.when(F.size(words) < k, none).otherwise(_once(hashes, of_hashes))
        return _once(chosen, lambda found: F.when(F.size(found) == 0, whole).otherwise(found))

    def of_hashes(h: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*(h[i + j] for j in range(s))))
        return _once(pieces, of_pieces)

    def of_pieces(p: Column) -> Column:
        last = k - s

        def chosen(i: Column) -> Column:
            inner = [p[i + j] for j in range(1, last)]
            return F.least(p[i], p[i + last]) <= F.least(*inner) if len(inner) > 1 else F.least(p[i], p[i + last]) <= inner[0]

        starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1 - last), chosen)
        # pieces that cover all k words
        cover = sorted({*range(0, last, s), last})
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.hash(*(p[i + j] for j in cover)).alias("hash")))

    return F.when(plain == "", none).otherwise(_once(F.split(plain, r"[\x20\x09-\x0D]+"), of_words))


def kept(text: Column, most: int = KEPT) -> Column:
    """The smallest distinct anchor hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(F.transform(anchors(text), lambda a: a["hash"]))), 1, most)


def as_text(hashes: Column) -> Column:
    """A fingerprint as text: eight hex digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column, most: int = KEPT) -> Column:
    """Estimated share of the anchors of either text that both have, from their kept hashes; 1 if neither has any."""
    joint = F.slice(F.sort_array(F.array_union(a, b)), 1, most)
    both = F.size(F.array_intersect(F.array_intersect(joint, a), b)).cast("double")
    return F.when(F.size(joint) == 0, F.lit(1.0)).otherwise(both / F.greatest(F.size(joint), F.lit(1)))


def matches(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Where the pairs (a, b: doc_id) of docs share passages, from all anchors and their places: a, b, shift, n_anchors, first_at, last_at.

    A row stands for the shared anchors whose place in b is `shift` words after their place in a; first_at and last_at are
    places in a. Pairs that share no anchor have no row. Each pair's anchors meet by hash, so a hash that a text has
    many times meets all its places in the other. Rows with equal doc_id count as one document; null ids are in no pair.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(anchors(F.col("text").cast("string"))).alias("anchor")).select("doc_id", "anchor.*").distinct()
    side = lambda x: found.select(F.col("doc_id").alias(x), F.col("at").alias(f"at_{x}"), "hash")
    both = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct().join(side("a"), "a").join(side("b"), ["b", "hash"])
    return both.groupBy("a", "b", (F.col("at_b") - F.col("at_a")).alias("shift")).agg(F.count("*").alias("n_anchors"), F.min("at_a").alias("first_at"), F.max("at_a").alias("last_at"))


def with_next(docs: DataFrame, order: str, carried: list[str], tie: str) -> DataFrame:
    """docs with next_<c> for each carried column: its value in the row next in order; after the last comes the first.

    Rows with equal order are taken by a hash of the column tie, null order is last. The rows are dealt by ranges
    of `order` (at most MOST_PARTS bounds reach the driver); the first row of each range is copied to the range before.
    """
    rows = docs.withColumn("_tie", F.xxhash64(tie))
    # rows without order follow beyond every long, spread by their hash
    rows = rows.withColumn("_key", F.coalesce(F.col(order).cast("double"), F.lit(1e19) + F.pmod(F.col("_tie"), F.lit(1 << 40)) * 1e7))
    parts = min(MOST_PARTS, rows.count() // ROWS_A_PART)
    bounds = sorted({b for b in rows.approxQuantile("_key", [i / parts for i in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    if bounds:
        rows = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_key", outputCol="_part").transform(rows)
    else:
        rows = rows.withColumn("_part", F.lit(0.0))
    # the double deals rows only; within a range order is that of the column itself
    place = [F.col(order).isNull().alias("_none"), F.col(order).alias("_order"), "_key", "_tie"]
    first = rows.groupBy("_part").agg(F.min(F.struct(*place)).alias("f"))
    line = Window.orderBy("_part")
    first = first.withColumn("to", F.coalesce(F.lag("_part").over(line), F.max("_part").over(Window.partitionBy())))
    # a row for each range, at most MOST_PARTS
    first = F.broadcast(first.select(F.col("_part").alias("p"), F.col("f._order").alias("o"), F.col("f._key").alias("k"), F.col("f._tie").alias("t"), "to"))
    guests = rows.join(first, (F.col("_part") == F.col("p")) & F.col(order).eqNullSafe(F.col("o")) & (F.col("_key") == F.col("k")) & (F.col("_tie") == F.col("t"))).withColumn("_part", F.col("to")).select(*rows.columns, F.lit(True).alias("_guest"))
    all_rows = rows.withColumn("_guest", F.lit(False)).unionByName(guests)
    by = Window.partitionBy("_part").orderBy("_guest", F.asc_nulls_last(order), "_key", "_tie")
    return reduce(lambda d, c: d.withColumn(f"next_{c}", F.lead(c).over(by)), carried, all_rows).where(~F.col("_guest")).drop("_key", "_tie", "_part", "_guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last floor(n_chars / 2) characters are replaced by the first as many of the next
    document by doc_id. Null texts count as empty; an empty fingerprint is like another empty one only. Rows with equal
    doc_id follow each other by a hash of text; other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = with_next(own.withColumn("own", kept(F.col("text"))), "doc_id", ["text", "own"], "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = both.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    both = both.select("doc_id", "n_chars", "own", "next_own", F.sha2("edited", 256).alias("edited_sha256"), kept(F.col("edited")).alias("other"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
