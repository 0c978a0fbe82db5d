"""Mixing sources to target weights along a curriculum that changes over time.

Each source has a weight schedule over training progress 0..1. Its integral is the source's share of the
words; what would repeat a source more than `most_repeats` times is shared anew among the others. The integral
up to a time is the source's cumulative demand; inverting it at the middle of a document's place in the source's
stream gives the document's training position. All documents are then sorted by range of position.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, null last, repeating; and how the weight of each runs over training:
#: (progress, factor) knots, linear between them, whose integral is 1, so that totals follow the weights alone.
WEIGHTS = (5.0, 2.0, 1.0)
RAMPS = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)), ((0.0, 0.5), (1.0, 1.5)))
#: A source's documents are dealt by hash into so many groups, whose sizes are summed first: a source of any size is never in one task.
GROUPS = 4096


def n_words(text: Column) -> Column:
    """Number of words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _segments(knots: tuple, weight: float) -> list[tuple]:
    """(begin, end, weight at begin, at end, integral at begin, at end) of each linear piece."""
    out, total = [], 0.0
    for (t0, f0), (t1, f1) in zip(knots, knots[1:], strict=False):
        more = (t1 - t0) * (f0 + f1) / 2 * weight
        out.append((t0, t1, f0 * weight, f1 * weight, total, total + more))
        total += more
    return out


def schedules(weights=WEIGHTS, ramps=RAMPS) -> Column:
    """The schedule of the source with 0-based rank `at`: array of linear pieces."""
    fields = "array<struct<t0:double,t1:double,w0:double,w1:double,i0:double,i1:double>>"
    parts = [F.array(*(F.struct(*map(F.lit, seg)) for seg in _segments(r, w))).cast(fields) for w, r in zip(weights, ramps, strict=True)]
    return F.element_at(F.array(*parts), (F.col("at") % len(parts) + 1).cast("int"))


def targets(totals: DataFrame, weights=WEIGHTS, ramps=RAMPS, most_repeats: int = 3) -> DataFrame:
    """source, source_size, target (words of the mix, double) and schedule from one row (source, source_size) for each source.

    The shares add up to all words. A source whose share is above most_repeats times its size gets that, and the rest
    is shared by weight again until none is above: sources in the order of limit / weight fill up first.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    ranked = totals.withColumn("at", F.row_number().over(order) - 1).withColumn("schedule", schedules(weights, ramps))
    ranked = ranked.withColumn("weight", F.element_at("schedule", -1)["i1"]).withColumn("limit", F.lit(most_repeats) * F.col("source_size").cast("double"))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), "at").rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumn("words", F.sum("source_size").over(every).cast("double")).withColumn("weights", F.sum("weight").over(every))
    filled = filled.withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level, words per weight, if this source is the first that doesn't fill up
    filled = filled.withColumn("level", F.when(F.col("weights") > F.col("gone"), (F.col("words") - F.col("full")) / (F.col("weights") - F.col("gone"))))
    level = F.min(F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), "at", "level"))).over(every)["level"]
    return filled.select("source", "source_size", F.least("limit", F.coalesce(level * F.col("weight"), "limit")).alias("target"), "schedule")


def position(schedule: Column, share: Column) -> Column:
    """The progress at which the share (0..1) of a source's demand is reached: the inverse of the schedule's integral."""
    wanted = share * F.element_at(schedule, -1)["i1"]
    piece = F.coalesce(F.get(F.filter(schedule, lambda s: s["i1"] > wanted), F.lit(0)), F.element_at(schedule, -1))
    rest = wanted - piece["i0"]
    slope = (piece["w1"] - piece["w0"]) / (piece["t1"] - piece["t0"])
    root = F.sqrt(F.greatest(F.lit(0.0), piece["w0"] * piece["w0"] + 2 * slope * rest))
    return F.least(piece["t1"], piece["t0"] + F.when(piece["w0"] + root > 0, 2 * rest / (piece["w0"] + root)).otherwise(0.0))


def plan(docs: DataFrame, seed: int = 7, weights=WEIGHTS, ramps=RAMPS, most_repeats: int = 3) -> DataFrame:
    """Every row of docs with _size, _source_size, _target, _taken and _places, whatever its other columns are.

    _places holds one struct (copy, words, position) for each time the document is taken: words is its size, but for
    the last document of a source's stream, which is cut after the word where the source's demand ends. _taken is
    the sum of words. Order within a source is by a hash of doc_id and seed, then doc_id and text, so reruns agree;
    rows that are alike in all of these are interchangeable. Null texts have size 0 and are not taken; a null source
    is a source of its own; an empty table gives an empty result.
    """
    # 60 bits of an md5, which SQL engines agree on
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}"))), 1, 15), 16, 10).cast("long")
    key = F.struct(draw.alias("h"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"))
    sized = docs.withColumn("_size", n_words(F.col("text"))).withColumn("_order", key).withColumn("_group", (F.shiftright("_order.h", 30) * GROUPS / (1 << 30)).cast("int"))
    sums = sized.groupBy(F.col("source").alias("_source"), "_group").agg(F.sum("_size").alias("_sum"))
    ahead = Window.partitionBy("_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    totals = sums.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size"))
    aims = targets(totals, weights, ramps, most_repeats)
    aims = sums.join(aims, F.col("_source").eqNullSafe(F.col("source"))).select("_source", F.col("_group").alias("_in"), "_ahead", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("schedule").alias("_schedule"))
    inner = Window.partitionBy("source", "_group").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("_before", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    placed = placed.join(aims, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_group") == F.col("_in")))
    start = F.col("_ahead") + F.col("_before")
    whole = F.floor(F.col("_target") + 1e-6)

    def taken(copy: Column) -> Column:
        begin = start + copy * F.col("_source_size")
        words = F.greatest(F.lit(0), F.least(F.col("_size"), whole - begin)).cast("long")
        return F.struct(copy.cast("int").alias("copy"), words.alias("words"), position(F.col("_schedule"), (begin + words / 2) / F.col("_target")).alias("position"))

    copies = F.array(*(F.lit(i) for i in range(most_repeats)))
    places = F.when(F.col("_size") > 0, F.filter(F.transform(copies, taken), lambda p: p["words"] > 0)).otherwise(F.array().cast("array<struct<copy:int,words:bigint,position:double>>"))
    out = placed.withColumn("_places", places)
    total = F.aggregate("_places", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return out.withColumn("_taken", total).select(*docs.columns, "_size", "_source_size", "_target", "_taken", "_places")


def mix(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The mix itself: the columns of docs, a row for each taking, sorted by range of training position.

    A cut document's text ends after its last taken word; n_chars, if docs has it, follows. Columns of any name are
    kept (docs' own columns must not begin with an underscore and one of this module's names).
    """
    row = plan(docs, seed, **how).withColumn("_place", F.explode("_places"))
    text = F.when(F.col("_place.words") >= F.col("_size"), F.col("text")).otherwise(first_words(F.col("text"), F.col("_place.words")))
    row = row.withColumn("text", text)
    if "n_chars" in docs.columns:
        row = row.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    row = row.withColumn("_at", F.col("_place.position")).withColumn("_tie", F.xxhash64("doc_id", "_place.copy"))
    return in_training_order(row, "_at", "_tie").select(*docs.columns)


def in_training_order(rows: DataFrame, position: str, tie: str) -> DataFrame:
    """The rows sorted by range of training position, then tie; rows without a position come last, also in ranges."""
    order = [F.col(position).asc_nulls_last(), F.col(tie)]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word; all of it if it has no more."""
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), "")
