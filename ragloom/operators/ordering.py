"""Steps that need an order over a whole table, without one task that holds it."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a range at least: a small table is one.
LEAST_ROWS = 5_000


def _parts(rows: DataFrame, order: str, parts: int) -> DataFrame:
    """rows with _part: which of at most `parts` ranges of the number `order` they are in; nulls are in the first."""
    parts = min(parts, rows.count() // LEAST_ROWS)
    if parts < 2:
        return rows.withColumn("_part", F.lit(0))
    bounds = rows.stat.approxQuantile(order, [i / parts for i in range(1, parts)], 0.2 / parts)
    edges = F.array(*(F.lit(b) for b in sorted(set(bounds)))) if bounds else F.array().cast("array<double>")
    return rows.withColumn("_part", F.coalesce(F.size(F.filter(edges, lambda b: b <= F.col(order))), F.lit(0)))


def running_before(rows: DataFrame, by: list[str], order: str, value: str, name: str, parts: int = 200) -> DataFrame:
    """rows with `name`: the sum of `value` over the group's rows that come before by `order`, a number that is unique in each group.

    Sums of ranges of `order` are added up first, so a group of any size is in many tasks.
    """
    dealt = _parts(rows, order, parts)
    sums = dealt.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_part").alias("_in"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    inner = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    same = F.col("_part") == F.col("_in")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return placed.join(ahead, same).withColumn(name, F.col("_ahead") + F.col("_inner")).select(*rows.columns, name)


def with_next(rows: DataFrame, order: str, carried: str, parts: int = 200) -> DataFrame:
    """rows with next_<carried>: its value in the next row by `order`, a number that is unique and never null; null in the last row.

    Rows are dealt by at most `parts` ranges of `order`; the first row of each range is copied to the range before it that has rows.
    """
    dealt = _parts(rows, order, parts)
    first = dealt.groupBy("_part").agg(F.min(order).alias("_first"))
    line = Window.orderBy("_part")
    # a row for each range
    first = F.broadcast(first.select("_part", "_first", F.lag("_part").over(line).alias("_to")).where("_to IS NOT NULL"))
    guests = dealt.join(first.select("_first", "_to"), F.col(order) == F.col("_first")).withColumn("_part", F.col("_to")).select(*dealt.columns, F.lit(True).alias("_guest"))
    both = dealt.withColumn("_guest", F.lit(False)).unionByName(guests)
    following = F.lead(carried).over(Window.partitionBy("_part").orderBy(order))
    return both.withColumn(f"next_{carried}", following).where(~F.col("_guest")).drop("_part", "_guest")
