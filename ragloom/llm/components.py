"""Connected components of a table of links."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, table: Callable[[DataFrame, str, int], DataFrame], sent: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """node and label (the smallest node it reaches) of every node of links (a, b).

    Each round a node hangs itself under its smallest neighbour, hanging nodes follow each other to the top, and the links are
    carried over to the tops: what lies within one falls away, so the next round has only the links between them, and at most half
    as many nodes. Every step is written by table (rows, name, most rows); sent marks rows of a known number for a join.
    """
    most = 2 * links.count()
    edges = table(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges", most)
    labels = None
    while True:
        tops = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"))
        tops = _followed(table(tops, "labels", most), table, sent)
        n = tops.count()
        if labels is None:
            labels = tops
        else:
            above = sent(tops.select(F.col("node").alias("top"), F.col("label").alias("above")), n)
            labels = table(labels.join(above, labels["label"] == above["top"], "left").select("node", F.coalesce("above", "label").alias("label")), "labels", most)
        end = lambda x: sent(tops.select(F.col("node").alias(x), F.col("label").alias(f"{x}_top")), n)
        carried = edges.join(end("a"), "a").join(end("b"), "b").select(F.col("a_top").alias("a"), F.col("b_top").alias("b"))
        edges = table(carried.where("a <> b").distinct(), "edges", most)
        if edges.isEmpty():
            return labels


def _followed(labels: DataFrame, table: Callable[[DataFrame, str, int], DataFrame], sent: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """node and label, where each label's own label was followed to its end; steps double in length."""
    n = labels.count()
    while True:
        ahead = labels.select(F.col("node").alias("via"), F.col("label").alias("next"))
        after = table(labels.join(sent(ahead, n), labels["label"] == F.col("via")).select("node", F.col("label").alias("old"), F.col("next").alias("label")), "labels", n)
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels
