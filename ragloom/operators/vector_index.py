"""An inverted-file index of vectors: a table of cells that is built once, appended to, and searched by the nearest cells.

Centres are fitted to a bounded sample by spherical k-means; every vector is stored with the cell of its nearest centre, one folder for
each cell. A search opens the cells that are nearest to a query and scores all vectors in them exactly. How many cells that
takes is measured: for a bounded sample of stored vectors their exact neighbours are found, and the place of each neighbour's cell in
the order of cells says how many have to be opened to find it.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.operators.nearest import nearest, ranked, scaled

#: Cells at most, and the numbers of a sample's vectors that centres are fitted to (its bytes are eight times as many).
MOST_CELLS, SAMPLE_NUMBERS, ROUNDS = 4096, 1 << 23, 12
#: Stored vectors whose exact neighbours say how many cells to open.
ASKED = 400
#: Rows of one file of a cell.
ROWS_A_FILE = 500_000


def kmeans(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centres of length 1 for the rows of x, which have length 1 or none; a centre without rows takes a row that is far from its own."""
    draw = np.random.default_rng(seed)
    centres = x[draw.choice(len(x), size=min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own, near = np.empty(len(x), dtype=np.int64), np.empty(len(x))
        for a in range(0, len(x), 4096):
            cos = x[a : a + 4096] @ centres.T
            own[a : a + 4096], near[a : a + 4096] = cos.argmax(axis=1), cos.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = x[np.argsort(near, kind="stable")[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.divide(sums, length, out=centres.copy(), where=length > 0)
    return centres


class VectorIndex:
    """The index at a path, in tables: `centres` (cell, centre, kind: the type of stored vectors), `vectors` (doc_id, vector, by cell), `settings` (probes, recall of the sample, its vectors)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._centres: np.ndarray | None = None

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, k: int = 5, recall: float = 0.95) -> "VectorIndex":
        """Fit, store and measure an index of vectors (doc_id, vector), which replaces one at the path. cells: by default the root of the rows' number."""
        index = cls(vectors.sparkSession, path)
        vectors = vectors.where("vector IS NOT NULL")
        n, length = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
        sample = vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max(1, SAMPLE_NUMBERS // max(1, length or 1))).toPandas()
        cells = min(MOST_CELLS, cells or math.isqrt(n) or 1)
        centres = kmeans(scaled(sample["vector"].to_list()), cells) if n else np.zeros((1, 1))
        kind = vectors.schema["vector"].dataType.simpleString()
        rows = [(i, c.tolist(), kind) for i, c in enumerate(centres)]
        index.spark.createDataFrame(rows, "cell int, centre array<double>, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        index._centres = centres
        index._write(vectors, "overwrite")
        index.calibrate(k, recall)
        return index

    def append(self, vectors: DataFrame) -> dict[str, int]:
        """Add the vectors whose doc_id the index lacks, to the cells it has; rows with one doc_id count once. Returns how many came and how many it holds."""
        held = self.vectors().select("doc_id")
        before = held.count()
        new = vectors.where("vector IS NOT NULL").dropDuplicates(["doc_id"]).join(held, "doc_id", "left_anti")
        self._write(new, "append")
        total = self.vectors().count()
        return {"added": total - before, "total": total}

    def vectors(self) -> DataFrame:
        kind = self.spark.read.parquet(f"{self.path}/centres").first()["kind"]
        return self.spark.read.schema(f"doc_id long, vector {kind}, cell int").parquet(f"{self.path}/vectors")

    @property
    def centres(self) -> np.ndarray:
        if self._centres is None:
            rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").toPandas()
            self._centres = np.stack(rows["centre"].to_list())
        return self._centres

    @property
    def probes(self) -> int:
        return self.spark.read.parquet(f"{self.path}/settings").first()["probes"]

    def with_cells(self, rows: DataFrame, most: int) -> DataFrame:
        """rows with `cells`: the numbers of the cells nearest to the column vector, the nearest first."""
        sent = self.spark.sparkContext.broadcast(self.centres)

        @F.pandas_udf("array<int>")
        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            centres = sent.value
            for vectors in batches:
                cos = scaled(vectors.to_list()) @ centres.T if len(vectors) else np.zeros((0, len(centres)))
                order = cos.argmax(axis=1)[:, None] if most == 1 else np.argsort(-cos, axis=1, kind="stable")[:, :most]
                yield pd.Series(order.tolist(), dtype=object)

        return rows.withColumn("cells", of("vector"))

    def _write(self, vectors: DataFrame, mode: str) -> None:
        rows = self.with_cells(vectors.select(F.col("doc_id").cast("long").alias("doc_id"), "vector"), 1).select("doc_id", "vector", F.element_at("cells", 1).alias("cell"))
        files = max(1, -(-vectors.count() // (ROWS_A_FILE * len(self.centres))))
        rows.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(files))).write.mode(mode).partitionBy("cell").parquet(f"{self.path}/vectors")

    def calibrate(self, k: int, recall: float, asked: int = ASKED) -> int:
        """Measure on `asked` stored vectors how many cells a search for k has to open to find that share of the neighbours, and store it."""
        held = self.vectors()
        sample = held.orderBy(F.xxhash64("doc_id", F.lit("asked")), "doc_id").limit(asked)
        sample = self.with_cells(sample, len(self.centres)).select(F.col("doc_id").alias("query_id"), "vector", "cells")
        exact = ranked(nearest(held, sample, k, others_only=True), k)
        found = exact.join(held.select("doc_id", "cell"), "doc_id").join(sample.select("query_id", "cells"), "query_id")
        places = sorted(r[0] for r in found.select(F.array_position("cells", F.col("cell")).cast("int")).collect())
        probes = places[max(0, math.ceil(recall * len(places)) - 1)] if places else 1
        reached = sum(p <= probes for p in places) / len(places) if places else 1.0
        self.spark.createDataFrame([(probes, reached, len(places))], "probes int, recall double, neighbours long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/settings")
        return probes

    def search(self, queries: DataFrame, k: int, probes: int | None = None, others_only: bool = False) -> DataFrame:
        """query_id, doc_id, score, rank: the k nearest of each query (query_id, vector) in the `probes` cells nearest to it (by default as many as were measured)."""
        probes = min(probes or self.probes, len(self.centres))
        asks = self.with_cells(queries.where("vector IS NOT NULL"), probes).select("query_id", "vector", F.explode("cells").alias("cell"))
        held = self.vectors()
        if probes < len(self.centres):
            opened = [r[0] for r in asks.select("cell").distinct().collect()]  # no more than there are cells: only their folders are read
            held = held.where(F.col("cell").isin(opened))
        return ranked(nearest(held, asks, k, ("cell",), others_only), k)
