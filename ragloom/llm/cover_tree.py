"""Pairs of vectors by cosine, found by dual traversal of cover trees.

Between unit vectors a cosine is a distance, for which the triangle inequality holds. Vectors are dealt into groups; each
group's tree has nested levels whose radii halve: a node's centre is one of its vectors, all its vectors lie within the
level's radius of it, and the centre is a centre of the next level too. Two groups' trees are traversed together from the
top: a pair of nodes is dropped where its centres are farther apart than the threshold and both covering radii (the true ones, which
are at most the level's), counted as a whole where even the farthest members are near enough, and opened
otherwise. Distances of many node pairs come from one matrix product; cosines beside the threshold are computed again in
full precision.

The levels above deal the vectors: centres fitted to a bounded sample, whose cells make up the groups in tree order, so that
near vectors share a group, and groups whose cells are all too far apart never meet. The sample decides work, not results.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.components import components
from ragloom.llm.store import materialise, scratch

#: Vectors that fit the upper levels at most, and their cells.
SAMPLE, CELLS = 4096, 512
#: Bytes of a group's vectors as doubles, and vectors of a group that are worth a task of their own.
GROUP_BYTES, LEAST_GROUP = 1 << 24, 1024
#: Radius of a group's first level, and how many there are; single vectors are the last.
FIRST_RADIUS, LEVELS = 0.5, 5
#: What rounding may change: cosines within SLACK of the threshold are computed again, covering radii are greater by MARGIN.
SLACK, MARGIN = 1e-9, 1e-7
#: Node pairs that are looked at together.
PRODUCT = 1 << 21
#: A vector that more than one in so many rows hold is frequent: there are no more of these.
FREQUENT = 1000


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres among the unit vectors x, the first one first, more than radius apart, and for each vector a centre within radius."""
    least = 1 - radius * radius / 2
    held, n_centres = np.empty_like(x), 0
    centres, owner = np.empty(len(x), dtype=np.int64), np.full(len(x), -1, dtype=np.int64)
    for a in range(0, len(x), 256):
        part = x[a : a + 256]
        left = np.arange(len(part))
        if n_centres:
            best, at = nearest(part, held[:n_centres])
            near = best >= least
            owner[a + left[near]] = centres[at[near]]
            left = left[~near]
        cos, free = part[left] @ part[left].T >= least, np.ones(len(left), dtype=bool)
        for i in range(len(left)):
            if free[i]:
                own = cos[i] & free
                own[i] = True
                owner[a + left[own]] = a + left[i]
                free &= ~own
                centres[n_centres], held[n_centres] = a + left[i], part[left[i]]
                n_centres += 1
    return centres[:n_centres], owner


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest cosine of each x with a centre, and which centre."""
    best, at = np.empty(len(x)), np.empty(len(x), dtype=np.int64)
    step = max(1, PRODUCT // max(1, len(centres)))
    for a in range(0, len(x), step):
        cos = x[a : a + step] @ centres.T
        at[a : a + step] = cos.argmax(axis=1)
        best[a : a + step] = cos.max(axis=1)
    return best, at


def distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cos))


def tree(x: np.ndarray, first_radius: float = FIRST_RADIUS, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """An order of the unit vectors x in which nodes are runs that begin with their centre; and for each level and place where its node begins."""
    order, begin = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    out = np.empty((levels, len(x)), dtype=np.int64)
    for level in range(levels):
        first = np.flatnonzero(begin == np.arange(len(x)))
        size = np.diff(np.r_[first, len(x)])
        begin = np.arange(len(x))
        for f, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            centres, owner = net(x[order[f : f + n]], first_radius / 2**level)
            rank = np.searchsorted(centres, owner)
            by = np.lexsort((np.arange(n) != owner, rank))
            order[f : f + n] = order[f : f + n][by]
            begin[f : f + n] = f + np.searchsorted(rank[by], rank[by])
        out[level] = begin
    return order, out


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, whatever their size."""
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.fsum((x * y).tolist()) / math.sqrt(math.fsum((x * x).tolist()) * math.fsum((y * y).tolist()))


class Group:
    """A group's tree: its vectors in tree order with their weights, and for each level where nodes begin and end and their covering radii."""

    def __init__(self, raw: np.ndarray, begins: np.ndarray, weight: np.ndarray):
        self.raw, self.x, self.levels, n = raw, unit(raw), [], len(raw)
        self.heavy = np.r_[0, np.cumsum(weight)]
        for begin in [*begins, np.arange(n)]:
            at = np.flatnonzero(begin == np.arange(n))
            end = np.r_[at[1:], n]
            apart = distance(np.einsum("ij,ij->i", self.x, self.x[begin]))
            self.levels.append((at, end, np.where(end - at > 1, np.maximum.reduceat(apart, at) + MARGIN, 0.0)))


class Found:
    """Numbers of links by place, and components over places."""

    def __init__(self, n: int):
        self.steps, self.label = np.zeros(n + 1, dtype=np.int64), np.arange(n)

    def add(self, begin: np.ndarray, end: np.ndarray, n: np.ndarray) -> None:
        """n more links for each place from begin to end."""
        np.add.at(self.steps, begin, n)
        np.subtract.at(self.steps, end, n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            i, j = self.label[i], self.label[j]
            apart = i != j
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.label, np.maximum(i, j), np.minimum(i, j))
            while not np.array_equal(further := self.label[self.label], self.label):
                self.label = further


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each begin to its end, and which range each is of."""
    size = end - begin
    which = np.repeat(np.arange(len(begin)), size)
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(which)), which


class Traversal:
    """The links between two groups, or within one (b is a): a place's number of links counts the weights of those linked with it, within a group its own too."""

    def __init__(self, a: Group, b: Group, least: float):
        self.a, self.b, self.own, self.least = a, b, a is b, least
        self.most = math.sqrt(2 - 2 * least)
        self.shift = 0 if self.own else len(a.x)
        self.found = Found(self.shift + len(b.x))
        self.joined: set[tuple[int, int]] = set()
        self.todo: list[tuple[int, np.ndarray, np.ndarray]] = []

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place of a, then of b: its number of links, and the smallest place of its component."""
        (at_a, _, radius_a), (at_b, end_b, radius_b) = self.a.levels[0], self.b.levels[0]
        single = end_b - at_b == 1
        for columns in (np.flatnonzero(single), np.flatnonzero(~single)):
            step = max(1, PRODUCT // max(1, len(columns)))
            for f in range(0, len(at_a) if len(columns) else 0, step):
                cos = self.a.x[at_a[f : f + step]] @ self.b.x[at_b[columns]].T
                far = self.most + radius_a[f : f + step] + radius_b[columns].max() + SLACK
                i, j = np.nonzero(cos >= (1 - np.minimum(far, 2) ** 2 / 2 - SLACK)[:, None])
                self.settle(0, f + i, columns[j], cos[i, j])
        while self.todo:
            self.open(*self.todo.pop())
        return np.cumsum(self.found.steps)[:-1], self.found.label

    def settle(self, level: int, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> None:
        """Node pairs of one level: far ones are dropped, near ones counted, the others kept to be opened."""
        (at_a, to_a, radius_a), (at_b, to_b, radius_b) = self.a.levels[level], self.b.levels[level]
        near = (distance(cos) <= self.most + radius_a[i] + radius_b[j] + SLACK) & ((i <= j) | (not self.own))
        i, j, cos = i[near], j[near], cos[near]
        xa, ya, xb, yb = at_a[i], to_a[i], at_b[j], to_b[j]
        single = (ya - xa == 1) & (yb - xb == 1)
        whole = np.where(single, cos >= self.least, distance(cos) + radius_a[i] + radius_b[j] <= self.most - SLACK)
        for k in np.flatnonzero(single & (np.abs(cos - self.least) < SLACK)).tolist():
            whole[k] = cosine(self.a.raw[xa[k]], self.b.raw[xb[k]]) >= self.least
        rest = ~whole & ~single
        if rest.any():
            self.todo.append((level, i[rest], j[rest]))
        self.count(xa[whole], ya[whole], xb[whole], yb[whole])

    def count(self, xa: np.ndarray, ya: np.ndarray, xb: np.ndarray, yb: np.ndarray) -> None:
        """All places from xa to ya are linked with all from xb to yb."""
        self.found.add(xa, ya, self.b.heavy[yb] - self.b.heavy[xb])
        other = (xa != xb) if self.own else np.ones(len(xa), dtype=bool)
        self.found.add(self.shift + xb[other], self.shift + yb[other], (self.a.heavy[ya] - self.a.heavy[xa])[other])
        for x, y, shift in ((xa, ya, 0), (xb, yb, self.shift)):
            new = set(zip((shift + x[y - x > 1]).tolist(), (shift + y[y - x > 1]).tolist(), strict=True)) - self.joined
            if new:
                self.joined |= new
                begin, end = np.array(sorted(new)).T
                place, which = ranges(begin, end)
                self.found.join(begin[which], place)
        self.found.join(xa, self.shift + xb)

    def open(self, level: int, i: np.ndarray, j: np.ndarray) -> None:
        """The children of node pairs: nodes of the next level between their ends."""
        (at_a, to_a, _), (at_b, to_b, _) = self.a.levels[level], self.b.levels[level]
        next_a, next_b = self.a.levels[level + 1][0], self.b.levels[level + 1][0]
        first_a, last_a = np.searchsorted(next_a, at_a[i]), np.searchsorted(next_a, to_a[i])
        first_b, last_b = np.searchsorted(next_b, at_b[j]), np.searchsorted(next_b, to_b[j])
        size = (last_a - first_a) * (last_b - first_b)
        if len(i) > 1 and size.sum() > PRODUCT:
            self.todo += [(level, i[: len(i) // 2], j[: len(j) // 2]), (level, i[len(i) // 2 :], j[len(j) // 2 :])]
        elif len(i) == 1:
            columns = np.arange(first_b[0], last_b[0])
            step = max(1, PRODUCT // len(columns))
            for f in range(int(first_a[0]), int(last_a[0]), step):
                rows = np.arange(f, min(f + step, int(last_a[0])))
                cos = self.a.x[next_a[rows]] @ self.b.x[next_b[columns]].T
                self.settle(level + 1, np.repeat(rows, len(columns)), np.tile(columns, len(rows)), cos.ravel())
        else:
            place, which = ranges(np.zeros(len(i), dtype=np.int64), size)
            wide = (last_b - first_b)[which]
            p, q = first_a[which] + place // wide, first_b[which] + place % wide
            for f in range(0, len(p), 1 << 16):
                x, y = p[f : f + (1 << 16)], q[f : f + (1 << 16)]
                self.settle(level + 1, x, y, np.einsum("ij,ij->i", self.a.x[next_a[x]], self.b.x[next_b[y]]))


def upper_levels(sample: np.ndarray) -> np.ndarray:
    """Centres of cells among the unit vectors of a sample, in tree order: the finest level of halving radii that has at most CELLS."""
    chosen = np.arange(min(len(sample), CELLS))
    for level in range(8):
        centres, _ = net(sample, 2 / 2**level)
        if len(centres) > CELLS:
            break
        chosen = centres
    order, _ = tree(sample[chosen], 1.0)
    return sample[chosen][order]


def _meeting(near: np.ndarray, first: np.ndarray, size: int) -> list[list[int]]:
    """For each group of `size` places the groups from it on that it meets: those that have a near cell. first: the place where each cell begins, and the end."""
    n = -(-int(first[-1]) // size)
    cells = [(int(np.searchsorted(first, g * size, side="right")) - 1, int(np.searchsorted(first, min((g + 1) * size, first[-1]), side="left"))) for g in range(n)]
    out = []
    for g, (a, b) in enumerate(cells):
        reach = np.r_[0, np.cumsum(near[a:b].any(axis=0))]
        out.append([h for h in range(g, n) if reach[cells[h][1]] > reach[cells[h][0]]])
    return out


def similar_vectors(rows: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row for each row of rows: vec_id, n_links (other rows with a cosine of `least` or more), component_id (the smallest vec_id reachable by links, itself included), kept.

    Cosines are those of double precision. Vectors that are null, empty or zero or hold null or non-finite components link
    with nothing, and none links with a vector of another length. Rows with the same vector are linked; each row counts, also where vec_id
    repeats. A row without vec_id links as others do but names no component; kept says whether component_id is the row's own vec_id (both may be
    null). Other columns are ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(sound, F.col("v")))
    with scratch(spark, "vectors") as folder:
        table = lambda df, name, most=0: materialise(df, name, within=folder)
        vectors = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
        vectors = table(vectors.withColumn("uid", F.monotonically_increasing_id()), "vectors")
        found = table(_found(vectors, least, folder, group_bytes), "found")
        edges = found.where("hub <> uid").select(F.col("uid").alias("a"), F.col("hub").alias("b")).distinct()
        labels = components(edges, table, lambda df, n: df)
        # a vector has met itself once: its own row is no link
        counts = found.groupBy("uid").agg((F.sum("n_links") - 1).alias("n_links"))
        named = vectors.select("uid", "first_id").join(counts, "uid").join(labels.toDF("uid", "label"), "uid", "left")
        named = table(named.select("uid", "first_id", "n_links", F.coalesce("label", "uid").alias("label")), "named")
        roots = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
        classes = table(named.join(roots, "label").select("uid", "n_links", "component_id"), "classes")
        known = vectors.join(classes, "uid").select("v", "n", "n_links", "component_id")
        total = vectors.agg(F.sum("n")).first()[0] or 0
        # rows of frequent vectors meet their class where they are, the others in a shuffle
        frequent = F.broadcast(known.where(F.col("n") * FREQUENT > total).select(F.col("v").alias("fv"), F.col("n_links").alias("f_links"), F.col("component_id").alias("f_component")))
        met = rows.join(frequent, rows["v"] == F.col("fv"), "left")
        done, rest = met.where("fv is not null").select("vec_id", F.col("f_links").alias("n_links"), F.col("f_component").alias("component_id")), met.where("fv is null").select("vec_id", "v")
        rest = rest.join(known.where(F.col("n") * FREQUENT <= total), "v", "left")
        alone = F.when(F.col("v").isNull(), F.col("vec_id"))
        rest = rest.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(alone, "component_id").alias("component_id"))
        out = done.unionByName(rest)
        return materialise(out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")), "similar-vectors")


def _found(vectors: DataFrame, least: float, folder: str, group_bytes: int) -> DataFrame:
    """uid, n_links and hub (the uid of a vector of the same component) for each two groups that meet and each vector that has links there.

    vectors has uid, v and n (rows with that vector). Within its own group a vector counts itself.
    """
    spark = vectors.sparkSession
    lengths = {r["d"]: r["n"] for r in vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    empty = "uid long, n_links long, hub long"
    if not lengths:
        return spark.createDataFrame([], empty)
    usual = max(lengths, key=lambda d: (lengths[d], d))
    sample = vectors.where(F.size("v") == usual).orderBy(F.xxhash64("uid")).limit(SAMPLE).toPandas()
    centres = upper_levels(unit(np.stack(sample["v"]).astype(np.float64)))
    # the usual length's cells, then one cell for each other length
    others = {d: len(centres) + i for i, d in enumerate(sorted(set(lengths) - {usual}))}
    kind = "f4" if "array<float>" in vectors.schema["v"].dataType.simpleString() else "f8"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length = batch["v"].map(len).to_numpy()
            cell, apart = np.array([others.get(d, 0) for d in length.tolist()], dtype=np.int64), np.full(len(batch), 2.0)
            own = np.flatnonzero(length == usual)
            if len(own):
                best, cell[own] = nearest(unit(np.stack(batch["v"].to_numpy()[own]).astype(np.float64)), centres)
                apart[own] = distance(best)
            raw = [np.asarray(v, dtype=f"<{kind}").tobytes() for v in batch["v"]]
            yield pd.DataFrame({"uid": batch["uid"], "n": batch["n"], "raw": raw, "cell": cell, "apart": apart})

    placed = materialise(vectors.select("uid", "n", "v").mapInPandas(place, "uid long, n long, raw binary, cell int, apart double"), "placed", within=folder)
    cells = {r["cell"]: (r["n"], r["apart"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("apart")).collect()}
    n_cells = len(centres) + len(others)
    size = np.array([cells.get(c, (0, 0.0))[0] for c in range(n_cells)])
    radius = np.array([cells.get(c, (0, 0.0))[1] for c in range(n_cells)]) + MARGIN
    near = np.eye(n_cells, dtype=bool)
    near[: len(centres), : len(centres)] |= distance(centres @ centres.T) <= math.sqrt(2 - 2 * least) + radius[: len(centres), None] + radius[None, : len(centres)]

    # groups of about equal size, enough of them for all cores, none too large
    total, cores = int(size.sum()), spark.sparkContext.defaultParallelism
    groups = max(-(-total * 8 * max(lengths) // group_bytes), min(math.isqrt(6 * cores), total // LEAST_GROUP), 1)
    width = -(-total // groups)
    first = np.r_[0, np.cumsum(size)]
    meeting = _meeting(near, first, width)
    begin = F.array(*(F.lit(int(x)).cast("long") for x in first[:-1]))[F.col("cell")]
    many = F.array(*(F.lit(int(x)).cast("long") for x in np.maximum(size, 1)))[F.col("cell")]
    grouped = placed.withColumn("group", ((begin + F.pmod(F.xxhash64("uid"), many)) / width).cast("int"))

    def plant(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for length, part in rows.groupby(rows["raw"].map(len)):
            raw = np.frombuffer(b"".join(part["raw"]), dtype=f"<{kind}").reshape(len(part), -1)
            order, begins = tree(unit(raw.astype(np.float64)))
            blob = lambda x: np.ascontiguousarray(x[order]).tobytes()
            out.append((rows["group"].iloc[0], length, blob(raw), blob(part["uid"].to_numpy()), blob(part["n"].to_numpy()), begins.astype("<i4").tobytes()))
        return pd.DataFrame(out, columns=["group", "length", "raw", "uid", "n", "begins"])

    trees = materialise(grouped.select("group", "uid", "n", "raw").groupBy("group").applyInPandas(plant, "group int, length int, raw binary, uid binary, n binary, begins binary"), "trees", batch=4, within=folder)
    pairs = spark.createDataFrame([(g, h) for g, met in enumerate(meeting) for h in met], "low int, high int")
    ends = pairs.select(F.col("low").alias("group"), "low", "high").unionByName(pairs.where("low <> high").select(F.col("high").alias("group"), "low", "high"))

    def grown(row) -> tuple[Group, np.ndarray]:
        uid = np.frombuffer(row.uid, dtype="<i8")
        raw = np.frombuffer(row.raw, dtype=f"<{kind}").reshape(len(uid), -1).astype(np.float64)
        return Group(raw, np.frombuffer(row.begins, dtype="<i4").reshape(LEVELS, -1).astype(np.int64), np.frombuffer(row.n, dtype="<i8")), uid

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"uid": [], "n_links": [], "hub": []}, dtype=np.int64)]
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        for _, part in rows.groupby("length"):
            sides = {row.group: grown(row) for row in part.itertuples()}
            if low in sides and high in sides:
                (a, uid_a), (b, uid_b) = sides[low], sides[high]
                n, label = Traversal(a, b, least).run()
                uid = uid_a if low == high else np.r_[uid_a, uid_b]
                linked = n > 0
                out.append(pd.DataFrame({"uid": uid[linked], "n_links": n[linked], "hub": uid[label[linked]]}))
        return pd.concat(out)

    return trees.join(ends, "group").groupBy("low", "high").applyInPandas(meet, empty)
