"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word shingles. The sketch of a size band has k blocks;
each shingle is XORed into the block that the leading bits of its hash name. A shingle that only one of
two sets has changes one block at most, so the number of differing blocks (the Hamming distance over
blocks) is a lower bound of the symmetric difference. At a Jaccard similarity of t that is at most
d = floor((1 - t) / t * size) of either set, so among any d + 1 non-empty blocks one agrees
(pigeonhole). Each set sends its d + 1 rarest blocks as join keys, rare by one order for all
documents; the first of them that the other set has too is then among the other's, so no pair is lost.
Pairs that meet are compared by a second sketch, of single bits, and verified on whole sets.

Instead of all pairs of a bucket, each set is first compared with one centre; what this links is
contracted, and only sets that are still in different components of a bucket are compared after that. Where many pairs of
these may be similar, they meet whole in their bucket, which answers with a forest of its links: fewer rows than it has
sets, whatever the number of similar pairs. Buckets with the same sets count as one.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.components import components
from ragloom.llm.store import materialise, scratch
from ragloom.llm.wordhash import chunks, encode, mix, set_digest, shingle_set, word_hashes

_U = np.uint64
#: Cells of the table of counts that says how common a shingle is. It only orders blocks: results don't depend on it.
CELLS = 1 << 20
#: Size bands: the first ends below FIRST_BAND, each later one spans a factor of BAND_STEP.
FIRST_BAND, BAND_STEP = 16, 4
#: Longs of the bit sketch that is compared before whole sets are, and the size of the sets up to which it has as many; each further
#: factor of four in size has four times as many, so that the bits don't fill up.
PARITY_LONGS, PARITY_SIZE = 16, 1024
#: Size of the table that pre-filters rows before joins that shuffle.
FILTER_BITS = 1 << 24
#: About as many sets meet in one bucket; more common blocks are salted into several.
BUCKET = 4096
#: Centres and neighbours that a set is compared with first: more of them save later rounds, results are the same.
CENTRES = 8
#: Pairs of all sets left, for each row of them, that are compared without further rounds.
PAIRS_A_ROW = 1000
#: Sets of a bucket that are compared in one place; a larger bucket is split into groups, and each two of these meet in one place.
BLOCK = 2048
#: Hashes of the whole sets that one group of a bucket holds, about: long sets make more groups.
HASHES = 1 << 21
#: Pairs of a place, and for each set of it, that are verified one by one; where more may be similar, the sets meet whole. Results are the same.
FEW_PAIRS, PAIRS_A_SET = 500, 2
#: Rows of a narrow table that a task writes, and the tasks that write the smallest one.
ROWS_A_TASK, LEAST_TASKS = 50_000, 12
#: Pairs that a task verifies at least, if there are enough.
PAIRS_A_TASK = 1_000
#: Join keys that a task holds at a time, and that one part of the exchange between tasks holds.
HELD, PART = 500_000, 1_000_000
#: A table of at most so many narrow rows is sent to all tasks of a join; one of more rows is shuffled. Results are the same.
MOST_SENT = 50_000


def band_of(size: int) -> int:
    band = 0
    while size >= FIRST_BAND * BAND_STEP**band:
        band += 1
    return band


def blocks_of(band: int) -> int:
    """Blocks of a band's sketch: so many that a set of the band has more than d non-empty ones (it has not with a chance under 1e-11)."""
    return 1 << 20 if band == 0 else max(256, FIRST_BAND * BAND_STEP**band)


def sketch_keys(shingles: np.ndarray, common: np.ndarray, least: float = 0.75) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of one set (ascending hashes) over its bands, and how common each is.

    common: the estimated number of documents by cell of a shingle.
    """
    size = len(shingles)
    keys, counts = [], []
    met = common[(shingles & _U(len(common) - 1)).astype(np.int64)]
    mixed = mix(shingles)
    for band in range(band_of(max(1, int(np.ceil(least * size)))), band_of(size) + 1):
        block = ((shingles >> _U(32)) * _U(blocks_of(band))) >> _U(32)
        opens = np.ones(size, dtype=bool)
        np.not_equal(block[1:], block[:-1], out=opens[1:])
        first = np.flatnonzero(opens)
        parity = np.bitwise_xor.reduceat(mixed, first)
        key = mix(parity ^ mix(block[first] + _U((band + 1) << 40)))
        count = np.minimum.reduceat(met, first)
        differing = int((1 - least) / least * min(size, FIRST_BAND * BAND_STEP**band - 1) + 1e-9)
        if differing + 1 < len(key):
            # by the binary magnitude of the count, then by the key
            order = (np.frexp(count)[1].astype(_U) << _U(58)) | (key >> _U(6))
            rare = np.argpartition(order, differing)[: differing + 1]
            key, count = key[rare], count[rare]
        keys.append(key)
        counts.append(count)
    return np.concatenate(keys), np.concatenate(counts)


def _sets(texts: pd.Series, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingle set of each text."""
    parts = [encode(t).lower() for t in texts]
    for a, b in chunks(parts):
        words, at = word_hashes(parts[a:b])
        for i in range(b - a):
            yield a + i, shingle_set(words[at[i] : at[i + 1]], n)


def parity_bits(shingles: np.ndarray) -> list[int]:
    """The bit sketch: each shingle flips one bit; the Hamming distance is at most the symmetric difference, also of sketches folded to one length."""
    longs, most = PARITY_LONGS, PARITY_SIZE
    while len(shingles) >= most:
        longs, most = 4 * longs, 4 * most
    bits = np.bincount((shingles & _U(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def cell_counts(rows: DataFrame, cells: int) -> np.ndarray:
    """Sum the part tables (cell_part, counts) that tasks made: `cells` numbers reach the driver at any input size."""

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell_part": [key[0]], "counts": [reduce(np.add, (np.frombuffer(x, dtype="<u4") for x in parts["counts"])).astype("<u4").tobytes()]})

    out = np.zeros(cells, dtype=np.uint32)
    for r in rows.where("counts is not null").select("cell_part", "counts").groupBy("cell_part").applyInPandas(add, "cell_part int, counts binary").collect():
        part = np.frombuffer(r["counts"], dtype="<u4")
        out[r["cell_part"] * len(part) :][: len(part)] = part
    return out


def _parts_of(table: np.ndarray, columns: dict) -> pd.DataFrame:
    parts = np.split(table.astype("<u4"), 16)
    return pd.DataFrame({k: [None] * 16 for k in columns} | {"cell_part": range(16), "counts": [p.tobytes() for p in parts]})


def features(docs: DataFrame, n: int = 5) -> DataFrame:
    """Of each document doc_id, n_shingles, set_id (equal sets have equal ids) and parity (its bit sketch); and of each task its counts by cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            sizes, ids, bits, held = [], [], [], []
            for _, s in _sets(batch["text"], n):
                sizes.append(len(s))
                ids.append(set_digest(s))
                bits.append(parity_bits(s))
                held.append((s & _U(CELLS - 1)).astype(np.int64))
                if len(held) >= 1000:
                    table += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
                    held = []
            if held:
                table += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": sizes, "body": batch["body"], "set_id": ids, "parity": bits, "cell_part": None, "counts": None})
        if table.any():
            yield _parts_of(table, {"doc_id": 0, "n_shingles": 0, "body": 0, "set_id": 0, "parity": 0})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("body"))
    return rows.mapInPandas(run, "doc_id long, n_shingles long, body long, set_id long, parity array<long>, cell_part int, counts binary")


def _symbols(docs: DataFrame, common: np.ndarray, n: int, least: float, parts: int) -> DataFrame:
    """The join keys of all sets, packed: a row (part, hot, rows) for each part of the key space that a task has keys of.

    rows holds 64-bit arrays: buckets, sets and, where hot, keys. The bucket is the key, or, where the key is common (hot),
    salted. Copies of a set that a task meets soon after each other count once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def packed(keys: list, counts: list, ids: list, floor: float) -> pd.DataFrame:
        key, count = np.concatenate(keys), np.concatenate(counts)
        own = np.repeat(np.array(ids, dtype=np.int64).view(_U), [len(k) for k in keys])
        salts = np.maximum(1, (count - floor) // BUCKET).astype(_U)
        bucket = np.where(salts > 1, mix(key + mix(own ^ key) % salts), key)
        out = []
        for hot in (False, True):
            these = np.flatnonzero((salts > 1) == hot)
            these = these[np.argsort(bucket[these])]
            part = ((bucket[these] >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
            at = np.searchsorted(part, np.arange(parts + 1))
            for p in np.unique(part).tolist():
                own_rows = these[at[p] : at[p + 1]]
                out.append((p, hot, b"".join(x[own_rows].tobytes() for x in ((bucket, own, key) if hot else (bucket, own)))))
        return pd.DataFrame(out, columns=["part", "hot", "rows"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        floor = 2 * float(table.mean())
        keys, counts, ids, held, seen = [], [], [], 0, set()
        for batch in batches:
            for _, s in _sets(batch["text"], n):
                if len(s) < 3:  # so small a set is similar only to itself
                    continue
                digest = set_digest(s)
                if digest in seen:
                    continue
                seen.add(digest)
                key, count = sketch_keys(s, table, least)
                keys.append(key)
                counts.append(count)
                ids.append(digest)
                held += len(key)
                if held > HELD:
                    yield packed(keys, counts, ids, floor)
                    keys, counts, ids, held = [], [], [], 0
                    seen = seen if len(seen) < HELD else set()
        if keys:
            yield packed(keys, counts, ids, floor)

    return docs.select(F.col("text").cast("string").alias("text")).mapInPandas(run, "part int, hot boolean, rows binary")


def _groups(symbols: DataFrame, parts: int) -> DataFrame:
    """Who meets whom: key, set_id, centre (the smallest set_id of its bucket), before (the next smaller one) and n, how many buckets this stands for.

    A row for each set of each bucket of two sets or more; buckets of the same sets have one key and count in n. The sets of a hot
    key keep it, whichever bucket they were salted into: they meet the sets of its other buckets later.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {False: [], True: []}
        for batch in batches:
            for hot, rows in zip(batch["hot"], batch["rows"], strict=True):
                held[bool(hot)].append(np.frombuffer(rows, dtype=_U).reshape(3 if hot else 2, -1))
        for hot, found in held.items():
            if not found:
                continue
            rows = np.concatenate(found, axis=1)
            found.clear()
            rows = rows[:, np.lexsort((rows[1], rows[0]))]
            rows = rows[:, np.r_[True, (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])]]
            begin = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
            size = np.diff(np.r_[begin, rows.shape[1]])
            centre = rows[1][begin]
            before = np.r_[rows[1][:1], rows[1][:-1]]
            before[begin] = centre
            if hot:
                out = pd.DataFrame({"key": rows[2], "set_id": rows[1], "centre": np.repeat(centre, size), "before": before, "n": np.ones(rows.shape[1], dtype=np.int64)})
            else:
                name = mix(np.add.reduceat(mix(rows[1]), begin) + size.astype(_U))  # of the bucket's sets, as a whole
                order = np.flatnonzero(size > 1)
                _, first, n = np.unique(name[order], return_index=True, return_counts=True)
                kept = order[first]
                many = size[kept]
                at = np.repeat(begin[kept] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                out = pd.DataFrame({"key": np.repeat(name[kept], many), "set_id": rows[1][at], "centre": np.repeat(centre[kept], many), "before": before[at], "n": np.repeat(n, many)})
            for a in range(0, len(out), 100_000):
                yield out.iloc[a : a + 100_000].astype({c: np.int64 for c in out.columns})

    dealt = symbols.repartitionById(parts, F.col("part"))
    return dealt.mapInPandas(run, "key long, set_id long, centre long, before long, n long").groupBy("key", "set_id", "centre", "before").agg(F.sum("n").alias("n"))


def narrowed(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose column may be among the values of `wanted`, its one column: those whose bit is set in a table of fixed size.

    It only keeps rows that no later join needs out of its shuffle; the join itself decides.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    place = wanted.select(bit(wanted.columns[0]).alias("bit"))
    parts = place.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = np.zeros(FILTER_BITS // 8 + 8192, dtype=np.uint8)
    for r in parts.collect():  # FILTER_BITS in all
        part = np.frombuffer(r["bits"], dtype=np.uint8)
        table[(r["part"] - 1) * 4096 :][: len(part)] |= part
    shared = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may(bits: pd.Series) -> pd.Series:
        # bit n is at position (n - 1) % 32768 of part (n - 1) // 32768 + 1
        at = bits.to_numpy() - 1
        return pd.Series((shared.value[at >> 3] >> (at & 7) & 1).astype(bool))

    return rows.where(may(bit(column)))


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """The rows, of which there are n, as a side of a join: sent to all tasks if they are few."""
    return F.broadcast(rows) if n <= MOST_SENT else rows


def _may_be_similar(least: float) -> F.Column:
    """Of columns size_a, parity_a, size_b, parity_b: the sizes and the Hamming distance allow the similarity."""
    a, b = F.col("parity_a"), F.col("parity_b")
    short = reduce(lambda x, y: x + y, (F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(PARITY_LONGS)))
    # sets whose sizes allow the similarity have sketches of one length, or one has four times the other's and is folded
    longs = F.least(F.size(a), F.size(b))
    quarter = lambda p, i, k: F.get(p, i + k * longs)
    folded = lambda p: F.when(F.size(p) == longs, p).otherwise(F.transform(F.sequence(F.lit(0), longs - 1), lambda i: reduce(lambda x, y: x.bitwiseXOR(y), (quarter(p, i, k) for k in range(4)))))
    differing = F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    long = F.aggregate(differing, F.lit(0), lambda x, n: x + n.cast("int"))
    distance = F.when((F.size(a) == PARITY_LONGS) & (F.size(b) == PARITY_LONGS), short).otherwise(long)
    most = F.floor((1 - least) / (1 + least) * (F.col("size_a") + F.col("size_b")) + 1e-9)
    sizes = F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b")
    return F.when(sizes, distance <= most).otherwise(False)


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each place (key, low, high), which come one after the other but may begin in one batch and end in a later one."""
    held = []
    for batch in batches:
        place = batch[["key", "low", "high"]].to_numpy()
        cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if held and (place[x] != held[0][["key", "low", "high"]].to_numpy()[0]).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.iloc[x:y])
    if held:
        yield pd.concat(held)


def _near(rows: pd.DataFrame, label: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """For rows of one place (in order of size) the later ones that may be similar, nearest first: of different labels, as they are
    by then, and, where two groups meet, of different groups."""
    size = rows["size"].to_numpy()
    group = rows["own"].to_numpy() if rows["low"].iloc[0] != rows["high"].iloc[0] else None
    sketches = [p.view(_U) for p in rows["parity"]]
    longs = np.array([len(p) for p in sketches])
    table = np.stack(sketches) if (longs == longs[0]).all() else None
    stop = np.searchsorted(size, np.floor(size / least + 1e-9), side="right")
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, stop[i])
        j = j[label[j] != label[i]]
        if group is not None:
            j = j[group[j] != group[i]]
        if not len(j):
            continue
        if table is not None:
            distance = np.bitwise_count(table[j] ^ table[i]).sum(axis=1)
        else:  # sketches of two lengths: the longer is folded
            distance = np.empty(len(j), dtype=np.int64)
            for at, k in enumerate(j.tolist()):
                n = min(longs[i], longs[k])
                x, y = (np.bitwise_xor.reduce(sketches[z].reshape(-1, n), axis=0) for z in (i, k))
                distance[at] = np.bitwise_count(x ^ y).sum()
        near = np.flatnonzero(distance <= np.floor((1 - least) / (1 + least) * (size[i] + size[j]) + 1e-9))
        if len(near):
            yield i, j[near[np.argsort(distance[near], kind="stable")]]


def _similar(x: np.ndarray, others: list[np.ndarray], least: float) -> np.ndarray:
    """Which of the other sets have at least the similarity with x; sets are ascending and not empty."""
    many = np.array([len(o) for o in others])
    every = np.concatenate(others)
    met = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
    shared = np.add.reduceat(met.astype(np.int64), np.cumsum(many) - many)
    return 100 * shared >= 100 * least * (len(x) + many - shared) - 1e-9


def _forest(rows: pd.DataFrame, least: float) -> Iterator[tuple[int, int]]:
    """Similar pairs of one place, compared by whole sets (hashes), that connect all labels that any of its similar pairs does: fewer than it has labels."""
    label, sets, hashes = rows["label"].to_numpy().copy(), rows["set_id"].to_numpy(), [np.frombuffer(x, dtype="<u8") for x in rows["hashes"]]
    for i, near in _near(rows, label, least):
        step = 8
        while len(near):
            now, near = near[:step], near[step:]
            for k in now[_similar(hashes[i], [hashes[k] for k in now], least)].tolist():
                if label[k] != label[i]:
                    a, b = int(sets[i]), int(sets[k])
                    yield (a, b) if a < b else (b, a)
                    label[label == label[k]] = label[i]
            near, step = near[label[near] != label[i]], 2 * step


class _Join:
    """One run of the join: its tables, in a folder of their own."""

    def __init__(self, docs: DataFrame, first: DataFrame, n: int, least: float, folder: str):
        self.docs, self.first, self.n, self.least, self.folder = docs, first, n, least, folder
        self.sets: DataFrame | None = None

    def table(self, df: DataFrame, name: str, most: int, batch: int = 1000) -> DataFrame:
        """df as a table; of at most `most` rows, which says how many tasks write it."""
        return materialise(df.coalesce(max(LEAST_TASKS, most // ROWS_A_TASK)), name, batch, self.folder)

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ...) whose bit sketches differ in no more places than sets with the similarity can."""
        side = lambda x: self.first.select(F.col("set_id").alias(x), F.col("size").alias(f"size_{x}"), F.col("parity").alias(f"parity_{x}"))
        n = pairs.count()
        left = side("a").join(_sent(pairs, n), "a")
        return side("b").join(_sent(left, 8 * n), "b").where(_may_be_similar(self.least)).select(*pairs.columns)

    def whole_sets(self, of: DataFrame) -> DataFrame:
        """set_id and hashes (the set: little-endian 64-bit, ascending) of the sets in `of`, from the text of one document (first_id, first_body) of each."""
        n, words = of.count(), self.n
        docs = self.docs.withColumn("body", F.xxhash64("text"))
        docs = docs if n <= MOST_SENT else narrowed(docs, "body", of.select("first_body"))
        texts = docs.join(_sent(of, n), docs["body"].eqNullSafe(of["first_body"]) & docs["doc_id"].eqNullSafe(of["first_id"]), "left_semi")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for a in range(0, len(batch), 500):
                    part = batch.iloc[a : a + 500]
                    yield pd.DataFrame([(set_digest(s), s.astype("<u8").tobytes()) for _, s in _sets(part["text"], words)], columns=["set_id", "hashes"])

        return materialise(texts.select("text").mapInPandas(run, "set_id long, hashes binary"), "sets", within=self.folder)

    def hold(self, wanted: DataFrame, n: int) -> None:
        """See to it that self.sets has the whole sets of `wanted` (set_id), which has at most n rows."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("set_id"), "set_id", "left_anti")
        of = self.first.join(_sent(wanted, n), "set_id", "left_semi").select("first_id", "first_body")
        made = self.whole_sets(self.table(of, "wanted", n))
        self.sets = made if self.sets is None else self.sets.union(made)

    def links(self, pairs: DataFrame, most: int) -> DataFrame:
        """The pairs (a, b), at most `most`, whose sets have at least the similarity, as a table."""
        pairs, least = self.table(pairs, "pairs", most), self.least
        n = pairs.count()
        if not n:
            return pairs
        self.hold(pairs.select("a").union(pairs.select("b")).distinct().toDF("set_id"), 2 * n)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keep = []
                for x, y in zip(batch["x"], batch["y"], strict=True):
                    x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    keep.append(100 * shared >= 100 * least * (len(x) + len(y) - shared) - 1e-9)
                yield batch.loc[keep, ["a", "b"]]

        def side(x: str, y: str) -> DataFrame:
            rows = self.sets.select(F.col("set_id").alias(x), F.col("hashes").alias(y))
            return rows.join(_sent(pairs.select(x), n), x, "left_semi") if n <= MOST_SENT else narrowed(rows, x, pairs.select(x))

        both = side("a", "x").join(_sent(pairs, n), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
        both = both.coalesce(max(LEAST_TASKS, n // PAIRS_A_TASK))
        return self.table(both.mapInPandas(run, "a long, b long").distinct(), "links", n, batch=100)  # a row holds two whole sets

    def components(self, links: DataFrame) -> DataFrame:
        return components(links, self.table, _sent)

    def run(self, met: DataFrame) -> DataFrame:
        """set_id, label (the same for the sets of a component) and n_links of every set that has a link; met: see _groups."""
        most = met.count()
        # each set is compared with the centres and neighbours that it meets most often among those that may be similar
        stars = met.where("set_id <> centre").select(F.col("set_id").alias("a"), F.explode(F.array_distinct(F.array("centre", "before"))).alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("n"))
        near = self.near(self.table(stars, "stars", 2 * most)).groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "b")), False), 1, CENTRES).alias("best"))
        links = self.links(near.select("a", F.explode("best.b").alias("b")), CENTRES * most)
        # Next, in each bucket that still holds several components, its sets meet one set of another component, drawn
        # anew in every round, until a round links little or the pairs left are few. Last, these meet each other.
        drawn, rows, found, few = 0, met.select("key", "set_id").distinct(), links.count(), False
        while True:
            labels = self.components(links)
            placed = rows.join(_sent(labels, 2 * found), rows["set_id"] == labels["node"], "left").select("key", "set_id", F.coalesce("label", "set_id").alias("label"))
            draw = F.struct("label", F.xxhash64("set_id", "key", F.lit(drawn)).alias("draw"), "set_id")
            ends = placed.groupBy("key").agg(F.min(draw).alias("low"), F.max(draw).alias("high"), F.count("*").alias("n")).where("low.label <> high.label").select(F.col("key").alias("in_key"), "low", "high", "n")
            mixed = self.table(placed.join(ends, placed["key"] == ends["in_key"]).drop("in_key"), "mixed", most)
            size = mixed.agg(F.count("*").alias("rows"), F.sum("n").alias("pairs")).first()
            if few or (size["pairs"] or 0) <= PAIRS_A_ROW * size["rows"]:
                break
            rows = mixed.select("key", "set_id")
            other = F.when(F.col("label") != F.col("low.label"), F.col("low.set_id")).otherwise(F.col("high.set_id"))
            met_now = mixed.select(F.least("set_id", other).alias("a"), F.greatest("set_id", other).alias("b")).distinct()
            more = self.links(self.near(self.table(met_now, "drawn", most)), most)
            new = more.count()
            few = 20 * new <= found
            links, drawn, found = links.union(more), drawn + 1, found + new
        more = self.apart(mixed, most)
        links = links.union(more)
        return self.counted(links, labels if more.isEmpty() else self.components(links))

    def placed(self, rows: DataFrame, groups: F.Column) -> DataFrame:
        """The sets of buckets (key, set_id, label) dealt to places (low, high): groups of a bucket (own), each two of which meet in one."""
        own = F.pmod(F.xxhash64("set_id"), groups.cast("int")).cast("int")
        places = F.transform(F.sequence(F.lit(0), groups.cast("int") - 1), lambda j: F.struct(F.least(own, j).alias("low"), F.greatest(own, j).alias("high")))
        return rows.select("key", "set_id", "label", own.alias("own"), F.explode(places).alias("place")).select("key", "set_id", "label", "own", "place.low", "place.high")

    def apart(self, mixed: DataFrame, most: int) -> DataFrame:
        """Links (a, b) that connect what the similar pairs of each bucket (key, set_id, label, n: its sets) connect across labels; mixed has at most `most` rows.

        Where few pairs of a place may be similar by their sketches, these are verified once for all buckets. Where there are more
        than FEW_PAIRS, and than PAIRS_A_SET for each set that is in one, these sets meet again as whole sets.
        """
        least, place = self.least, ["key", "low", "high"]
        sketches = self.first.select("set_id", "size", "parity")
        rows = self.placed(mixed, F.ceil(F.col("n") / BLOCK)).join(sketches, "set_id").repartition(*place).sortWithinPartitions(*place, "size")

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = set()
            for part in _places(batches):
                label, sets = part["label"].to_numpy(), part["set_id"].to_numpy()
                may, pairs, n = np.zeros(len(part), dtype=bool), [], 0
                for i, j in _near(part, label, least):
                    may[i] = may[j] = True
                    pairs.append((i, j))
                    n += len(j)
                if n > max(FEW_PAIRS, PAIRS_A_SET * int(may.sum())):
                    # places of the same sets have one key, so that these meet once
                    name = mix(mix(sets[may].view(_U)).sum(keepdims=True) + _U(may.sum())).view(np.int64)[0]
                    yield pd.DataFrame({"a": sets[may], "b": label[may], "key": name, "size": part["size"].to_numpy()[may], "paired": False})
                else:
                    found.update((min(x), max(x)) for i, j in pairs for x in ((int(sets[i]), int(sets[k])) for k in j))
                if len(found) > HELD:
                    yield pd.DataFrame(sorted(found), columns=["a", "b"]).assign(key=0, size=0, paired=True)
                    found = set()
            if found:
                yield pd.DataFrame(sorted(found), columns=["a", "b"]).assign(key=0, size=0, paired=True)

        found = self.table(rows.mapInPandas(near, "a long, b long, key long, size long, paired boolean").distinct(), "near", most)
        links = self.links(found.where("paired").select("a", "b"), most)
        found = found.where("not paired").select("key", F.col("a").alias("set_id"), F.col("b").alias("label"), "size")
        n = found.count()
        if not n:
            return links
        wanted = found.select("set_id").distinct()
        self.hold(wanted, n)
        whole = self.sets.join(_sent(wanted, n), "set_id", "left_semi") if n <= MOST_SENT else narrowed(self.sets, "set_id", wanted)
        sums = found.groupBy(F.col("key").alias("in_key")).agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / HASHES)).alias("groups"))
        rows = self.placed(found.join(sums, found["key"] == sums["in_key"]), F.col("groups"))
        rows = rows.join(sketches, "set_id").join(whole, "set_id").repartition(*place).sortWithinPartitions(*place, "size")

        def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = set()
            for part in _places(batches):
                found.update(_forest(part, least))
                if len(found) > HELD:
                    yield pd.DataFrame(sorted(found), columns=["a", "b"])
                    found = set()
            if found:
                yield pd.DataFrame(sorted(found), columns=["a", "b"])

        more = self.table(rows.mapInPandas(forest, "a long, b long").distinct(), "links", n, batch=100)  # a row holds a whole set
        return links.union(more)

    def counted(self, links: DataFrame, labels: DataFrame) -> DataFrame:
        n = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        return labels.join(n, "node").select(F.col("node").alias("set_id"), "label", "n_links")


def similar(docs: DataFrame, n: int = 5, least: float = 0.75) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, n_links, set_id (the same for equal sets) and body (a hash of the text).

    docs needs doc_id and text; words are lower-cased (A-Z) and split at space and \\x09-\\x0D. Two documents are
    linked if their sets of n-word shingles have a Jaccard similarity of `least` or more. component_id is the smallest
    doc_id reachable by links, itself included. n_links counts the links that were verified between its set and
    others: enough to connect every component, not all. Null and empty texts have no shingles and stay alone; texts
    of fewer than n words are one shingle. Rows with equal doc_id are documents of their own; a null doc_id never
    names a component that has another. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession, "jaccard") as folder:
        made = materialise(features(docs, n), "features", within=folder)
        common = cell_counts(made, CELLS)
        own = made.where("counts is null").select("doc_id", "n_shingles", "body", "set_id")
        # a doc_id of null comes last
        one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body"))
        first = made.where("n_shingles > 0").groupBy("set_id").agg(one.alias("one"), F.first("n_shingles").alias("size"), F.first("parity").alias("parity"))
        first = materialise(first.select("set_id", F.col("one.doc_id").alias("first_id"), F.col("one.body").alias("first_body"), "size", "parity"), "first", within=folder)
        keys = first.agg(F.sum("size")).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys // 2 // PART)
        met = materialise(_groups(_symbols(docs, common, n, least, parts), parts), "met", within=folder)
        linked = _Join(docs, first, n, least, folder).run(met)
        tasks = max(LEAST_TASKS, own.count() // ROWS_A_TASK)
        first = first.select("set_id", "first_id")
        smallest = first.join(linked, "set_id").select("set_id", "first_id", "label", "n_links")
        roots = smallest.groupBy("label").agg(F.min("first_id").alias("root"))
        classes = materialise(smallest.join(roots, "label").select("set_id", "root", "n_links").coalesce(tasks), "classes", within=folder)
        alone = first.select("set_id", F.col("first_id").alias("root"), F.lit(0).cast("long").alias("n_links")).join(classes.select("set_id"), "set_id", "left_anti")
        out = own.join(classes.unionByName(alone), "set_id", "left")
        return materialise(out.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "set_id", "body").coalesce(tasks), "similar")


def keep_one(docs: DataFrame, n: int = 5, least: float = 0.75) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays.

    Rows whose text has no words are in no group and all stay; repeated rows of a document that stays all stay, and so do
    rows without a doc_id that are alone. Columns and their order stay as they are.
    """
    found = similar(docs, n, least)
    stay = found.where("n_shingles > 0 and doc_id <=> component_id").select(F.col("doc_id").alias("_keep"), F.col("body").alias("_body")).distinct()
    named = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rest = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    kept = named.join(stay, named["doc_id"].cast("long").eqNullSafe(stay["_keep"]) & (F.xxhash64(named["text"]) == stay["_body"]), "left_semi")
    return kept.unionByName(rest)
