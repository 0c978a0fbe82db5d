import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.llm import jaccard
from ragloom.llm.wordhash import encode, shingle_set, word_hashes


def shingles(text):
    ascii_lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, least=0.75):
    sets = [shingles(r[1]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= least * len(a | b):
                label[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None) if sets[i] else r[0]))
    return out


def key(row):
    return tuple(-1 if v is None else v for v in row)


def test_matches_brute_force(docs, rows):
    got = [tuple(r) for r in jaccard.similar(docs).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_empty_table(empty):
    assert jaccard.similar(empty).count() == 0


def test_keep_one(docs, rows):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    want = {d for d, n, c in brute(rows) if d == c or not n}
    assert ids == want


def test_word_hashes_are_those_of_words():
    texts = ["a bc  a", "", "bc\ta\x0bbc\n", " x "]
    hashes, at = word_hashes([encode(t) for t in texts])
    words = [w for t in texts for w in t.split()]
    assert len(hashes) == len(words) and [int(x) for x in np.diff(at)] == [len(t.split()) for t in texts]
    assert len({(w, int(h)) for w, h in zip(words, hashes, strict=True)}) == len(set(words)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("size", [3, 10, 70, 300, 1100, 5000])
def test_similar_sets_share_a_key(size):
    """The pigeonhole bound: whatever differs, two sets of similarity 0.75 or more share one of their keys."""
    r = np.random.default_rng(size)
    common = np.zeros(jaccard.CELLS, dtype=np.uint32)
    for _ in range(30):
        a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        gone = int(r.integers(0, size // 4 + 1))
        more = int((len(a) - gone) / 0.75 - len(a) + 1e-9)
        b = np.unique(np.concatenate([a[r.permutation(len(a))[gone:]], r.integers(0, 2**63, max(0, more), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert both >= 0.75 * len(np.union1d(a, b)) - 1e-9
        assert set(jaccard.sketch_keys(a, common)[0].tolist()) & set(jaccard.sketch_keys(b, common)[0].tolist())
        bits = [np.array(jaccard.parity_bits(x)).view(np.uint64) for x in (a, b)]
        least = min(map(len, bits))
        bits = [np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in bits]
        assert sum(int(x).bit_count() for x in bits[0] ^ bits[1]) <= len(np.setxor1d(a, b))


def test_short_texts():
    words, _ = word_hashes([b"one two"])
    assert len(shingle_set(words)) == 1 and len(shingle_set(words[:0])) == 0


def test_rows_without_id_stay_unless_copied(spark):
    long = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(None, "alone here in this row of words"), (None, long), (4, long), (4, "another text of the same id entirely")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text[:5]) for r in jaccard.keep_one(frame).collect()) == [(0, "alone"), (4, "anoth"), (4, "w0 w1")]


def test_variants_of_many_copies_are_linked(spark):
    """So many copies of a text salt its keys; a variant that is alone in its salt still meets them."""
    families, copies = 4, 20_000
    base = F.concat_ws(" ", *(F.concat(F.lit(f"w{i}x"), F.col("id") % families) for i in range(10)))
    many = spark.range(families * copies).select((F.col("id") + families).alias("doc_id"), base.alias("text"))
    variants = spark.range(families).select(F.col("id").alias("doc_id"), F.concat(base, F.lit(" more")).alias("text"))
    found = jaccard.similar(many.unionByName(variants)).groupBy("component_id").count().collect()
    assert sorted(map(tuple, found)) == [(i, copies + 1) for i in range(families)]


def test_folded_sketches_in_spark(spark):
    """The distance of sketches of one and of two lengths, as numpy has it."""
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 2**63, 5000, dtype=np.uint64))
    sets = [base[:n] for n in (900, 1020, 1100, 1300, 3900, 4200, 5000)] + [np.unique(r.integers(0, 2**63, 1000, dtype=np.uint64))]
    frame = spark.createDataFrame([(i, len(s), jaccard.parity_bits(s)) for i, s in enumerate(sets)], "i int, size long, parity array<long>")
    sides = [frame.select(*(F.col(c).alias(f"{c}_{x}") for c in frame.columns)) for x in "ab"]
    got = {(x.i_a, x.i_b): x.near for x in sides[0].join(sides[1], F.col("i_a") < F.col("i_b")).select("i_a", "i_b", jaccard._may_be_similar(0.75).alias("near")).collect()}
    for (a, b), near in got.items():
        x, y = sets[a], sets[b]
        similar = len(np.intersect1d(x, y)) >= 0.75 * len(np.union1d(x, y))
        assert near or not similar
        assert near == similar, (a, b)


@pytest.mark.parametrize("bucket", [4, 4096])
def test_small_buckets_and_blocks_lose_nothing(spark, monkeypatch, bucket):
    """Keys of four sets are salted already, buckets of three are split, and many copies stand beside near ones."""
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "CENTRES", 1)
    r = np.random.default_rng(9)
    word = lambda: "w" + str(int(r.integers(0, 5000)))
    texts = []
    for n in (8, 14, 40, 80, 300):
        base = [word() for _ in range(n)]
        for _ in range(12):
            own = list(base)
            for at in r.choice(n, max(1, n // 25), replace=False):
                own[at] = word()
            texts.append(" ".join(own))
            base = own if r.random() < 0.5 else base
        texts += [" ".join(base)] * 30
    told = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(told, "doc_id long, text string").repartition(5)
    got = [tuple(x) for x in jaccard.similar(frame).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(brute(told))


@pytest.mark.parametrize("pairs_a_set", [0, 2, 10**6])
def test_links_of_a_dense_bucket_are_fewer_than_its_sets(spark, monkeypatch, pairs_a_set):
    """Near copies about the least similarity: whichever way pairs are verified, nothing is lost; met whole, a bucket's links are a forest."""
    monkeypatch.setattr(jaccard, "CENTRES", 1)
    monkeypatch.setattr(jaccard, "FEW_PAIRS", 0)
    monkeypatch.setattr(jaccard, "PAIRS_A_SET", pairs_a_set)
    asked, last = [], jaccard._Join.apart

    def apart(self, mixed, *more):
        asked.append((mixed.select("set_id").distinct().count(), (found := last(self, mixed, *more)).count()))
        return found

    monkeypatch.setattr(jaccard._Join, "apart", apart)
    r = np.random.default_rng(4)
    base = [f"w{i}" for i in range(160)]
    told = []
    for i in range(120):
        own = list(base)
        for at in r.choice(160, 4 if i % 2 else 2, replace=False):
            own[at] = f"x{r.integers(0, 10**9)}"
        told.append((i, " ".join(own)))
    frame = spark.createDataFrame(told, "doc_id long, text string").repartition(4)
    got = [tuple(x) for x in jaccard.similar(frame).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(brute(told))
    assert asked and (pairs_a_set > 2 or asked[0][1] < 2 * asked[0][0])


def test_a_place_answers_with_a_forest():
    """Two components of 60 sets each, all pairs similar: one link connects them."""
    r = np.random.default_rng(8)
    core = r.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([core, r.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(120)] + [np.unique(r.integers(0, 2**63, 303, dtype=np.uint64))]
    rows = [(5, 0, 0, 0, i, 1 if i < 60 else 2, len(s), np.array(jaccard.parity_bits(s)), s.astype("<u8").tobytes()) for i, s in enumerate(sets)]
    place = jaccard.pd.DataFrame(rows, columns=["key", "low", "high", "own", "set_id", "label", "size", "parity", "hashes"])
    place.loc[120, "label"] = 3
    (a, b), = jaccard._forest(place, 0.75)
    assert a < 60 <= b < 120
    near = list(jaccard._near(place, place["label"].to_numpy(), 0.75))
    assert sum(len(j) for _, j in near) == 3600


def test_components_carry_links_over(spark):
    """Later rounds have only the links between what earlier ones joined; a long chain takes few rounds."""
    from ragloom.llm.components import components

    written = []

    def table(df, name, most):
        out = df.localCheckpoint()
        written.append((name, out.count()))
        return out

    r = np.random.default_rng(2)
    chain = r.permutation(400)
    links = [(int(a), int(b)) for a, b in zip(chain, chain[1:])] + [(1000, int(x)) for x in range(1001, 1400)] + [(5000, 5000)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), table, lambda df, n: df).select("node", "label").collect()))
    assert got == {int(x): 0 for x in chain} | dict.fromkeys(range(1000, 1400), 1000) | {5000: 5000}
    edges = [n for name, n in written if name == "edges"]
    assert edges[-1] == 0 and len(edges) < 12 and all(2 * y <= x for x, y in zip(edges, edges[1:]))
