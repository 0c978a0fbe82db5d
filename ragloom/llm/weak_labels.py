"""A quality classifier from weak labels: heuristic labellers vote, expectation maximisation finds how right each is, and the
posterior labels train a linear scorer over hashed features.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.llm.quality_rules import base_counts
from ragloom.llm.wordhash import chunks, encode, word_hashes

#: Weights of the scorer (a power of two), and documents whose features are fetched to train it, those with the smallest hashes.
CELLS, SAMPLE = 1 << 16, 4000
#: Share of good documents that the first round of estimation begins with.
PRIOR = 0.8
#: Beforehand, votes (none, bad, good) of a labeller that votes both ways on bad and on good documents; and how much that
#: weighs beside the votes, as a share of all documents. It keeps every labeller on its own side.
EXPECTED = np.array([[0.4, 0.25, 0.35], [0.3, 0.05, 0.65]])
BELIEF = 0.1


def votes(text: Column) -> Column:
    """Array of the labellers' votes on a whole text: 1 good, 0 bad, -1 none. A null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    stops = F.regexp_count(text, F.lit(r"[.!?](?:\s|$)"))
    stats = F.struct(base_counts(text).alias("c"), letters.alias("letters"), capitals.alias("capitals"), stops.alias("stops"))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    def all_of(s: Column) -> Column:
        c = s["c"]
        n = F.greatest(c["n_words"], F.lit(1))
        size = F.greatest(F.length(text), F.lit(1))
        mean = c["word_chars"] / n
        never = F.lit(False)
        return F.array(
            vote(c["n_words"] < 10, c["n_words"].between(50, 20_000)),
            vote(s["stops"] * 60 < n, (s["stops"] * 25 > n) & (s["stops"] * 2 < n)),
            vote((mean < 2.5) | (mean > 14), mean.between(3.5, 9)),
            vote(c["n_symbols"] > 0.2 * n, never),
            vote(c["n_repeat_words"] > 0.3 * n, never),
            vote(s["capitals"] > 0.4 * F.greatest(s["letters"], F.lit(1)), never),
            vote(s["letters"] < 0.6 * size, never),
            vote(c["n_dup_lines"] > 3, never),
        )

    return F.element_at(F.transform(F.array(stats), all_of), 1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good by pattern of votes, the labellers' rates (class, labeller, vote -1/0/1), and the share of good.

    Votes are taken as independent given the class. Labellers begin as right more often than not, which settles which
    class is the good one.
    """
    n, m = patterns.shape
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    ever = onehot.any(axis=0)
    belief = np.where(ever[:, 2:], EXPECTED[:, None, :], [[[0.7, 0.3, 0.0]], [[0.98, 0.02, 0.0]]])
    belief = (belief + 1e-3) / (belief + 1e-3).sum(axis=2, keepdims=True)
    rates, held = belief.copy(), BELIEF * counts.sum()
    prior, post = PRIOR, np.full(n, PRIOR)
    for _ in range(rounds):
        like = np.stack([np.einsum("nmv,mv->n", onehot, np.log(rates[k])) for k in (0, 1)]) + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        for k, w in enumerate((counts * (1 - post), counts * post)):
            rates[k] = (np.einsum("n,nmv->mv", w, onehot) + held * belief[k]) / (w.sum() + held)
        prior = float(np.clip((counts * post).sum() / max(1e-9, counts.sum()), 0.01, 0.99))
        if done:
            break
    return post, rates, prior


def hashed(raw: bytes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their weights: runs of three bytes in the lower half of the table and words in the upper, each half summing to 1."""
    half = CELLS // 2
    parts = []
    if len(raw) > 2:
        b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
        parts.append(((b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA6B + b[2:] * 0xC2B2AE35) >> 16) % half)
    if len(words):
        parts.append((words % np.uint64(half)).astype(np.uint32) + half)
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    cells, counts = np.unique(np.concatenate(parts), return_counts=True)
    weight = np.where(cells < half, 1 / max(1, len(raw) - 2), 1 / max(1, len(words)))
    return cells.astype(np.int64), counts * weight


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 6) -> np.ndarray:
    """Weights (the last is the constant) of a logistic scorer by adaptive gradient steps on (cells, weights, posterior)."""
    w, seen = np.zeros(CELLS + 1), np.full(CELLS + 1, 1e-3)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            cells, x, y = rows[i]
            cells, x = cells.astype(np.int64), x.astype(float)
            z = w[cells] @ x * 30 + w[-1]
            miss = y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            step = miss * x * 30
            seen[cells] += step**2
            w[cells] += 0.3 * step / np.sqrt(seen[cells])
            seen[-1] += miss**2
            w[-1] += 0.1 * miss / np.sqrt(seen[-1])
    return w


def fit(docs: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, dict]:
    """Scorer weights, and what estimation found: rates and share. Votes of all documents are counted; at most 3**8 patterns reach the driver."""
    voted = docs.select(F.concat_ws(",", F.transform(votes(F.col("text")), lambda v: v.cast("string"))).alias("votes"))
    found = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    if not found:
        return np.zeros(CELLS + 1), {}
    patterns = np.array([[int(v) for v in r["votes"].split(",")] for r in found])
    post, rates, share = estimate(patterns, np.array([r["n"] for r in found], dtype=float))
    by_votes = {r["votes"]: float(p) for r, p in zip(found, post, strict=True)}
    # at most `most` ids, so this side of the join is small at any input size; their features come packed
    ids = docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(most).select(F.col("doc_id").alias("_of")).distinct()
    some = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_of"), "left_semi")
    some = some.withColumn("votes", F.concat_ws(",", F.transform(votes(F.col("text")), lambda v: v.cast("string"))))

    @F.pandas_udf("struct<cells:binary,weights:binary>")
    def cells(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(c.astype("<u2").tobytes(), w.astype("<f4").tobytes()) for c, w in (hashed(*x) for x in _parts(texts))], columns=["cells", "weights"])

    # of rows with one doc_id one stays
    some = some.select("doc_id", "votes", cells("text").alias("f")).groupBy("doc_id").agg(F.min(F.struct("votes", "f.cells", "f.weights")).alias("r")).select("doc_id", "r.*")
    rows = [(r["doc_id"], np.frombuffer(r["cells"], dtype="<u2"), np.frombuffer(r["weights"], dtype="<f4"), by_votes[r["votes"]]) for r in some.coalesce(8).toLocalIterator()]
    rows.sort(key=lambda r: (r[0], len(r[1])))
    return train_scorer([r[1:] for r in rows]), {"rates": rates, "share": share}


def _parts(texts: pd.Series) -> Iterator[tuple[bytes, np.ndarray]]:
    parts = [encode(t) for t in texts]
    for a, b in chunks(parts):
        words, at = word_hashes(parts[a:b])
        for i in range(a, b):
            yield parts[i], words[at[i - a] : at[i - a + 1]]


def score(docs: DataFrame, weights: np.ndarray, name: str = "quality") -> DataFrame:
    """docs with a column `name`, 0 to 1, from each whole text. Null and empty texts get the scorer's constant alone.

    Every column of docs stays but one of that name, which the score replaces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        half = CELLS // 2
        for texts in batches:
            out = []
            for raw, words in _parts(texts):
                z = w[-1]
                if len(raw) > 2:
                    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
                    z += 30 * w[((b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA6B + b[2:] * 0xC2B2AE35) >> 16) % half].mean()
                if len(words):
                    z += 30 * w[(words % np.uint64(half)).astype(np.int64) + half].mean()
                out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pd.Series(out, dtype=float)

    return docs.withColumn(name, run(F.col("text").cast("string")))
