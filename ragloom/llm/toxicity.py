"""Toxicity by a subsequence string kernel, a Nystroem map and a support vector machine.

Two words are alike in the kernel if they share many subsequences of three letters, a subsequence counting less the wider
it is spread: letters that are inserted or left out of an insult lower its likeness a little only. A word is mapped
to its likeness to a few landmark words, whitened (Nystroem), and a linear machine scores it. A document's words
are its candidates: the machine is trained on the word that speaks most for the label of each toxic document, found anew
in every round, and on the words of clean documents that come closest.
"""

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of each further letter that a subsequence spans.
DECAY = 0.8
#: Letters are told apart by so many codes: a-z, then the code point modulo the rest.
CODES = 48
#: A longer word is taken in windows of this length that overlap by half.
WINDOW = 20
#: Labelled documents of each class that are fetched for training, those with the smallest hashes.
MOST_LABELLED = 4000
LANDMARKS, HARD_LANDMARKS = 64, 48
#: So many of the words that tell the classes apart best are taken as examples, whether or not they are a witness.
TELLING = 64
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_NO_MARKS = str.maketrans("", "", _STRIP)


def terms(text: str | None) -> set[str]:
    """The document's distinct lower-case words without punctuation around them, also without that inside them, and runs of single letters joined."""
    if not text:
        return set()
    words = text.lower().split()
    found = {w.strip(_STRIP) for w in set(words)}
    found |= {w.translate(_NO_MARKS) for w in found if not w.isalnum()}
    run = []
    for w in [*words, "  "]:
        if len(w) == 1:
            run.append(w)
        elif run:
            if len(run) > 2:
                found.add("".join(run))
            run = []
    found.discard("")
    return found


_shapes: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _shape(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All places of three letters in a word of this length, and what each counts."""
    if length not in _shapes:
        at = np.array(list(combinations(range(length), 3)), dtype=np.int64)
        _shapes[length] = at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)
    return _shapes[length]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length (3 or more): codes of their subsequences [words, places] and what each counts, scaled to length 1 in the kernel."""
    length = len(words[0])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), length).astype(np.int64)
    letter = np.where((points >= 97) & (points <= 122), points - 97, 26 + points % (CODES - 26))
    at, weight = _shape(length)
    code = (letter[:, at[:, 0]] * CODES + letter[:, at[:, 1]]) * CODES + letter[:, at[:, 2]]
    order = np.argsort(code, axis=1)
    code = np.take_along_axis(code, order, 1)
    counts = weight[order]
    first = np.c_[np.ones(len(words), dtype=bool), code[:, 1:] != code[:, :-1]]
    flat = np.flatnonzero(first.ravel())
    summed = np.zeros(code.size, dtype=np.float32)
    summed[flat] = np.add.reduceat(counts.ravel(), flat)
    summed = summed.reshape(code.shape)
    return code, summed / np.sqrt((summed**2).sum(axis=1, keepdims=True))


def pieces(word: str) -> list[str]:
    """The word, or its windows if it is long; padded to three letters."""
    if len(word) <= WINDOW:
        return [word.ljust(3, "\0")]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)] + [word[-WINDOW:]]


class Table:
    """What each subsequence counts: a number, or one for each landmark. Only subsequences that count are held, each by its row; row 0 is for all others."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray):
        self.row = np.zeros(CODES**3, dtype=np.int32)
        self.row[codes] = np.arange(1, len(codes) + 1)
        self.values = np.concatenate([np.zeros((1, *rows.shape[1:]), dtype=np.float32), rows.astype(np.float32)])

    def best(self, words: list[str]) -> np.ndarray:
        """Of each word the largest sum of its pieces' subsequences in the table."""
        by_length: dict[int, tuple[list[str], list[int]]] = {}
        for i, w in enumerate(words):
            for p in pieces(w):
                texts, owners = by_length.setdefault(len(p), ([], []))
                texts.append(p)
                owners.append(i)
        wide = self.values[0].size
        out = np.full((len(words), *self.values.shape[1:]), -np.inf, dtype=np.float32)
        for length, (texts, owners) in by_length.items():
            step = max(1, 400_000 // len(_shape(length)[0]) // wide)
            for a in range(0, len(texts), step):
                code, value = subsequences(texts[a : a + step])
                np.maximum.at(out, owners[a : a + step], np.einsum("wp,wp...->w...", value, self.values[self.row[code]]))
        return out


def landmark_table(words: list[str]) -> Table:
    """The table of kernel values with the first piece of each of the words: a column for each."""
    vectors = [vector(w) for w in words]
    codes = np.unique(np.concatenate([c for c, _ in vectors]))
    rows = np.zeros((len(codes), len(words)), dtype=np.float32)
    for j, (code, value) in enumerate(vectors):
        rows[np.searchsorted(codes, code), j] = value
    return Table(codes, rows)


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps; the last column of x is the constant 1."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        on = y * (x @ w) < 1
        xo = x[on] * weight[on, None]
        new = np.linalg.solve(xo.T @ x[on] + ridge * np.eye(x.shape[1]), xo.T @ y[on])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _summary(scores: np.ndarray) -> tuple[float, float, float, float]:
    """Of a document's word scores the two largest (-1.5 where there is none), and how many are above 0.2, as log and as share."""
    if not len(scores):
        return -1.5, -1.5, 0.0, 0.0
    one = scores.max()
    below = scores[scores < one]
    many = int((scores > 0.2).sum())
    return one, below.max() if len(below) else -1.5, np.log1p(many), many / (len(scores) + 10)


class Model:
    """A table of word scores by subsequence, and the map from a document's word scores to a probability."""

    #: Words whose scores a worker remembers.
    MOST = 150_000

    def __init__(self, table: Table, bias: float, scale: np.ndarray):
        self.table, self.bias, self.scale = table, bias, scale
        self.known: dict[str, float] = {}

    def word_scores(self, words: list[str]) -> np.ndarray:
        return self.table.best(words) + self.bias

    def probability(self, summaries: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.clip(summaries, -1.5, 8) @ self.scale[:-1] + self.scale[-1], -30, 30)))

    def score(self, docs: list[set[str]]) -> np.ndarray:
        """The probability of each document, given as its set of words."""
        out = np.empty((len(docs), 4))
        for a in range(0, len(docs), 500):
            part = docs[a : a + 500]
            if len(self.known) > self.MOST:
                self.known = {}
            new = list(set().union(*part).difference(self.known))
            if new:
                self.known.update(zip(new, self.word_scores(new).tolist(), strict=True))
            known = self.known.__getitem__
            for i, d in enumerate(part, a):
                out[i] = _summary(np.fromiter(map(known, d), dtype=float, count=len(d)))
        return self.probability(out)


def _pick(words: list[str], most: int, like: float) -> list[str]:
    """Of words in this order, the first `most` none of which is too like another; the first 4 * most are looked at."""
    words = words[: 4 * most]
    if not words:
        return []
    alike = landmark_table(words).best(words)
    out: list[int] = []
    for i in range(len(words)):
        if len(out) < most and (not out or alike[i, out].max() < like):
            out.append(i)
    return [words[i] for i in out]


def _one_of_each(docs: list[np.ndarray], vocabulary: list[str]) -> list[int]:
    """Indexes of documents without near copies of earlier ones: those that share most of their smallest hashes of long words."""
    hashes = np.array([crc32(w.encode("utf-8", "surrogatepass")) if len(w) > 5 else -1 for w in vocabulary], dtype=np.int64)
    met: dict[int, int] = {}
    out = []
    for i, d in enumerate(docs):
        own = np.sort(hashes[d][hashes[d] >= 0])[:8].tolist()
        like = Counter(met[h] for h in own if h in met).most_common(1)
        if len(own) < 4 or not like or like[0][1] * 2 <= len(own):
            out.append(i)
            met.update(dict.fromkeys(own, i))
    return out


def vector(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the subsequences of the word's first piece, and what each counts."""
    code, value = subsequences(pieces(word)[:1])
    return code[0][value[0] > 0], value[0][value[0] > 0]


def train(vocabulary: list[str], docs: list[np.ndarray], toxic: np.ndarray, share: float, rounds: int = 3) -> Model:
    """Fit on documents as numbers of their distinct words in the vocabulary, which is sorted; share is the toxic documents' share of all labelled ones."""
    if toxic.sum() == 0 or (toxic == 0).sum() == 0:
        return Model(Table(np.zeros(0, dtype=int), np.zeros(0)), 0.0, np.array([0.0, 0.0, 0.0, 0.0, np.log((share + 1e-3) / (1 - share + 1e-3))]))
    apart = _one_of_each(docs, vocabulary)
    docs, toxic = [docs[i] for i in apart], toxic[apart]
    n1, n0 = max(1, toxic.sum()), max(1, (toxic == 0).sum())
    count = lambda y: np.bincount(np.concatenate([d for d, t in zip(docs, toxic, strict=True) if t == y] or [np.zeros(0, dtype=int)]), minlength=len(vocabulary)).astype(float)
    met1, met0 = count(1), count(0)
    size = np.array([len(w) for w in vocabulary])
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.where(met1 > 0, np.log((met1 + 0.5) / n1) - np.log((met0 + 0.5) / n0) + 0.3 * np.log(met1), -np.inf)
        gain = np.where((met1 > 2) & (size > 2), met1 * np.log(met1 * (n1 + n0) / ((met1 + met0) * n1)), 0.0)
    telling = [i for i in np.argsort(-gain, kind="stable")[:TELLING].tolist() if gain[i] > 5]
    clean = np.flatnonzero(met0)
    any_clean = np.random.default_rng(0).permutation(clean)[:3000].tolist()
    named = lambda numbers: [vocabulary[i] for i in numbers]
    scores, model = odds, None
    for turn in range(rounds):
        # the words that tell the classes apart best speak for the label, and so do witnesses that clean documents have seldom
        witness = {*telling, *(int(np.sort(d)[scores[np.sort(d)].argmax()]) for d, t in zip(docs, toxic, strict=True) if t and len(d))}
        good = [i for i in sorted(witness, key=lambda i: (-met1[i], i)) if met0[i] / n0 < 0.2 * met1[i] / n1]
        hard = [i for i in clean[np.argsort(-scores[clean], kind="stable")[:2000]].tolist() if turn and met0[i] / n0 > 0.5 * met1[i] / n1]
        if not good:
            good = [int(odds.argmax())]
        landmarks = _pick(named(good), LANDMARKS, 0.9) + _pick(named(hard + any_clean), HARD_LANDMARKS, 0.7)
        base = landmark_table(landmarks)
        held = base.values[1:].astype(np.float64)
        values, axes = np.linalg.eigh(held.T @ held)
        root = axes @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ axes.T
        words = good + hard + any_clean
        x = np.c_[base.best(named(words)) @ root, np.ones(len(words))]
        y = np.r_[np.ones(len(good)), -np.ones(len(hard) + len(any_clean))]
        weight = np.r_[np.sqrt(np.minimum(met1[good], 50)) * max(1.0, len(any_clean) / len(good) / 10), np.ones(len(hard) + len(any_clean))]
        w = _machine(x, y, weight)
        table = Table(np.flatnonzero(base.row), (held @ (root @ w[:-1]))[base.row[base.row > 0] - 1])
        model = Model(table, float(w[-1]), np.array([1.0, 0.0, 0.0, 0.0, 0.0]))
        scores = np.concatenate([model.word_scores(vocabulary[a : a + 20_000]) for a in range(0, len(vocabulary), 20_000)])
    weight = np.where(toxic == 1, share / n1, (1 - share) / n0) * len(toxic)
    model.scale = _logistic(np.clip([_summary(scores[d]) for d in docs], -1.5, 8), toxic.astype(float), weight)
    return model


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learned from: crc32 of doc_id as text leaves 2 by 4. A null doc_id isn't one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Train in one task on at most `most` labelled documents of each class outside held_out(), as their distinct words; the driver gets the model alone."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = None
    for t in (0, 1):
        part = usable.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        sample = part if sample is None else sample.union(part)

    @F.udf("string", useArrow=True)
    def words(text: str) -> str:
        return "\n".join(sorted(terms(text)))

    # at most 2 * most rows, so this side is small at any input size; of rows with one doc_id one stays
    rows = docs.select(F.col("doc_id"), "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "_of")), F.col("doc_id") == F.col("_of"))
    rows = rows.select("_of", "toxic", words("text").alias("words")).groupBy("_of", "toxic").agg(F.min("words").alias("words"))
    share = total.get(1, 0) / max(1, sum(total.values()))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = learned(batches, share)
        table = model.table
        yield pd.DataFrame({"codes": [np.flatnonzero(table.row)], "counts": [table.values[1:]], "bias": [model.bias], "scale": [model.scale]})

    # the sample is bounded, so one task holds it at any input size; only the model reaches the driver
    made = rows.coalesce(1).mapInPandas(learn, "codes array<long>, counts array<float>, bias double, scale array<double>").collect()
    if not made:  # no partition to read
        return learned(iter(()), share)
    codes, counts, bias, scale = made[0]
    return Model(Table(np.array(codes, dtype=int), np.array(counts, dtype=np.float32)), bias, np.array(scale))


def learned(batches: Iterator[pd.DataFrame], share: float) -> Model:
    """Train on rows (_of, toxic, words: distinct words, one a line), whatever their order."""
    number: dict[str, int] = {}
    found = []
    for batch in batches:
        for of, toxic, words in zip(batch["_of"].tolist(), batch["toxic"].tolist(), batch["words"], strict=True):
            own = words.split("\n") if words else []
            found.append((of, toxic, np.array([number.setdefault(w, len(number)) for w in own], dtype=np.int32)))
    found.sort(key=lambda r: r[0])
    vocabulary = sorted(number)
    place = np.empty(len(number), dtype=np.int32)
    place[[number[w] for w in vocabulary]] = np.arange(len(number))
    del number
    for _, _, own in found:
        np.take(place, own.copy(), out=own)  # in place: each document's numbers are held once
    return train(vocabulary, [r[2] for r in found], np.array([r[1] for r in found], dtype=int), share)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column `name`, 0 to 1: how likely the whole text is toxic. Null and empty texts get the score of a text without words.

    Rows are scored one by one on their text alone, so equal texts score alike. Every column of docs stays but one of that
    name, which the score replaces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([shared.value.score([terms(t) for t in texts.iloc[a : a + 500]]) for a in range(0, len(texts), 500)] or [np.zeros(0)]))

    return docs.withColumn(name, run(F.col("text").cast("string")))
