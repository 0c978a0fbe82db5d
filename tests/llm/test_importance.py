import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ragloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return [crc32(" ".join(words[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(words) - k + 1)], len(words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8), st.integers(1, 3))
def test_crcs_of_features(texts, n):
    parts = [t.encode().lower() for t in texts]
    crc, at, words = importance.features(parts, n)
    for i, t in enumerate(texts):
        want, n_words = plain_features(t, n)
        assert sorted(crc[at[i] : at[i + 1]].tolist()) == sorted(want) and words[i] == n_words


def test_long_and_repeated_features():
    text = ("x" * 300 + " " + "y" * 256 + " ") * 3 + "z" * 1_000_000
    crc, at, _ = importance.features([text.encode(), b"", text.encode()], 1)
    assert crc.tolist() == 2 * plain_features(text, 1)[0] and at.tolist() == [0, 7, 7, 14]


def test_rows_with_one_key_are_told_apart(monkeypatch):
    monkeypatch.setattr(importance, "mix", lambda x: np.zeros_like(x))
    words = [b"abcdefgh12345678", b"ABCDEFGH12345678", b"abcdefgh12345678"]
    first, which = importance.distinct_rows(np.array([list(w) for w in words], dtype=np.uint8))
    assert len(first) == 2 and which[0] == which[2] != which[1]


def brute(rows, target, n=1, buckets=10_000, percent=10, least=20):
    own, other = Counter(), Counter()
    for _, text in rows:
        own.update(f % buckets for f in plain_features(text, n)[0])
    for text in target:
        other.update(f % buckets for f in plain_features(text, n)[0])
    s, t = sum(own.values()), sum(other.values())
    gain = {b: math.floor(1000 * math.log((other[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in own}
    out = []
    for doc_id, text in rows:
        found, words = plain_features(text, n)
        weight = sum(gain[f % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    for i, r in enumerate(order[: percent * len(order) // 100], 1):
        drawn[(*r[:4], i)] += 1
        out.remove(r)
    return drawn + Counter((*r[:4], None) for r in out)


@pytest.mark.parametrize("n", [1, 2])
def test_scores_against_plain_code(spark, docs, rows, n):
    target = [rows[3][1], rows[9][1], None, ""]
    goal = spark.createDataFrame([(t, 1.0) for t in target], "text string, score double")
    got = importance.scores(docs, goal, n=n, percent=40)
    assert got.columns == ["doc_id", "body", "n_words", "n_features", "weight", "score", "rank"]
    want = brute([(r[0], r[1]) for r in rows], target, n, percent=40)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == want
    assert {r[4] for r in want if r[4]} == set(range(1, sum(r[4] is not None for r in want) + 1))


def test_target_like_documents_are_drawn(spark):
    rows = [(i, " ".join(f"{'math' if i % 10 == 0 else 'chat'}{(i * k) % 37}" for k in range(40))) for i in range(400)]
    goal = spark.createDataFrame([(" ".join(f"math{k}" for k in range(37)),)], "text string")
    drawn = importance.resample(spark.createDataFrame(rows, "doc_id long, text string"), goal).collect()
    assert len(drawn) == 40 and sum(r.doc_id % 10 == 0 for r in drawn) >= 16  # 4 by chance


def test_resample_returns_rows_as_they_are(spark, docs, rows):
    clash = docs.withColumnRenamed("lang", "_id").withColumnRenamed("size", "_drawn_rank").withColumnRenamed("label", "rank_")
    goal = spark.createDataFrame([("alpha beta",)], "text string")
    got = importance.resample(clash, goal, percent=100, least_words=0).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))
    assert Counter(tuple(r)[:-1] for r in got) == Counter(tuple(r) for r in clash.collect())


def test_empty_tables(spark, docs, empty):
    goal = spark.createDataFrame([], "text string")
    assert importance.scores(empty, goal).count() == 0
    assert importance.scores(docs, goal).count() == docs.count()
    assert importance.resample(empty, docs).count() == 0
