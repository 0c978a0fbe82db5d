import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ragloom.llm import alignment
from ragloom.llm.alignment import PieceEncoder, SpacedEncoder

ODD = ["<|endoftext|> <s> </s> [INST]", " leading blank", "two  blanks", "tab\tand odd　blanks", "line\nbreaks\n\nand\n", "\n", " ", "▁ a lower bar▁x", "<0x41> <unk>", "ﬁ Å é naïve 東京 🎉🎉", "x" * 5000, "don't we'll I'm", "a\n b", "ok " * 300, "\x00\x01 zero"]


@pytest.fixture(scope="module")
def encoders():
    return SpacedEncoder(alignment.default_tokenizer()), PieceEncoder(alignment.default_pieces())


@pytest.fixture(scope="module")
def plain():
    """Token ids and their bytes by the two libraries, text by text."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path = alignment.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            byte[chr(256 + len(byte) - len(shown))] = b
    with open(path) as f:
        vocab = {i: bytes(byte[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items() if all(c in byte for c in t)}
    pieces = SentencePieceProcessor(model_file=alignment.default_pieces())

    def tokens(text):
        if not text:
            return None
        a = [(i, vocab[i]) for i in tokenizer.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i in pieces.encode(text) for p in [pieces.id_to_piece(i)]]
        return (a, b) if all(b"".join(x for _, x in side) == (" " + text).encode() for side in (a, b)) else None

    return tokens


def plain_groups(tokens):
    """Groups (ids of a, ids of b) by walking both sides a byte end at a time."""
    if tokens is None:
        return []
    ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in tokens]
    both, out, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for end in both:
        x, y = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
        out.append(([t for t, _ in tokens[0][i:x]], [t for t, _ in tokens[1][j:y]]))
        i, j = x, y
    return out


def brute(texts, plain):
    groups = [plain_groups(plain(t)) for t in texts]
    counts = Counter((g[0][-1], g[1][-1]) for own in groups for g in own)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for own in groups:
        links = [(g[0][-1], g[1][-1]) for g in own]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in own)
        sha = hashlib.sha256(said.encode()).hexdigest() if own else ""
        out.append((sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.booleans(), min_size=60, max_size=60), st.lists(st.booleans(), min_size=60, max_size=60))
def test_group_ends(steps, in_a, in_b):
    ends = np.cumsum(steps)
    a = np.array([e for e, x in zip(ends[:-1], in_a) if x] + [ends[-1]])
    b = np.array([e for e, x in zip(ends[:-1], in_b) if x] + [ends[-1]])
    at_a, at_b = alignment.group_ends(a, b)
    both = np.intersect1d(a, b)
    assert a[at_a - 1].tolist() == both.tolist() == b[at_b - 1].tolist()


def test_no_tokens():
    assert [x.tolist() for x in alignment.group_ends(np.zeros(0, dtype=int), np.zeros(0, dtype=int))] == [[], []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab \n▁é<0x>", max_size=30), st.sampled_from(ODD)), max_size=6))
def test_texts_against_libraries(encoders, plain, texts):
    got = list(alignment.align_texts([*texts, None], *encoders))
    for text, (n_a, n_b, n_groups, groups, links) in zip([*texts, None], got, strict=True):
        want = plain_groups(plain(text))
        assert groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
        assert (n_a, n_b, n_groups) == (sum(len(a) for a, _ in want), sum(len(b) for _, b in want), len(want)) and len(links) == 4 * n_groups


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40, 0])
def test_counts_against_brute_force(spark, docs, rows, plain, frequent, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 500)
    more = [(1000 + i, t) for i, t in enumerate(ODD)]
    frame = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = alignment.count_links(alignment.aligned(frame.withColumn("groups", frame["lang"])), frequent=frequent).collect()
    texts = [(r[0], r[1]) for r in rows] + more
    sha = lambda r: hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else ""
    want = Counter((i, *x) for (i, _), x in zip(texts, brute([t for _, t in texts], plain), strict=True))
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, sha(r)) for r in got) == want


def test_empty(spark, empty):
    assert alignment.count_links(alignment.aligned(empty)).count() == 0
