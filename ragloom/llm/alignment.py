"""Alignment of two tokenizers' tokens over the same bytes, by skipping along the diagonal.

Both tokenizers give the byte offsets at which their tokens end. Where token i of one and token i + shift of the other
end together, the next ones mostly do too: runs of such pairs are found by comparing slices of the two arrays that double in
length and are jumped at once. Between runs a group of several tokens is walked through up to the next common end, and
the shift is what its two sizes leave.

How often two ids are linked is counted over the whole corpus. The counts of the most frequent pairs, a table of fixed
size, go to all tasks; links of rarer pairs are joined with theirs in a shuffle.
"""

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.packing import Encoder, byte_level, default_tokenizer, gather, worker_encoder
from ragloom.llm.store import materialise
from ragloom.llm.wordhash import chunks, encode

#: Pairs of ids whose counts go to all tasks: results don't depend on it.
FREQUENT = 1 << 17
#: Links that a task counts at a time, and bytes of text that it aligns at a time.
HELD, BYTES = 2_000_000, 1 << 19
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups string, links binary"


class SpacedEncoder(Encoder):
    """Ids of a blank and the text."""

    PREFIX = " "

    def load(self, path: str) -> None:
        super().load(path)
        byte = byte_level()
        with open(path, encoding="utf-8") as f:
            special = {t["id"] for t in json.load(f).get("added_tokens") or ()}
        spelt = [b""] * (1 + max(self.tokenizer.get_vocab().values()))
        for piece, i in self.tokenizer.get_vocab().items():
            spelt[i] = encode(piece) if i in special else bytes(map(byte.__getitem__, piece))
        self.spelt, self.spelt_ends = _table(spelt)


class PieceEncoder(Encoder):
    """Ids of a text by a sentencepiece model that sets a blank before it. Where no piece has a blank after its first character or holds a
    line break, the ids of a text are those of its words in turn, and words are remembered."""

    PREFIX = " "

    def load(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=path)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        single = [self.pieces.is_byte(i) for i in range(len(names))]
        self.spelt, self.spelt_ends = _table([bytes([int(p[3:5], 16)]) if b else encode(p.replace("▁", " ")) for p, b in zip(names, single, strict=True)])
        first, last = self.pieces.encode("\n"), next((i for i, p in enumerate(names) if single[i] and int(p[3:5], 16) == 10), -1)
        plain = not any("\n" in p or "▁" in p.lstrip("▁") for p in names)
        self.by_word, self.line_break = plain and len(first) == 2 and first[1] == last, last

    def _texts(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, dtype=np.uint32) for ids in self.pieces.encode(texts, num_threads=1)] if texts else []

    def _plain(self, parts: list[bytes]) -> list[np.ndarray | None]:
        return super()._plain(parts) if self.by_word else [None] * len(parts)

    def _words(self, words: list[str]) -> list[np.ndarray]:
        out = [np.array([self.line_break], dtype=np.uint32)] * len(words)
        rest = [i for i, w in enumerate(words) if w != "\n"]
        for a in range(0, len(rest), self.LINES):
            part = rest[a : a + self.LINES]
            ids = np.array(self.pieces.encode("\n".join(["", *(words[i] for i in part), ""])), dtype=np.uint32)
            at = np.flatnonzero(ids == self.line_break)
            for i, x, y in zip(part, at[:-1].tolist(), at[1:].tolist(), strict=True):
                out[i] = ids[x + 1 : y]
        return out


def _table(spelt: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(spelt), dtype=np.uint8), np.cumsum([0, *map(len, spelt)])


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side end with each group; the ends ascend and the last ones are equal."""
    a, b = ends_a.tolist(), ends_b.tolist()
    n, i, j = len(a), 0, 0
    at_a, at_b, many = [], [], []  # stretches: tokens of either side up to its first group's end, and its groups
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            # one to one: slices of twice the length each time, then of halves back to the last common end
            run, whole = 1, False
            while not whole:
                ahead = a[i + run : i + run + run]
                if ahead != b[j + run : j + run + run]:
                    break
                whole = len(ahead) < run
                run += len(ahead)
            step = 0 if whole else run >> 1
            while step:
                if a[i + run : i + run + step] == b[j + run : j + run + step]:
                    run += step
                step >>= 1
            at_a.append(i + 1)
            at_b.append(j + 1)
            many.append(run)
            i, j = i + run, j + run
        else:
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i, j = i + 1, j + 1
            at_a.append(i)
            at_b.append(j)
            many.append(1)
    size = np.array(many, dtype=np.int64)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(np.array(at_a, dtype=np.int64), size) + within, np.repeat(np.array(at_b, dtype=np.int64), size) + within


_DIGITS, _DIGIT_ENDS = _table([])


def written(ids: np.ndarray, marks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of numbers, each followed by its mark, and where the bytes of each range of numbers (its ends, from 0) end."""
    global _DIGITS, _DIGIT_ENDS
    if len(ids) and int(ids.max()) >= len(_DIGIT_ENDS) - 1:
        _DIGITS, _DIGIT_ENDS = _table([b"%d " % i for i in range(int(ids.max()) + 1)])
    _, out, at = gather(_DIGITS, _DIGIT_ENDS, ids)
    out[at[1:] - 1] = marks
    return out, at[ends]


def _spelt_as(encoder: Encoder, ids: list[np.ndarray], raw: list[bytes]) -> list[bool]:
    """Whether the tokens' bytes joined are each text's."""
    all_ids = np.concatenate(ids)
    _, spelt, at = gather(encoder.spelt, encoder.spelt_ends, all_ids)
    cut = at[np.cumsum([0, *map(len, ids)])]
    if np.array_equal(np.diff(cut), [len(r) for r in raw]) and np.array_equal(spelt, np.frombuffer(b"".join(raw), dtype=np.uint8)):
        return [True] * len(raw)
    return [spelt[x:y].tobytes() == r for x, y, r in zip(cut[:-1], cut[1:], raw, strict=True)]


def align_texts(texts: list[str | None], a: Encoder, b: Encoder) -> Iterator[tuple[int, int, int, str, bytes]]:
    """For each text: its tokens by a and by b, its groups, these written out, and its links as numbers (id of a * ids of b + id of b)."""
    raw = [b" " + encode(t) for t in texts]
    ids_a, ids_b = a([t or "" for t in texts]), b([t or "" for t in texts])
    right = [bool(t) and x and y for t, x, y in zip(texts, _spelt_as(a, ids_a, raw), _spelt_as(b, ids_b, raw), strict=True)]
    if not any(right):
        yield from [(0, 0, 0, "", b"")] * len(texts)
        return
    own_a, own_b = ([i for i, r in zip(ids, right, strict=True) if r] for ids in (ids_a, ids_b))
    all_a, all_b = np.concatenate(own_a), np.concatenate(own_b)
    ends = lambda e, ids: np.cumsum(e.spelt_ends[ids + 1] - e.spelt_ends[ids])
    # texts end together on both sides, so that all can be aligned as one
    at_a, at_b = group_ends(ends(a, all_a.astype(np.int64)), ends(b, all_b.astype(np.int64)))
    text_a = np.cumsum([0, *map(len, own_a)])
    text_b = np.cumsum([0, *map(len, own_b)])
    text_group = np.r_[0, np.searchsorted(at_a, text_a[1:]) + 1]
    # written in turn: a group's ids of a, a bar, its ids of b, a semicolon
    ids = np.empty(len(all_a) + len(all_b), dtype=np.int64)
    marks = np.full(len(ids), ord(","), dtype=np.uint8)
    size_a, size_b = np.diff(at_a, prepend=0), np.diff(at_b, prepend=0)
    ids[np.arange(len(all_a)) + np.repeat(at_b - size_b, size_a)] = all_a
    ids[np.arange(len(all_b)) + np.repeat(at_a, size_b)] = all_b
    marks[at_a + at_b - size_b - 1] = ord("|")
    marks[at_a + at_b - 1] = ord(";")
    spelt, cut = written(ids, marks, text_a + text_b)
    code = all_a[at_a - 1].astype(np.int64) * (len(b.spelt_ends) - 1) + all_b[at_b - 1]
    small = code.astype("<u4") if _narrow(a, b) else code.astype("<i8")
    at = 0
    for r in right:
        if r:
            x, y = text_group[at : at + 2]
            yield len(own_a[at]), len(own_b[at]), int(y - x), spelt[cut[at] : cut[at + 1] - 1].tobytes().decode(), small[x:y].tobytes()
            at += 1
        else:
            yield 0, 0, 0, "", b""


def _narrow(a: Encoder, b: Encoder) -> bool:
    return (len(a.spelt_ends) - 1) * (len(b.spelt_ends) - 1) <= 1 << 32


def aligned(docs: DataFrame, tokenizer_path: str | None = None, pieces_path: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, n_a, n_b (tokens by either), n_groups, groups (`a1,a2|b1;a3|b2,b3`: ids in order) and links, for count_links.

    Tokenizer a (a byte-level file of `tokenizers`) reads a blank and the text, b (a sentencepiece model) the text, before which it
    sets a blank itself; special tokens' strings are plain text. Common ends of tokens cut the text's bytes into
    groups. Null and empty texts, and texts that the tokens of either don't spell byte for byte, have no tokens and no groups. Rows with
    equal or null doc_id are documents of their own; other columns are ignored; an empty table gives an empty result.
    """
    path_a, path_b = tokenizer_path or default_tokenizer(), pieces_path or default_pieces()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        a, b = worker_encoder(path_a, SpacedEncoder), worker_encoder(path_b, PieceEncoder)
        for batch in batches:
            for x, y in chunks([encode(t) for t in batch["text"]], BYTES):
                part = batch.iloc[x:y]
                out = pd.DataFrame(list(align_texts(part["text"].tolist(), a, b)), columns=["n_a", "n_b", "n_groups", "groups", "links"])
                yield out.assign(doc_id=part["doc_id"].to_numpy())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, _ALIGNED)


def pair_counts(rows: DataFrame, ids_b: int, narrow: bool) -> DataFrame:
    """code (id of a * ids_b + id of b) and n, how many links of all rows have it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, counts, new, waiting = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            fresh, times = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *new]), return_counts=True)
            both, which = np.unique(np.r_[codes, fresh], return_inverse=True)
            sums = np.zeros(len(both), dtype=np.int64)
            np.add.at(sums, which, np.r_[counts, times])
            return both, sums

        for batch in batches:
            for links in batch["links"]:
                new.append(_codes(links, narrow))
                waiting += len(new[-1])
                if waiting >= HELD:
                    (codes, counts), new, waiting = merged(), [], 0
                    if len(codes) > HELD:
                        yield pd.DataFrame({"code": codes, "n": counts})
                        codes, counts = codes[:0], counts[:0]
        codes, counts = merged()
        yield pd.DataFrame({"code": codes, "n": counts})

    found = rows.select("links").mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return found.withColumn("b", F.pmod("code", F.lit(ids_b)))


def _codes(links: bytes, narrow: bool) -> np.ndarray:
    return np.frombuffer(links, dtype="<u4" if narrow else "<i8").astype(np.int64)


def count_links(rows: DataFrame, tokenizer_path: str | None = None, pieces_path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """rows (as of aligned(), other columns stay) without links, with n_links, n_best (links whose count is the highest of their id of b) and count_sum.

    A link is a pair of tokens that end together; its count is how many links of all rows pair the same two ids.
    """
    a, b = SpacedEncoder(tokenizer_path or default_tokenizer()), PieceEncoder(pieces_path or default_pieces())
    ids_b, narrow = len(b.spelt_ends) - 1, _narrow(a, b)
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    pairs = materialise(pair_counts(rows, ids_b, narrow), "pairs")
    best = pairs.groupBy("b").agg(F.max("n").alias("best"))  # no more rows than b has ids
    pairs = pairs.join(F.broadcast(best), "b").select("code", "n", (F.col("n") == F.col("best")).alias("is_best"))
    known = pairs.orderBy(F.desc("n"), "code").limit(frequent).toPandas().sort_values("code")
    codes, counts, is_best = known["code"].to_numpy(dtype=np.int64), known["n"].to_numpy(dtype=np.int64), known["is_best"].to_numpy(dtype=bool)
    sent = rows.sparkSession.sparkContext.broadcast((codes, counts, is_best))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, counts, is_best = sent.value
        for batch in batches:
            out = []
            for links in batch["links"]:
                own = _codes(links, narrow)
                at = np.searchsorted(codes, own)
                known = np.append(codes, -1)[at] == own
                rare, times = np.unique(own[~known], return_counts=True)
                out.append((len(own), int(is_best[at[known]].sum()), int(counts[at[known]].sum()), [{"code": c, "times": t} for c, t in zip(rare.tolist(), times.tolist(), strict=True)]))
            yield pd.DataFrame(out, columns=["n_links", "n_best", "count_sum", "rare"]).assign(_row=batch["_row"].to_numpy())

    part = materialise(rows.select("_row", "links").mapInPandas(run, "_row long, n_links long, n_best long, count_sum long, rare array<struct<code:long,times:long>>"), "links")
    rare = part.select("_row", F.explode("rare").alias("rare")).select("_row", "rare.code", "rare.times")
    more = rare.join(pairs, "code").groupBy("_row").agg(F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    total = part.drop("rare").join(more, "_row", "left")
    total = total.select("_row", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))
    return rows.drop("links").join(total, "_row").drop("_row")
