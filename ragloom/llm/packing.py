"""Packing documents into training sequences by order-preserving dynamic programming.

A task's documents are one stream of token ids, in their order. A sequence is a window of the stream of at most `size`
ids. Windows may be cut at document ends, at sentence ends and, at a price, anywhere; the cuts that minimise
padding plus the prices of truncation come from

    best[j] = price[j] + size - j + min(best[i] + i for the cuts i with j - size <= i < j)

whose minimum over a moving window a monotone queue yields in constant time. Nothing is shuffled: each task packs
what it reads, a bounded block of ids at a time, and hands the last, unfilled window on to its next block.
"""

import json
import sys
from collections import deque
from collections.abc import Iterator
from itertools import pairwise
from types import ModuleType
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.wordhash import chunks, span_hashes

SIZE = 2048
#: Prices of a cut, in padded ids: within a document after a sentence, and anywhere else. Document ends are free.
SENTENCE_PRICE, ANYWHERE_PRICE = 4, 12
#: Cuts inside a sentence are considered at every so many ids.
GRID = 32
#: Ids that are planned at once.
BLOCK = 1 << 19
#: Fixed: how the byte-level tokenizer splits a text before it merges.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The id that ends every document.
END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(at: np.ndarray, price: np.ndarray, size: int) -> list[int]:
    """Which of the possible cuts `at` (ascending, the first is the beginning, the last the end of the stream) to make.

    Neighbouring cuts are at most `size` apart. Returns indexes into `at`, both ends included.
    """
    at_, price_ = at.tolist(), price.tolist()
    best, came = [0.0] * len(at_), [0] * len(at_)
    queue: deque[int] = deque([0])  # cuts with growing best[i] + i
    key = [0.0] * len(at_)
    for j in range(1, len(at_)):
        a = at_[j]
        while a - at_[queue[0]] > size:
            queue.popleft()
        i = queue[0]
        best[j] = price_[j] + size - a + key[i]
        came[j] = i
        key[j] = best[j] + a
        while queue and key[queue[-1]] >= key[j]:
            queue.pop()
        queue.append(j)
    out, j = [len(at_) - 1], len(at_) - 1
    while j:
        j = came[j]
        out.append(j)
    return out[::-1]


def possible_cuts(ids: np.ndarray, ends: np.ndarray, after: np.ndarray, size: int, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a stream and their prices: document ends, sentence ends, and a grid between them.

    after: whether a cut after this id ends a sentence, by id.
    """
    price = np.full(len(ids) + 1, -1, dtype=np.int64)
    price[:: min(grid, size)] = ANYWHERE_PRICE
    price[1:][after[ids]] = SENTENCE_PRICE
    price[ends] = 0
    price[0] = price[-1] = 0
    at = np.flatnonzero(price >= 0)
    return at, price[at]


def sentence_ends(tokenizer) -> np.ndarray:
    """For each id whether its piece ends in a full stop, a question or exclamation mark, or a line break."""
    out = np.zeros(tokenizer.get_vocab_size() + 2, dtype=bool)
    for piece, i in tokenizer.get_vocab().items():
        out[i] = piece.rstrip("\"'").endswith((".", "!", "?", "\u010a"))
    return out


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: bytes without a visible character are the code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


def by_ranks(path: str):
    """A faster encoder with the same ids as the tokenizer in the file, where its merges of bytes are in the order of their ids; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, split = told["model"], told.get("pre_tokenizer") or {}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    plain = model.get("type") == "BPE" and not told.get("normalizer") and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    byte = byte_level()
    ranks = {bytes(map(byte.__getitem__, token)): i for token, i in model["vocab"].items() if i < 256 + len(merges)}
    return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts by the tokenizer. The tokenizer splits before every single blank and around every single line break
    first of all, so the ids of a text are those of its words in turn, and words that were met before need no second look.
    New words are encoded many at a time, as lines of one text, by the same merges. Texts with other white space are
    encoded as they are."""

    #: What stands before every text.
    PREFIX = ""
    #: Words remembered; those met first stay, as frequent ones are among them.
    MOST = 400_000
    #: New words that are encoded at a time, characters beyond which a word is encoded on its own, and bytes of text that are looked at together.
    LINES, LONG, BYTES = 4096, 200, 1 << 19

    def __init__(self, path: str):
        self.load(path)
        # the words known: their hashes in order, each word's number, and by number where its bytes and ids end in one array of all
        self.hashes, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.byte_ends, self.id_ends = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.bytes, self.ids = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.uint32)

    def load(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.after = sentence_ends(self.tokenizer)
        self.ranks = by_ranks(path)
        (self.line_break,) = self._whole(["\n"])

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        out: list = [None] * len(words)
        alone = [i for i, w in enumerate(words) if len(w) > self.LONG or "\n" in w] if self.ranks and len(self.line_break) == 1 else range(len(words))
        for i, ids in zip(alone, self._whole([words[i] for i in alone]), strict=True):
            out[i] = ids
        lines = [i for i, ids in enumerate(out) if ids is None]
        for a in range(0, len(lines), self.LINES):
            part = lines[a : a + self.LINES]
            ids = self.ranks.encode_to_numpy("\n".join(["", *(words[i] for i in part), ""]), disallowed_special=())
            for i, (x, y) in zip(part, pairwise(np.flatnonzero(ids == self.line_break).tolist()), strict=True):
                out[i] = ids[x + 1 : y]
        return out

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        # plain: as many gaps as blanks and line breaks, so each stands alone between words and there is no other white space
        raw = [(self.PREFIX + t).encode("utf-8", "surrogatepass") if t and len(t.split()) == t.count(" ") + t.count("\n") + 1 else b"" for t in texts]
        plain = [i for i, r in enumerate(raw) if 0 < len(r) <= self.BYTES]
        out: list = [None] * len(texts)
        for a, b in chunks([raw[i] for i in plain], self.BYTES):
            for i, ids in zip(plain[a:b], self._plain([raw[i] for i in plain[a:b]]), strict=True):
                out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._texts([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _texts(self, texts: list[str]) -> list[np.ndarray]:
        return self._whole([self.PREFIX + t for t in texts])

    def _plain(self, parts: list[bytes]) -> list[np.ndarray | None]:
        """Ids of plain texts; None for one with a word whose hash another word has."""
        buf = np.frombuffer(b"".join(parts), dtype=np.uint8)
        text_at = np.cumsum([0, *map(len, parts)])
        begins = (buf == 32) | (buf == 10)
        begins[1:] |= buf[:-1] == 10
        begins[text_at[:-1]] = True
        start = np.flatnonzero(begins)  # a word keeps the blank before it
        end = np.r_[start[1:], len(buf)]
        uniq, first, which = np.unique(span_hashes(buf, start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, uniq)
        new = np.r_[self.hashes, uniq[:1]][place] != uniq if len(self.hashes) else np.ones(len(uniq), dtype=bool)
        before = dict(self.__dict__)
        if new.any():
            words = [buf[x:y] for x, y in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            ids = self._words([w.tobytes().decode("utf-8", "surrogatepass") for w in words])
            self.number = np.insert(self.number, place[new], np.arange(len(words)) + len(self.number))
            self.hashes = np.insert(self.hashes, place[new], uniq[new])
            self.byte_ends = np.concatenate([self.byte_ends, self.byte_ends[-1] + np.cumsum([len(w) for w in words])])
            self.id_ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum([len(i) for i in ids])])
            self.bytes, self.ids = np.concatenate([self.bytes, *words]), np.concatenate([self.ids, *ids])
            place = np.searchsorted(self.hashes, uniq)
        word = self.number[place][which]
        _, ids, ends = gather(self.ids, self.id_ends, word)
        size, held, _ = gather(self.bytes, self.byte_ends, word)
        cut = ends[np.searchsorted(start, text_at)]
        found = [ids[x:y] for x, y in pairwise(cut.tolist())]
        if not (np.array_equal(size, end - start) and np.array_equal(held, buf)):
            right = [bytes(self.bytes[self.byte_ends[w] : self.byte_ends[w + 1]]) == bytes(buf[x:y]) for w, x, y in zip(word, start, end, strict=True)]
            wrong = np.unique(np.searchsorted(text_at, start[~np.array(right)], side="right") - 1)
            found = [None if i in wrong else f for i, f in enumerate(found)]
        if len(self.hashes) > self.MOST:
            self.__dict__.update(before)
        return found


def gather(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of values named by `which`: their lengths, the values in turn, and where each run begins among them (one more at the end)."""
    size = ends[which + 1] - ends[which]
    at = np.r_[0, np.cumsum(size)]
    return size, values[np.repeat(ends[which] - at[:-1], size) + np.arange(at[-1])], at


def worker_encoder(path: str, kind: type[Encoder] = Encoder) -> Encoder:
    """This Python worker's encoder: tasks that run in it after each other share the words it knows."""
    kept = sys.modules.setdefault("_ragloom_encoders", ModuleType("_ragloom_encoders")).__dict__
    key = f"{kind.__name__} {path}"
    if key not in kept:
        kept[key] = kind(path)
    return kept[key]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = SIZE, end_id: int = END_ID, grid: int = GRID) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's (special tokens' strings are ordinary text) and end_id; a null or empty text is the
    end_id alone. Cuts inside sentences are tried at every grid-th id. start counts the document's ids before the piece, offset the sequence's. sequence_id is unique in
    the result and grows with the order of rows within a task. Order is that in which rows are read. The last window of
    a task is split at powers of two, which need no padding. Rows with equal or null doc_id
    are documents of their own. Other columns are ignored; an empty table gives an empty result.
    """
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = worker_encoder(path)
        number = TaskContext.get().partitionId() << 33
        names: list = []  # doc_id, ids in all, ids already packed, of each document in the stream
        held: list[np.ndarray] = []

        def flush(last: bool) -> pd.DataFrame:
            nonlocal number, names, held
            ids = np.concatenate(held)
            lengths = np.array([len(x) for x in held])
            ends = np.cumsum(lengths)
            at, price = possible_cuts(ids, ends, encoder.after, size, grid)
            chosen = at[best_cuts(at, price, size)]
            if last:
                chosen = np.r_[chosen[:-1], chosen[-2] + _tail(int(chosen[-1] - chosen[-2]))] if chosen[-1] - chosen[-2] < size else chosen
            elif len(chosen) > 2:
                chosen = chosen[:-1]
            cuts = np.unique(np.r_[chosen, ends[ends < chosen[-1]]])
            window = np.searchsorted(chosen, cuts[:-1], side="right") - 1
            doc = np.searchsorted(ends, cuts[:-1], side="right")
            begin = ends - lengths
            rows = []
            for a, b, w, d in zip(cuts[:-1].tolist(), cuts[1:].tolist(), window.tolist(), doc.tolist(), strict=True):
                doc_id, total, done = names[d]
                rows.append((doc_id, done + a - int(begin[d]), b - a, crc32(ids[a:b].astype("<u4").tobytes()), total, number + w, a - int(chosen[w])))
            number += len(chosen) - 1
            d = int(np.searchsorted(ends, chosen[-1], side="right"))
            if d < len(held):
                gone = int(chosen[-1] - begin[d])
                names = [(names[d][0], names[d][1], names[d][2] + gone), *names[d + 1 :]]
                held = [held[d][gone:], *held[d + 1 :]]
            else:
                names, held = [], []
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            return out.astype({"doc_id": "Int64"})

        waiting = 0
        for batch in batches:
            for a in range(0, len(batch), 200):
                part = batch.iloc[a : a + 200]
                for doc_id, ids in zip(part["doc_id"], encoder(["" if t is None else t for t in part["text"]]), strict=True):
                    ids = np.append(ids, np.uint32(end_id))
                    names.append((None if pd.isna(doc_id) else int(doc_id), len(ids), 0))
                    held.append(ids)
                    waiting += len(ids)
                if waiting >= BLOCK:
                    yield flush(False)
                    waiting = sum(map(len, held))
        if held:
            yield flush(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, PIECE)


def _tail(length: int) -> np.ndarray:
    """Cuts of a task's last window: at the powers of two that make it up, largest first, so that none of its sequences is padded."""
    return np.cumsum([1 << bit for bit in range(length.bit_length() - 1, -1, -1) if length >> bit & 1])
