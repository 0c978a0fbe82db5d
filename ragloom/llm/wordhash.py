"""Vectorised word hashing of whole texts: numpy over one byte buffer for many documents at once.

Words are maximal runs outside space and \\x09-\\x0D. Hashes are 64-bit, the same in every process.
"""

import numpy as np

_U = np.uint64
#: Odd multiplier of the rolling polynomial and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes, white space flags and powers of the multiplier up to n."""
    if _tables.get("n", 0) < n:
        size = max(n, 3 << 18)
        white = np.zeros(256, dtype=bool)
        white[[32, 9, 10, 11, 12, 13]] = True
        _tables.update(n=size, code=mix(np.arange(1, 257, dtype=_U) * _U(_P)), white=white, up=_powers(_P, size), down=_powers(_PINV, size))
    return _tables["code"], _tables["white"], _tables["up"], _tables["down"]


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all parts in order, and for each part where its words begin (one more at the end)."""
    buf = np.frombuffer(b" ".join([b"", *parts, b""]), dtype=np.uint8)
    code, white, up, down = _table(len(buf))
    gap = white[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    sums = np.cumsum(code[buf] * up[: len(buf)], dtype=_U)
    hashes = mix((sums[ends - 1] - sums[starts - 1]) * down[starts])
    at = np.cumsum([1] + [len(p) + 1 for p in parts])
    return hashes, np.searchsorted(starts, at)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the bytes between each start and end."""
    code, _, up, down = _table(len(buf))
    sums = np.zeros(len(buf) + 1, dtype=_U)
    np.cumsum(code[buf] * up[: len(buf)], dtype=_U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def chunks(parts: list[bytes], most: int = 1 << 19):
    """Ranges of parts of about `most` bytes, at least one part each."""
    begin, held = 0, 0
    for i, p in enumerate(parts):
        if held and held + len(p) > most:
            yield begin, i
            begin, held = i, 0
        held += len(p) + 1
    if begin < len(parts):
        yield begin, len(parts)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words of one document, in order; none if it has fewer words."""
    if len(words) < n:
        return words[:0]
    out = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        out = out * _U(_Q) + words[i : len(words) - n + 1 + i]
    return mix(out)


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Distinct hashes of n-word shingles, ascending; a shorter text is one shingle, an empty one has none."""
    if len(words) >= n:
        grams = ngram_hashes(words, n)
        grams.sort()
        new = np.empty(len(grams), dtype=bool)
        new[0] = True
        np.not_equal(grams[1:], grams[:-1], out=new[1:])
        return grams[new]
    return ngram_hashes(words, len(words)) ^ _U(len(words)) if len(words) else words


_ALL = (1 << 64) - 1


def mix_int(x: int) -> int:
    """mix() of one number."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _ALL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _ALL
    return x ^ (x >> 31)


def set_digest(shingles: np.ndarray) -> int:
    """One signed 64-bit digest of a set of hashes."""
    if not len(shingles):
        return 0
    total, odd = int(np.add.reduce(shingles)), int(np.bitwise_xor.reduce(shingles))
    out = mix_int(mix_int(total * _P & _ALL) + 3 * mix_int(odd * _Q & _ALL) + 5 * mix_int(len(shingles) * _PINV & _ALL) & _ALL)
    return out - (1 << 64) if out >> 63 else out
