"""Vectorised word splitting and hashing over Arrow string buffers.

Words and n-grams are hashed on their UTF-8 bytes with numpy only: a word's hash is a polynomial in its bytes, taken
for all words of a chunk at once, so no Python object is made per word. Hashes are 64 bit and the same everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_SPACE = re.compile(rb"[ \t-\r]")
#: Bytes of text hashed at once; working arrays take some 40 times as much.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """A word alphabet: which bytes make words, and a hash value for each byte, A-Z as a-z."""

    def __init__(self, is_word):
        self.is_word = np.array([is_word(b) for b in range(256)])
        low = np.arange(256)
        low[65:91] += 32
        self.lower = low.astype(np.uint8)
        self.value = np.where(self.is_word, mix(np.uint64(0x1234567) + low.astype(np.uint64)), np.uint64(0))


#: Everything but the six ASCII white spaces.
SPACED = Words(lambda b: b != 0x20 and not 9 <= b <= 13)
#: Digits, letters and everything beyond ASCII.
ALNUM = Words(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90 or b >= 128)


_TABLE: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 .. size - 1 of P and of its inverse. One table, as long as the longest chunk so far."""
    if len(_TABLE[0]) < size:
        for k, base in enumerate((_P, _PINV)):
            out = np.ones(1 << (size - 1).bit_length(), np.uint64)
            done, by = 1, np.array([base])
            while done < len(out):
                np.multiply(out[:done], by, out=out[done : 2 * done])
                by = by * by
                done *= 2
            _TABLE[k] = out
    return _TABLE[0][:size], _TABLE[1][:size]


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets into the bytes) of runs of rows of about `limit` bytes; null is empty."""
    n = len(col)
    if not n:
        return
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def pieces(data: bytes, limit: int = 1 << 20) -> Iterator[bytes]:
    """data in pieces of about `limit` bytes, cut before white space, so that no word is cut."""
    at = 0
    while len(data) - at > limit:
        space = _SPACE.search(data, at + limit)
        end = space.start() if space else len(data)
        yield data[at:end]
        at = end
    yield data[at:]


def words(data: np.ndarray, off: np.ndarray, kind: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, first word of each row and the total) of the words of the rows in a chunk."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    m = kind.is_word[data]
    edge = m.copy()
    edge[1:] &= ~m[:-1]
    inner = off[:-1][off[:-1] < len(data)]
    edge[inner] = m[inner]
    starts = np.flatnonzero(edge)
    edge = m
    last = m.copy()
    last[:-1] &= ~m[1:]
    tails = off[1:][off[1:] > 0] - 1
    last[tails] = edge[tails]
    ends = np.flatnonzero(last) + 1
    first = np.searchsorted(starts, off)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), first
    up, down = _powers(len(data))
    v = kind.value[data]
    v *= up
    h = np.add.reduceat(v, starts)
    h *= down[starts]
    return starts, ends, mix(h), first


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (the last n - 1 positions have none); rows are not told apart."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    k = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        k *= _Q
        k += h[j : len(h) - n + 1 + j]
    return mix(k + np.uint64(n))
