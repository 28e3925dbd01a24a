"""Word arrays of whole texts, many texts at a time, inside one task.

Texts are joined with a byte no word holds, so that one numpy pass finds and
hashes the words of all of them. Pieces are bounded by bytes, not rows; a text
longer than the bound makes a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

SPACES = b" \t\n\x0b\x0c\r"


def lower_table() -> np.ndarray:
    """Byte to byte, A-Z to a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()


def space_mask() -> np.ndarray:
    """True for the bytes that end a word: blanks, and the byte between texts."""
    mask = np.zeros(256, dtype=bool)
    mask[list(SPACES)] = True
    return mask


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if text is None else text for text in column.cast(kind).to_pylist()]


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes in all."""
    start = total = 0
    for at, text in enumerate(texts):
        if at > start and total + len(text) > limit:
            yield start, at
            start, total = at, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every bit of 64 over all of them."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64, n of each."""
    out = []
    for base in (_BASE, _BASE_INVERSE):
        power = np.ones(n, dtype=_U64)
        power[1:] = _U64(base)
        out.append(np.cumprod(power, dtype=_U64))
    return out[0], out[1]


def _room(n: int) -> int:
    return max(1 << 16, 1 << (n - 1).bit_length())


class Words:
    """Words of a piece of texts: where each starts and ends, its text and its hash."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        if lower:
            data = LOWER[data]
        blank = _BLANK[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(data) and not blank[0]:
            edge = np.concatenate(([0], edge))
        self.data = data
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(lengths + 1)))
        # words of text i are first[i]:first[i + 1]
        self.first = np.searchsorted(self.start, self.text_start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.data)
        power, inverse = _powers(_room(n))
        total = np.zeros(n + 1, dtype=_U64)
        np.cumsum((self.data.astype(_U64) + _U64(1)) * power[:n], out=total[1:])
        value = (total[self.end] - total[self.start]) * inverse[self.start]
        return mix(value + (self.end - self.start).astype(_U64))


_BLANK = space_mask()


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``size`` words.

    A text of fewer words, but not none, has its whole sequence as one shingle;
    a text without words has the empty set.
    """
    words = Words(texts)
    hashed = words.hashes()
    grams = np.full(max(0, len(hashed) - size + 1), size, dtype=_U64)
    for k in range(size):
        grams = mix(grams * _U64(_BASE) + hashed[k : k + len(grams)])
    out = []
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], dtype=_U64)
            for k in range(a, b):
                whole = mix(whole * _U64(_BASE) + hashed[k])
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=_U64))
    return out
