"""Word and shingle hashes of whole batches of texts, as arrays (helpers of Arrow tasks).

Texts stay in the UTF-8 buffer Arrow hands over. Words are runs of bytes that are no separators; a word's hash comes
from prefix sums over its bytes, so no word becomes a Python object.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Separators of words: space and U+0009 to U+000D.
BLANKS = bytes([*range(9, 14), 32])
#: Bytes whose sums are formed at once.
CHUNK = 1 << 16
_BASE = 0x9E3779B97F4A7C13
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits (the finaliser of splitmix64)."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & _MASK)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_letter = mix(np.arange(256, dtype=U), 1)
_letter[65:91] = _letter[97:123]  # A-Z count as a-z
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, _BASE, U), np.full(size, pow(_BASE, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


@dataclass
class Words:
    """Words of texts: hash, first byte and end in the buffer; those of text i are at[i] to at[i+1]."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts and where each begins (a null text is empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8), at


def words(texts: pa.Array, separators: bytes = BLANKS) -> Words:
    data, offsets = buffers(texts)
    lo, hi = int(offsets[0]), int(offsets[-1])
    gap = np.zeros(256, bool)
    gap[list(separators)] = True
    solid = ~gap[data[lo:hi]]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    borders = offsets[:-1][offsets[:-1] < hi] - lo
    first[borders] = solid[borders]
    last = solid.copy()  # the word's last byte
    last[:-1] &= ~solid[1:]
    ends = offsets[1:][offsets[1:] > lo] - lo - 1
    last[ends] = solid[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(start), U)
    i = 0
    while i < len(start):
        # words whose bytes lie within a chunk, one word at least
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, side="right")))
        a, b = int(start[i]), int(end[j - 1])
        up, down = _power_tables(b - a + 1)
        sums = np.zeros(b - a + 1, U)
        np.cumsum(_letter[data[lo + a : lo + b]] * up[: b - a], out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        hashes[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U)
        i = j
    at = np.searchsorted(start, offsets - lo)
    return Words(mix(hashes), start + lo, end + lo, at, data, offsets)


def shingles(found: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each k words in a row and where each text's begin; a text of fewer words has its whole sequence as one."""
    h, at = found.hashes, found.at
    counts = np.diff(at)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    to = np.zeros(len(at), np.int64)
    np.cumsum(n, out=to[1:])
    whole = np.zeros(max(len(h) - k + 1, 0), U)
    for j in range(k):
        whole += h[j : j + len(whole)] * U((0xD6E8FEB86659FD93 * (2 * j + 1) + 2 * j) & _MASK | 1)
    out = np.empty(int(to[-1]), U)
    long = counts >= k
    place = np.repeat(at[:-1][long] - to[:-1][long], n[long]) if long.any() else np.empty(0, np.int64)
    target = np.flatnonzero(np.repeat(long, n))
    out[target] = mix(whole[place + target], k)
    for i in np.flatnonzero((counts > 0) & ~long):
        total = 0
        for w in h[at[i] : at[i + 1]].tolist():
            total = (total * _BASE + w) & _MASK
        out[to[i]] = mix(np.array([total], U), int(counts[i]))[0]
    return out, to


def sets(found: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """As shingles(), each text's sorted and without repeats."""
    h, at = shingles(found, k)
    for i in range(len(at) - 1):
        h[at[i] : at[i + 1]].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[at[:-1][at[:-1] < len(h)]] = True
    to = np.zeros(len(at), np.int64)
    np.cumsum(fresh, out=(total := np.zeros(len(h) + 1, np.int64))[1:])
    to[:] = total[at]
    return h[fresh], to


def slices(texts: pa.Array, size: int = 2 << 20) -> list[pa.Array]:
    """texts in parts of about so many bytes each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    _, offsets = buffers(texts)
    out, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        out.append(texts.slice(i, j - i))
        i = j
    return out


def totals(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each text's values, wrapping around."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U, copy=False).view(np.int64)


class Seen:
    """Tells names that a task has not met yet, so that copies count once in each task; its memory is bounded, so some may count again."""

    def __init__(self, limit: int = 1_000_000):
        self.names: set[int] = set()
        self.limit = limit

    def fresh(self, names: np.ndarray) -> np.ndarray:
        if len(self.names) > self.limit:
            self.names.clear()
        out = np.empty(len(names), bool)
        for i, name in enumerate(names.tolist()):
            out[i] = name not in self.names
            self.names.add(name)
        return out
