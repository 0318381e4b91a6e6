"""Words and word k-grams of many texts as 64-bit hashes, in NumPy over whole Arrow buffers.

A word's hash is a polynomial over random byte values modulo 2**64, read off one
running sum over the buffer, so no Python loop runs over bytes or words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_Q = 0xD1342543DE82EF95
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes handled at once; the working set is about 40 times as much.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _R) | np.uint64(1)


def lower_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM_SEPARATORS = separators([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: `[^\x20\x09-\x0D]+`
SPACE_SEPARATORS = separators([(0x20, 0x20), (0x09, 0x0D)])


class Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _R)]))
            self.down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _R_INV)]))
        return self.up, self.down


class Words:
    """Words of some texts in a row: hashes, byte starts and ends in `data`, and first[i]:first[i+1] for text i."""

    def __init__(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> None:
        self.data, self.hashes, self.start, self.end, self.first = data, hashes, start, end, first

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k consecutive words at each word; valid where the text has k words from there."""
        n = len(self.hashes)
        out = np.zeros(n, np.uint64)
        if n >= k:
            acc = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                acc += self.hashes[j : n - k + 1 + j] * np.uint64(pow(_Q, j, 2**64))
            out[: n - k + 1] = mix(acc + np.uint64(k))
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)
        return out, left >= k


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """One hash for a whole sequence of words; for len(words) == k it is that of Words.grams(k)."""
    acc = np.uint64(0)
    with np.errstate(over="ignore"):
        for j, w in enumerate(words):
            acc = acc + w * np.uint64(pow(_Q, j, 2**64))
        return mix(np.array([acc + np.uint64(len(words))], np.uint64))


class Tokenizer:
    def __init__(self, sep: np.ndarray) -> None:
        self.sep, self.fold, self.values, self.powers = sep, lower_ascii(), _byte_values(), Powers()
        self.values = self.values[self.fold]

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        n = len(data)
        ok = ~self.sep[self.fold[data]]
        begin = ok.copy()
        begin[1:] &= ~ok[:-1]
        inner = offsets[:-1][(offsets[:-1] < n)]
        begin[inner] = ok[inner]
        stop = ok.copy()
        stop[:-1] &= ~ok[1:]
        last = offsets[1:][(offsets[1:] > 0)] - 1
        stop[last] = ok[last]
        start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        up, down = self.powers.of(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * up[:n], out=sums[1:])
        hashes = mix((sums[end] - sums[start]) * down[start])
        return Words(data, hashes, start, end, np.searchsorted(start, offsets))


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of a string column: (first row, bytes, offsets of the rows in them), a few MB at a time. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        to = min(to, n)
        yield at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
