"""Vectorised text kernels shared by the corpus operators.

Everything here works on one *chunk*: the UTF-8 bytes of several documents laid
end to end, with the byte offsets at which each begins. Word and window hashes
are Rabin-Karp polynomials modulo 2**64, taken for all positions at once from
prefix sums, so no Python loop runs over words. Polynomials are finalised by a
bijective mixer, because a polynomial modulo a power of two has weak low bits.

Null texts count as empty. Chunks hold whole documents only; a document longer
than ``CHUNK_BYTES`` makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; temporary arrays take about 60 times this.
CHUNK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
WORD_BASE_AGAIN = np.uint64(0xA24BAED4963EE407)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True

IDENTITY = np.arange(256, dtype=np.uint8)
LOWER_ASCII = IDENTITY.copy()
LOWER_ASCII[65:91] += 32


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept and grown as needed."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        _POWERS[int(base)] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(fold: np.ndarray, factor: int) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(factor))
    return values[fold]


VALUES = _byte_values(IDENTITY, 0xA0761D6478BD642F)
VALUES_LOWER = _byte_values(LOWER_ASCII, 0xA0761D6478BD642F)
#: For a second hash, independent of the first.
VALUES_AGAIN = _byte_values(IDENTITY, 0xE7037ED1A0B428DB)
VALUES_LOWER_AGAIN = _byte_values(LOWER_ASCII, 0xE7037ED1A0B428DB)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null gives an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole documents."""
    data, offsets = text_buffers(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """Words of a chunk: byte spans, and how many each document has.

    ``bounds[d] : bounds[d + 1]`` are the words of document d of the chunk.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK):
        n = len(data)
        inside = np.empty(n + 1, bool)
        np.logical_not(blank[data], out=inside[:n])
        inside[n] = False
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        cut = offsets[(offsets > 0) & (offsets < n)]
        edge[cut] = inside[cut]
        self.starts = np.flatnonzero(edge)
        stop = ~inside
        stop[1:] &= inside[:-1]
        stop[0] = False
        if n:
            stop[cut] |= inside[cut - 1]
            stop[n] = inside[n - 1]
        self.ends = np.flatnonzero(stop)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.data = data

    def hashes(self, values: np.ndarray = VALUES) -> np.ndarray:
        """A mixed 64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        first = 0
        while first < len(out):  # a long text in runs of words, so that sums stay short
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + CHUNK_BYTES, side="right")))
            begin, end = self.starts[first], self.ends[last - 1]
            power, inverse = _powers(_BASE, end - begin + 1)
            sums = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(values[self.data[begin:end]] * power[:-1], out=sums[1:])
            starts, ends = self.starts[first:last] - begin, self.ends[first:last] - begin
            out[first:last] = (sums[ends] - sums[starts]) * inverse[starts]
            first = last
        out += (self.ends - self.starts).astype(np.uint64)
        return mix(out)


def window_hashes(words: np.ndarray, width: int, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """Hash of every run of ``width`` words, by where it begins; runs across documents included."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * inverse[:n])


def window_owner(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, starts): the windows that lie inside one document, by their first word."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(bounds[:-1], counts)
    return owner, start


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of ``width`` values, by where it begins."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span : width - span + n])
