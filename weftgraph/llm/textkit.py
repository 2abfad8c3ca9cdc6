"""Vectorised word, shingle and window hashing over Arrow batches of text.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; none of these bytes occurs inside a
multi-byte UTF-8 character, so working on bytes gives the same words as working on characters.
All hashes are 64-bit and depend on the words alone: they agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 19  # text handled at once; a longer text makes a chunk of its own

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_CHAR_BASE = U(0x9E3779B97F4A7C15)
WORD_BASE = U(0xD1342543DE82EF95)
WORD_BASE_INV = U(pow(int(WORD_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_CHAR_POWERS = powers(_CHAR_BASE, 4096)


def _char_powers(n: int) -> np.ndarray:
    return _CHAR_POWERS[:n] if n <= len(_CHAR_POWERS) else powers(_CHAR_BASE, n)


@dataclass
class Words:
    """The words of a run of texts: byte span and text number of each, and each text's first word."""

    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # byte where a word starts
    ends: np.ndarray
    first: np.ndarray  # per text, number of its first word; one more entry at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = self.ends - self.starts
        hop = np.zeros(len(size), np.int64)
        np.cumsum(size[:-1], out=hop[1:])
        inside = np.ones(len(self.data), bool)
        inside[IS_SPACE[self.data]] = False
        data = self.data[inside]
        within = np.arange(len(data), dtype=np.int64) - np.repeat(hop, size)
        value = (_BYTE[LOWER] if lower else _BYTE)[data]
        value *= _char_powers(int(size.max()))[within]
        return mix(np.add.reduceat(value, hop))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """data: the bytes of some texts end to end; offsets: where each starts, and the end."""
    space = IS_SPACE[data]
    start = ~space
    start[1:] &= space[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    start[inner] = ~space[inner]  # a text's first byte starts a word even if the text before ends in one
    end = ~space
    end[:-1] &= space[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    end[last] = ~space[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Rolling:
    """Hashes of any run of words, from prefix sums; equal runs have equal hashes wherever they stand."""

    def __init__(self, word_hashes: np.ndarray):
        n = len(word_hashes)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(word_hashes * powers(WORD_BASE, n), out=self.prefix[1:])
        self.inverse = powers(WORD_BASE_INV, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def runs(self, length: int) -> np.ndarray:
        """The hash of the run of that many words at each start, over text borders too."""
        n = len(self.prefix) - 1 - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[length:] - self.prefix[:n]) * self.inverse[:n] + U(length))


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
