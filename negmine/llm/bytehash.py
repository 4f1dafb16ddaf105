"""Array kernels over the UTF-8 bytes of a batch of texts.

Everything works on numpy arrays that lie over an Arrow string column, a few
megabytes at a time, so a task's memory does not follow its number of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the output."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 20)) * _U(_BASE))


_BYTE = {seed: randoms(256, seed) | _U(1) for seed in (1, 2)}


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. base ** (n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.ones(max(n, CHUNK_BYTES + 4096), dtype=_U)
        out[1:] = _U(base)
        have = np.multiply.accumulate(out)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


class Chunk:
    """Some rows of a batch: ``data`` are their bytes, row i is data[offsets[i]:offsets[i+1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def prefix_hash(self, seed: int = 1) -> np.ndarray:
        """Running sums from which ``span_hash`` gets the hash of any span."""
        n = len(self.data)
        out = np.zeros(n + 1, dtype=_U)
        np.cumsum(_BYTE[seed][self.data] * powers(n, _BASE), out=out[1:])
        return out

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the maximal runs of word bytes; no run crosses a row."""
        n = len(self.data)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = is_word[self.data]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        first[cut] = inside[1:-1][cut]
        last[cut - 1] = inside[1:-1][cut - 1]
        starts = np.flatnonzero(first)
        ends = np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans; equal bytes hash alike wherever they stand."""
    back = powers(len(prefix), _BASE_INVERSE)
    length = (ends - starts).astype(_U)
    return mix((prefix[ends] - prefix[starts]) * back[starts] + length * _U(0xD6E8FEB86659FD93))


def texts_of(column: pa.Array) -> pa.Array:
    """The column as plain strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a string column in order, about ``size`` bytes at a time; a longer row comes alone."""
    column = texts_of(column)
    if len(column) == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), len(column), at + 65536)
        yield Chunk(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], at)
        at = to


def lowered(column: pa.Array) -> pa.Array:
    """A-Z in lower case, all else as it is."""
    column = texts_of(column)
    buffers = column.buffers()
    if not buffers[2]:
        return column
    data = np.frombuffer(buffers[2], dtype=np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    return pa.LargeStringArray.from_buffers(len(column), buffers[1], pa.py_buffer(data), offset=column.offset)


def byte_class(pattern: str, wide: bool = False) -> np.ndarray:
    """Which bytes a character class holds; bytes over 127 belong to it if ``wide``."""
    return np.array([wide if b > 127 else bool(re.fullmatch(pattern, chr(b))) for b in range(256)])


#: Words of letters, digits and all that is not ASCII.
ALNUM = byte_class(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", wide=True)
#: Words between white space.
SPACED = byte_class(r"[^\x20\x09-\x0D]", wide=True)

_SHINGLE = randoms(64, 9) | _U(1)


def shingle_hashes(chunk: Chunk, is_word: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of n-word runs per row, as (hashes, bounds): row i has hashes[bounds[i]:bounds[i+1]], sorted.

    A row with fewer words, but not none, has one hash of all of them.
    """
    starts, ends, rows = chunk.words(is_word)
    rows_n = len(chunk)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(rows_n + 1, np.int64)
    words = span_hash(chunk.prefix_hash(), starts, ends)
    first = np.searchsorted(rows, np.arange(rows_n + 1))
    count = np.diff(first)
    whole = len(words) - n + 1
    parts, owner = [], []
    if whole > 0:
        full = rows[:whole] == rows[n - 1:]
        h = np.zeros(whole, dtype=_U)
        for k in range(n):
            h += words[k:k + whole] * _SHINGLE[k]
        parts.append(mix(h[full]))
        owner.append(rows[:whole][full])
    for row in np.flatnonzero((count > 0) & (count < n)):
        own = words[first[row]:first[row + 1]]
        parts.append(mix((own * _SHINGLE[:len(own)]).sum(dtype=_U, keepdims=True) + _U(len(own))))
        owner.append(np.array([row]))
    hashes, owner = np.concatenate(parts), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    return hashes, np.searchsorted(owner, np.arange(rows_n + 1))
