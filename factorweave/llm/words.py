"""Word splitting and hashing over whole Arrow batches, shared by the text operators.

Everything here works on one bounded block of rows inside a task; Spark partitions
and shuffles the work around it.  Texts stay UTF-8 bytes: the separators of both word
definitions are single bytes below 0x80, which never occur inside a longer character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: space and 0x09-0x0D.
SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of alphanumeric words: 0-9, A-Z, a-z and everything from 0x80.
ALNUM_WORD = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM_WORD[_lo:_hi] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_U = np.uint64
_BASE, _SEQ = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd, so they have inverses mod 2**64
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; grown by doubling and kept in the worker."""
    have = _tables.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have * _U(pow(base, len(have), 2**64))])
    _tables[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit value over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _segments(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n), out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(pow(base, -1, 2**64), n + 1)[starts]


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a block of texts.

    starts, ends: byte positions in `data`; first: index of each text's first word, with
    the total as last entry; doc: the text of each word; ids: 64-bit word hashes.
    """

    def __init__(self, column, table: np.ndarray = SPACE_WORD, lower: bool = False):
        self.data, self.offsets = text_buffer(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = table[self.data]
        edge = np.zeros(n + 1, bool)  # a text's end is the end of a word, too
        edge[self.offsets] = True
        turn = inside[1:] != inside[:-1]
        self.starts = np.flatnonzero(inside[1:] & (turn | edge))
        self.ends = np.flatnonzero(inside[:-1] & (turn | edge))
        self.first = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, step: int = 1 << 19) -> np.ndarray:
        """64-bit hash of every word, in pieces that keep the memory bounded."""
        out = np.empty(len(self.starts), np.uint64)
        a = 0
        while a < len(out):
            lo = self.starts[a]
            b = max(a + 1, int(np.searchsorted(self.ends, lo + step, "right")))
            hi = self.ends[b - 1]
            out[a:b] = mix(_segments(_BYTE[self.data[lo:hi]], self.starts[a:b] - lo, self.ends[a:b] - lo, _BASE))
            a = b
        return out

    def segment_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of any byte ranges, as hashes() has them of words; ranges may overlap."""
        return mix(_segments(_BYTE[self.data], starts, ends, _BASE))

    def fits(self, length: int) -> np.ndarray:
        """For each word whether a window of so many words starts there within its text."""
        return np.arange(len(self.doc)) + length <= self.first[1:][self.doc]


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of the `length` words from each position; positions too near the end get 0."""
    out = np.zeros(len(ids), np.uint64)
    n = len(ids) - length + 1
    if n > 0:
        at = np.arange(n)
        out[:n] = mix(_segments(ids, at, at + length, _SEQ) + _U(length))
    return out


def pieces(batch, text: str, most: int = 1 << 20):
    """Cuts a record batch into runs of rows of at most `most` text bytes (one row at least)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b
