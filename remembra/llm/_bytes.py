"""Vectorised text primitives on raw UTF-8 buffers.

Texts are never turned into Python strings here: an Arrow string column is viewed as one
byte array, a newline is put before, between and after the documents, and words, lines and
their 64-bit hashes come out of a few passes of numpy over that array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from remembra.llm import _memory  # noqa: F401

#: White space of the word pattern [^\x20\x09-\x0D]+ as a byte mask.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of text handled at once; a longer document is a piece of its own.
PIECE = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_UNBASE = _U(pow(int(_BASE), -1, 1 << 64))
_NGRAM = _U(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit values whose bits all depend on all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n; a long text's table is not kept."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    up, down = np.full(n, _BASE, _U), np.full(n, _UNBASE, _U)
    up[0] = down[0] = 1
    made = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if n <= 2 * PIECE:
        _powers = made
    return made


class Texts:
    """Documents side by side in one buffer; document i fills begin[i]:end[i]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n = len(offsets) - 1
        at = offsets - offsets[0]
        self.data = np.insert(data[offsets[0] : offsets[-1]], at, 10)
        self.begin = at[:-1] + np.arange(1, self.n + 1)
        self.end = at[1:] + np.arange(1, self.n + 1)
        self._sums = None

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Texts:
        """Nulls are empty texts."""
        return cls(*raw(column))

    def lower(self) -> None:
        """A-Z become a-z, in place."""
        d = self.data
        d += ((d >= 65) & (d <= 90)).astype(np.uint8) << 5

    def words(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the number of words of each document; space: which bytes part words, the newline among them."""
        space = space[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # the buffer starts and ends with a newline
        starts, ends = edge[::2], edge[1::2]
        bounds = np.searchsorted(starts, np.append(self.begin, len(self.data)))
        return starts, ends, np.diff(bounds)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span's bytes, the same wherever the span lies."""
        up, down = _power_tables(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, _U)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(_U))

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document the mask holds."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.end] - sums[self.begin]


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offs


def pieces(batch: pa.RecordBatch | pa.Table, name: str, limit: int = PIECE) -> Iterator[pa.RecordBatch | pa.Table]:
    """Slices of consecutive rows with at most `limit` bytes of text each, or one row."""
    column = batch.column(batch.schema.get_field_index(name))
    _, offs = raw(column)
    k = 0
    while k < len(column):
        to = max(k + 1, int(np.searchsorted(offs, offs[k] + limit, "right")) - 1)
        yield batch.slice(k, to - k)
        k = to


def ngrams(words: np.ndarray, doc: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n up to `most`: n, the hash of the n words from each word on, and whether they lie in one document."""
    rolled = np.zeros(len(words), _U)
    power = _U(1)
    for n in range(1, most + 1):
        if len(words) < n:
            return
        rolled = rolled[: len(words) - n + 1] + words[n - 1 :] * power
        with np.errstate(over="ignore"):
            power = power * _NGRAM
        yield n, mix(rolled + _U(n)), doc[: len(words) - n + 1] == doc[n - 1 :]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = twice[np.append(True, twice[1:] != twice[:-1])]
    return member(keys, twice)


_FILTER = _U((1 << 20) - 1)


def member(keys: np.ndarray, those: np.ndarray) -> np.ndarray:
    """Which keys are among those, which are sorted and hashed; most misses fall to a table of low bits."""
    out = np.zeros(len(keys), bool)
    if len(those):
        near = np.zeros(1 << 20, bool)
        near[those & _FILTER] = True
        maybe = np.flatnonzero(near[keys & _FILTER])
        at = np.searchsorted(those, keys[maybe])
        at[at == len(those)] = 0
        out[maybe] = those[at] == keys[maybe]
    return out
