"""Vectorised word scanning over Arrow string columns.

The operators that hash words (substring dedup, n-gram join, decontamination)
run inside ``mapInArrow`` tasks.  This module turns an Arrow column into NumPy
arrays of word boundaries and 64-bit word hashes without a Python object per
word.  Memory is bounded by the Arrow batch; bytes are hashed in pieces of
a quarter of a megabyte, cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 18
_ODD = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ODD, -1, 1 << 64)


def _table(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes of the word class [^\x20\x09-\x0D].
NOT_SPACE = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of the word class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z.
ALPHANUMERIC = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)

_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _RANDOM.copy()
_FOLDED[0x41:0x5B] = _RANDOM[0x61:0x7B]

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for key, base in (("up", _ODD), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its row offsets; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a batch: byte spans, hashes, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1, dtype=np.int64), self.count)


def _pieces(kind: np.ndarray, cut: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE_BYTES that end where a run of one kind ends."""
    at, n = 0, len(kind)
    while at < n:
        to = min(n, at + PIECE_BYTES)
        while to < n and kind[to] and kind[to] == kind[to - 1] and not cut[to]:
            to += 1
        yield at, to
        at = to


def runs(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: bool) -> Words:
    """Find and hash the maximal runs of bytes of one kind (uint8 per byte, 0: in no run) of every row.

    ``fold`` hashes A-Z as a-z.  Equal runs get equal hashes; the bytes
    themselves are not copied.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    values = _FOLDED if fold else _RANDOM
    starts, ends, hashes = [], [], []
    for lo, hi in _pieces(kind, cut):
        k = kind[lo:hi]
        edge = np.ones(hi - lo + 1, bool)
        edge[1:-1] = k[1:] != k[:-1]
        edge[:-1] |= cut[lo:hi]
        at = np.flatnonzero(edge)
        inside = k[at[:-1]] != 0
        s, e = at[:-1][inside], at[1:][inside]
        up, down = _power(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * up[:-1], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(_ODD)))
        starts.append(s + lo)
        ends.append(e + lo)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    start = join(starts, np.int64)
    return Words(start, join(ends, np.int64), join(hashes, np.uint64), np.searchsorted(start, offsets, "left"))


def scan(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: bool) -> Words:
    """Find and hash the maximal runs of ``inside`` bytes of every row."""
    return runs(data, offsets, inside[data].view(np.uint8), fold)


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every window of ``width`` words: (first word, hash).

    The hash is the polynomial of the word hashes in a fixed base modulo 2**64,
    summed by Horner's rule over shifted views, then finalised.  Windows never
    cross rows.
    """
    n = len(words.hash) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    row = words.row
    at = np.flatnonzero(row[:n] == row[width - 1 :])
    total = words.hash[:n].copy()
    for k in range(1, width):
        total *= np.uint64(_ODD)
        total += words.hash[k : n + k]
    return at, mix(total[at])


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, rows)
        lo = min(hi, rows)


def resliced(batches: Iterator[pa.RecordBatch], most: int = 8 << 20, text: int = 1) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` text bytes, or of one row."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        for lo, hi in slices(offsets, most):
            yield batch.slice(lo, hi - lo)


def lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """List column with ``counts[i]`` consecutive values in row i."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), values)


def split_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and per-row counts of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def split_places(column: pa.Array, fields: tuple[str, ...]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Flat fields and per-row counts of a list of structs; a null list counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    return {f: pc.struct_field(flat, f).to_numpy(zero_copy_only=False) for f in fields}, pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
