"""Helpers for Arrow batches: whole texts as byte arrays, vectorised word spans and fingerprints.

A fingerprint of bytes [s, e) is (H[e] - H[s]) * INV^s modulo 2^64, where H are running sums of mixed bytes times powers
of an odd number. It depends on the bytes alone, not on where they stand, so any range costs one subtraction.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose results a task gathers before it sends them; a longer text makes a block of its own.
BLOCK_BYTES = 16 << 20
#: Bytes that are fingerprinted at once, at some tens of bytes of memory each; a longer text makes a piece of its own.
PIECE_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_ODD))
_POWERS = {_ODD: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; grown by doubling and kept by the worker."""
    have = _POWERS[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _POWERS[base] = have
    return have[:n]


def running(data: np.ndarray) -> np.ndarray:
    """H of the module's docstring; one element more than there are bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(_ODD, len(data)), out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def fold(parts: Iterable[np.ndarray]) -> np.ndarray:
    """One fingerprint of a sequence of fingerprints, order included."""
    total = None
    for part in parts:
        total = part.copy() if total is None else total * np.uint64(0xD6E8FEB86659FD93) + part
    return mix(total)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


WHITE_SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, without gaps, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n, (_, offsets, data) = len(column), column.buffers()
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes outside the table `apart`; no run crosses texts."""
    inside = ~apart[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offs[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def blocks(batches: Iterable[pa.RecordBatch], text: str, size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of a task's batches in blocks of about `size` bytes of text; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        first = 0
        for i, length in enumerate(lengths.tolist()):
            if total + length > size and (held or i > first):
                if i > first:
                    held.append(batch.slice(first, i - first))
                yield pa.Table.from_batches(held)
                held, total, first = [], 0, i
            total += length
        if first < batch.num_rows:
            held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def pieces(offs: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `size` bytes each."""
    at, n = 0, len(offs) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, stop
        at = stop
