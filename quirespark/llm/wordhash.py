"""Vectorised hashes of words and of runs of words, straight from Arrow's text buffers.

A run's hash is a polynomial in the hashes of its words, taken from prefix sums, so
that any run costs the same; all arithmetic is modulo 2**64 and mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import RELEASED
from .fingerprints import mixed

U = np.uint64
#: Bytes of text that are hashed at a time; a longer document is cut at white space.
SLAB = 1 << 20
_odd = 0x9E3779B97F4A7C15 | 1
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_bytes = mixed(np.arange(256), 11)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
RELEASED.append(_powers.clear)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, U(b))
                steps[0] = 1
                made.append(np.cumprod(steps, dtype=U))
        known = _powers[base] = (made[0], made[1])
    return known


def runs(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums from which :func:`run` takes the hash of any run."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(values) + 1, U)
        np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], dtype=U, out=out[1:])
    return out


def run(sums: np.ndarray, base: int, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        value = (sums[end] - sums[start]) * powers(base, len(sums))[1][start]
    return mixed(value + (end - start).astype(U) * U(0xD6E8FEB86659FD93), seed)


def words(data: np.ndarray, borders: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data``, whose documents begin and end at ``borders``; and words before each border."""
    hashes, before, at = [], [0], 0
    while at < len(borders) - 1:
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + SLAB, "right")) - 1)
        low, high = int(borders[at]), int(borders[to])
        if to == at + 1 and high - low > 2 * SLAB:
            number = 0
            for part in _pieces(data[low:high]):
                h, _ = _words(part, np.array([0, len(part)]), lower)
                hashes.append(h)
                number += len(h)
            before.append(before[-1] + number)
        else:
            h, n = _words(data[low:high], borders[at : to + 1] - low, lower)
            hashes.append(h)
            before.extend((before[-1] + n[1:]).tolist())
        at = to
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), np.array(before, np.int64)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(data):
        to = min(at + SLAB, len(data))
        while to < len(data):
            blank = np.flatnonzero(_blank[data[to : to + SLAB]])
            if len(blank):
                to += int(blank[0])
                break
            to = min(to + SLAB, len(data))
        yield data[at:to]
        at = to


def _words(data: np.ndarray, borders: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    if lower:
        data = _lower[data]
    text = ~_blank[data]
    first = text.copy()
    first[1:] &= ~text[:-1]
    inner = borders[(borders > 0) & (borders < len(data))]
    first[inner] = text[inner]
    last = text.copy()
    last[:-1] &= ~text[1:]
    last[inner - 1] = text[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = runs(_bytes[data], _odd)
    return run(sums, _odd, start, end, 12), np.searchsorted(start, borders)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and borders of a string column; a null is an empty text."""
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, np.int32 if column.type == pa.string() else np.int64)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), borders


def slabs(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``SLAB`` bytes of text, or of one document."""
    _, borders = buffers(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(borders, borders[at] + SLAB, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
