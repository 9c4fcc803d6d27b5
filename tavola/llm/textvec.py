"""Vectorised words and shingles of a column of texts.

Small helpers used inside Spark tasks on Arrow batches: a text column is looked at as
one byte array, words are found with masks, and hashes come from prefix sums, so the
cost is a few array passes a byte and no Python object a word.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z only.  Hashes are 64 bits
wide; they stand for words and shingles from here on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts handled at once, and bytes of words hashed at once, which takes some 40 bytes a byte.
CHUNK_BYTES, HASHED_BYTES = 1 << 19, 1 << 18

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = np.random.default_rng(20240501).integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)  # odd, so invertible modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, kept between chunks of one task."""

    up = down = np.zeros(0, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = _powers(_BASE, n)
            cls.down = _powers(_U(pow(int(_BASE), -1, 2**64)), n)
        return cls.up[:n], cls.down[:n]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, bytes, offsets) over whole texts, about CHUNK_BYTES at a time; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and 64-bit hashes, and the index of each text's first word (n + 1 entries)."""
    size = len(data)
    inside = np.zeros(size + 1, dtype=bool)
    inside[:size] = ~_SPACE[data]
    edge = np.zeros(size + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(size + 1, dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~inside))
    hashes = np.empty(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):  # a long text is hashed some words at a time
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + HASHED_BYTES, side="right")))
        at = int(starts[first])
        own = data[at : int(ends[last - 1])]
        up, down = _Powers.of(len(own) + 1)
        sums = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_LOWER[own]] * up[: len(own)], out=sums[1:])
        a, b = starts[first:last] - at, ends[first:last] - at
        hashes[first:last] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        first = last
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; fewer words than ``width`` make one shingle, none none."""
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled = rolled * _STEP + hashes[k : n - width + 1 + k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            value = np.full(1, b - a, dtype=np.uint64)  # the number of words keeps short texts apart from shingles
            for h in hashes[a:b]:
                value = value * _STEP + h
            out.append(mix(mix(value)))
        else:
            out.append(hashes[:0])
    return out
