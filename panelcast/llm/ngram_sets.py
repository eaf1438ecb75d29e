"""Word n-gram sets and MinHash bands of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from . import words

_CHUNK = 1 << 15


def gram_sets(col: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, end to end, and their offsets.

    A row with fewer than ``n`` words but some has one gram, all its words;
    a row without words has none.
    """
    found, first = words.split(col, full=True)
    h = words.hashes(found)
    grams, at = words.row_windows(h, first, n)
    row = np.searchsorted(first, at, "right") - 1
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < n))
    if short.size:
        extra = np.array([words.window_hashes(h[first[r]: first[r + 1]], int(size[r]))[0] for r in short], np.uint64)
        grams, row = np.concatenate([grams, extra]), np.concatenate([row, short])
    if short.size:
        order = np.argsort(row, kind="stable")
        grams, row = grams[order], row[order]
    edges = np.searchsorted(row, np.arange(len(col) + 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        grams[a:b].sort()
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
    grams, row = grams[new], row[new]
    return grams, np.searchsorted(row, np.arange(len(col) + 1))


def set_keys(grams: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A 128-bit key of each set: equal sets, equal keys."""
    return [xxhash.xxh3_128_digest(grams[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def band_keys(grams: np.ndarray, offsets: np.ndarray, bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """``bands`` keys for each non-empty set; a key joins ``rows`` minima."""
    size = np.diff(offsets)
    full = np.flatnonzero(size > 0)
    out = np.zeros((len(full), bands), np.uint64)
    k = bands * rows
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 1 << 32, k, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, k, dtype=np.uint32)
    small = (grams >> np.uint64(32)).astype(np.uint32)
    starts = offsets[:-1][full]
    # runs of rows of about _CHUNK grams, so that the arrays stay in cache
    group = starts // _CHUNK
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges], [*edges, len(full)], strict=True):
        if a == b:
            continue
        x = small[starts[a]: offsets[full[b - 1] + 1]]
        cuts = starts[a:b] - starts[a]
        least = np.empty((k, b - a), np.uint32)
        for j in range(k):
            np.minimum.reduceat(x * mul[j] + add[j], cuts, out=least[j])
        key = np.zeros((bands, b - a), np.uint64)
        for r in range(rows):
            key = (key + least[r::rows][:bands].astype(np.uint64)) * words.PLACE
            key ^= key >> np.uint64(29)
        out[a:b] = words.mixed(key + np.arange(bands, dtype=np.uint64)[:, None]).T
    return out


def packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column with the values of each row."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])
