"""Words of whole Arrow text columns, and hashes of word windows, by numpy.

A word is a run of ASCII letters and digits and of any characters beyond
ASCII. With ``full`` the text is lower-cased throughout, else only A-Z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .pretokens import buffers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.zeros(256, bool)
_KEEP[48:58] = _KEEP[97:123] = _KEEP[128:] = True

#: Odd multiplier that gives each place in a window a weight of its own.
PLACE = np.uint64(0x9E3779B97F4A7C15)


def split(col: pa.Array, full: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words of a column without nulls, and for each row the index of its first."""
    if full:
        col = pc.utf8_lower(col)
    data, offsets = buffers(col)
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(col) + 1, np.int64)
    data = _LOWER[data]
    keep = _KEEP[data]
    start = keep.copy()
    start[1:] &= ~keep[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = keep[edges]
    first = np.flatnonzero(start)
    kept = data[keep]
    places = np.append(np.cumsum(keep, dtype=np.int32)[first] - 1, len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(kept)])
    return words, np.searchsorted(first, offsets)


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word; each distinct one is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy()]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values (the published splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on (places near the end: none)."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = word_hash[:n].copy()
    for k in range(1, size):
        out *= PLACE
        out += word_hash[k: n + k]
    return mixed(out + np.uint64(size))


def row_windows(word_hash: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows that lie in one row, and the place of each."""
    found = window_hashes(word_hash, size)
    inside = np.ones(len(found), bool)
    ends = first[1:-1]
    for back in range(1, size):
        at = ends - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    return found[inside], np.flatnonzero(inside)
