"""Pre-tokens of whole Arrow text columns by numpy on their UTF-8 bytes.

Two published splitting patterns are supported, both over letters, numbers,
white space and the rest:

* ``word``: lower-cased text; contractions, letter runs, single numbers, runs
  of the rest; white space is dropped.
* ``byte``: contractions, and runs that may take one space before them; white
  space is kept.

The vectorised path covers code points below U+0180, where normalisation and
lower-casing are one to one. Rows with anything else, or with the text of a
special token, are named by ``plain_rows`` and go through the library.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_END = 0x180
_WHITE = "\t\n\x0b\x0c\r \x85\xa0"


def _kind(ch: str) -> int:
    if ch in _WHITE:
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(ch)[0], OTHER)


_LATIN = np.array([_kind(chr(c)) for c in range(_END)], np.uint8)
_ASCII = np.concatenate([_LATIN[:128], np.full(128, OTHER, np.uint8)])


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array without nulls."""
    data = col.buffers()[2]
    offsets = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0]: offsets[-1]], offsets - offsets[0]


def plain_rows(col: pa.Array, specials: list[str]) -> np.ndarray:
    """Which rows the vectorised path may take."""
    data, offsets = buffers(col)
    odd = np.flatnonzero(data > 0xC5)
    dotted = np.flatnonzero((data[:-1] == 0xC4) & (data[1:] == 0xB0)) if len(data) else odd
    plain = np.ones(len(col), bool)
    for at in (odd, dotted):
        plain[np.searchsorted(offsets, at, "right") - 1] = False
    for s in specials:
        plain &= ~pc.match_substring(col, s).to_numpy(zero_copy_only=False)
    return plain


def _classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cls = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC2)
    if lead.size:
        kind = _LATIN[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
        cls[lead] = kind
        cls[lead + 1] = kind
    return cls, lead


def _contractions(data, cls, start, ends_of, at) -> None:
    """Let apostrophes at ``at`` take s, t, m, d, re, ve or ll with them."""
    if not at.size:
        return
    end = ends_of(at)
    pad = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = pad[at + 1], pad[at + 2]
    one = np.where(at + 1 < end, one, 0)
    two = np.where(at + 2 < end, two, 0)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for hit, size in ((short, 1), (long, 2)):
        start[at[hit] + 1] = False
        rest = at[hit] + 1 + size
        rest = rest[rest < end[hit]]
        start[rest[cls[rest] == LETTER]] = True


def split(col: pa.Array, kind: str) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of plain rows, and for each row the index of its first one."""
    if kind == "word":
        col = pc.utf8_lower(col)
    data, offsets = buffers(col)
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(len(col) + 1, np.int64)
    cls, lead = _classes(data)
    start = np.empty(len(data), bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    edges = offsets[:-1][offsets[:-1] < len(data)]
    start[edges] = True
    ends_of = lambda at: offsets[np.searchsorted(offsets, at, "right")]
    quotes = np.flatnonzero((data == ord("'")) & start)
    if kind == "word":
        start |= cls == NUMBER
        if lead.size:
            start[lead + 1] = False
        _contractions(data, cls, start, ends_of, quotes)
        keep = cls != SPACE
        start &= keep
        first = np.flatnonzero(start)
        places = np.cumsum(keep, dtype=np.int32)[first] - 1
        data = data[keep]
    else:
        before = np.where(quotes > 0, data[quotes - 1], 0)
        free = (before != ord(" ")) | np.isin(quotes, edges)
        _contractions(data, cls, start, ends_of, quotes[free])
        inner = np.ones(len(data), bool)
        inner[edges] = False
        # the first byte after a run of white space, in the same row
        after = np.flatnonzero(inner[1:] & (cls[1:] != SPACE) & (cls[:-1] == SPACE)) + 1
        plain_space = data[after - 1] == ord(" ")
        joined = after[plain_space]
        start[joined] = False
        start[joined - 1] = True
        other = after[~plain_space]
        start[other - 1 - ((data[other - 1] & 0xC0) == 0x80)] = True
        first = places = np.flatnonzero(start)
    ends = np.append(places, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return words, np.searchsorted(first, offsets)
