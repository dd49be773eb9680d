"""Words of whole Arrow columns as 64-bit hashes, without a Python object a word.

A word is a run of anything but ASCII white space, A-Z lowered, as UTF-8 bytes.
Its hash is a polynomial over its bytes modulo 2^64, read off one running sum
over the column's bytes, then mixed; equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1  # a byte 0 counts too
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SPLIT = np.zeros(256, bool)  # for words of letters and digits only
_SPLIT[:128] = [not chr(i).isalnum() for i in range(128)]
_tables: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 18)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _tables[:] = out
    return _tables[0], _tables[1]


def text_parts(column: pa.Array, most: int = 1 << 18, rows: int = 1 << 14) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of at most ``rows`` rows of about ``most`` bytes; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        to = min(to, at + rows, len(column))
        yield at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each document's begin (one more than documents).

    ``alnum``: a word is a run of anything but ASCII blanks, signs and marks.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = (_SPLIT if alnum else _SPACE)[data]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0] = last[-1] = True
    first[1:], last[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = True
    last[inner - 1] = True
    start, end = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
    power, back = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * power[:n], out=total[1:])
    hashed = (total[end] - total[start]) * back[start]
    return mix(hashed + (end - start).astype(np.uint64)), np.searchsorted(start, offsets)


def shingles(hashed: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of each run of ``size`` words of one document, or of all if fewer."""
    if not len(hashed):
        return hashed
    width = min(size, len(hashed))
    out = np.full(len(hashed) - width + 1, width, np.uint64)
    for j in range(width):
        out += hashed[j : len(hashed) - width + 1 + j] * _MULT[j % 5] + np.uint64(j // 5)
    return mix(out)
