"""Words, hashes and n-grams of Arrow string batches as numpy arrays: the shared inner step of the text operators.

A batch is cut into slices of about ``SLICE`` bytes so that a worker's memory does not depend on the batch; a text longer
than that is a slice of its own and is still taken whole. Everything works on UTF-8 bytes in 64-bit arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_PI = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (two xor-shift-multiply rounds)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_P))  # a random-looking value for each byte
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words after lower-casing A-Z: digits, a-z and every byte of a letter outside ASCII.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
_pow = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["up"]) < n:
        for key, base in (("up", _P), ("down", _PI)):
            a = np.full(n + (n >> 2), base, dtype=np.uint64)
            a[0] = 1
            _pow[key] = np.cumprod(a, dtype=np.uint64)
    return _pow["up"][:n], _pow["down"][:n]


class Texts(NamedTuple):
    """Rows ``lo`` to ``hi`` of a batch: their bytes and the n + 1 offsets into them."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray


def text_slices(column: pa.Array, lower: bool = True, limit: int = SLICE) -> Iterator[Texts]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        part = data[offs[lo] : offs[hi]]
        yield Texts(lo, hi, LOWER[part] if lower else part, offs[lo : hi + 1] - offs[lo])
        lo = hi


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true, cut at row borders."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offs[1:] > offs[:-1]
    first, last = offs[:-1][full], offs[1:][full] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes have equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * U(0xA0761D6478BD642F))


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offs: np.ndarray  # n + 1 offsets of the rows into the words


def words(t: Texts, inside: np.ndarray = IS_WORD) -> Words:
    starts, ends = runs(inside[t.data], t.offs)
    return Words(starts, ends, span_hashes(t.data, starts, ends), np.searchsorted(starts, t.offs))


def rows_of(offs: np.ndarray) -> np.ndarray:
    """The row of every element, from the rows' offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive hashes (len - k + 1 of them; row borders are the caller's matter)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g = mix(g * U(0xE7037ED1A0B428DB) + h[j : j + n])
    return g


def gram_mask(offs: np.ndarray, k: int) -> np.ndarray:
    """Which of the positions 0 .. n-k start k elements of one row."""
    n = int(offs[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=bool)
    ok = np.ones(n + 2 * k, dtype=bool)
    for j in range(1, k):
        bad = offs[1:] - j
        ok[bad[bad >= 0]] = False
    return ok[:n]


def is_in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(known) or not len(x):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def list_column(values: np.ndarray, offs: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32), pa.int32()), pa.array(values, kind))


def letters_in(text: str) -> bool:
    return any(c.isalpha() for c in text)
