"""Distances between blocks of vectors: a matrix product tells which pairs may lie within a bound, exact sums decide.

The product loses digits, so the bound is widened by more than it can lose; what passes is summed component by component,
in order. Hence the results are those of comparing all pairs one by one, at the speed of a matrix product.
"""

from __future__ import annotations

import numpy as np

ROWS = 256  # rows of the left block whose products with the right block lie in memory at once
COLUMNS = 4_096


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances, a component at a time: no cancellation, one matrix of memory."""
    square = np.zeros((len(x), len(y)))
    for j in range(x.shape[1] if len(x) else 0):
        square += np.square(x[:, j, None] - y[None, :, j])
    return np.sqrt(square)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of equal place, summed as in :func:`distances`."""
    square = np.zeros(len(x))
    for j in range(x.shape[1]):
        square += np.square(x[:, j] - y[:, j])
    return square


class Known:
    """The right block, prepared for many left blocks."""

    def __init__(self, y: np.ndarray):
        self.y = y
        self.keep = 1 - 8 * (y.shape[1] + 8) * np.finfo(float).eps
        self.middle = y[:: -(-len(y) // 1_024)].mean(axis=0) if len(y) else np.zeros(y.shape[1])  # small norms, small losses
        z = y - self.middle
        self.wide = np.concatenate([z, -np.square(z).sum(axis=1, keepdims=True) * self.keep], axis=1)

    def within(self, x: np.ndarray, bound: np.ndarray, a: int = 0, b: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places (in x, in y) of all pairs with rows a to b of y at distance ``bound`` (one per row of x) or less, and of a
        few beyond. At most ``ROWS`` rows of x."""
        z = x - self.middle
        left = np.concatenate([2 * z, np.ones((len(z), 1))], axis=1)
        with np.errstate(invalid="ignore", over="ignore"):
            least = np.square(z).sum(axis=1) * self.keep - np.square(bound) * (2 - self.keep)
            i, j = np.nonzero(left @ self.wide[a:b].T >= least[:, None])
        return i, j + a


def nearest(x: np.ndarray, known: Known, copies: np.ndarray, best: np.ndarray, bound: np.ndarray, a: int, b: int) -> np.ndarray:
    """``best`` (per row of x the k least distances so far, ascending) with rows a to b of the known block, each counted
    ``copies`` times; distances above ``bound`` may be left out."""
    k, out = best.shape[1], best.copy()
    for r in range(0, len(x), ROWS):
        rows, some = x[r : r + ROWS], out[r : r + ROWS]
        at = a
        while at < b:
            limit = np.minimum(bound[r : r + ROWS], some[:, -1])
            end = min(b, at + (COLUMNS if np.isfinite(limit).all() else max(ROWS, k)))
            i, j = known.within(rows, limit, at, end)
            d = np.sqrt(squares(rows[i], known.y[j]))
            times = np.minimum(copies[j], k)
            i = np.concatenate([np.repeat(np.arange(len(rows)), k), np.repeat(i, times)])
            d = np.concatenate([some.ravel(), np.repeat(d, times)])
            order = np.lexsort((d, i))
            first = np.searchsorted(i[order], np.arange(len(rows)))
            some = d[order][first[:, None] + np.arange(k)]
            at = end
        out[r : r + ROWS] = some
    return out
