"""Rolling windows over numpy arrays."""

from __future__ import annotations

import numpy as np


def gathered(v: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
    """Rows v[start:stop], filled up with inf to size; stop - start <= size."""
    idx = np.minimum(start[:, None] + np.arange(size), max(len(v) - 1, 0))
    return np.where(np.arange(size) < (stop - start)[:, None], v[idx], np.inf)


def middles(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of the first n of each sorted row; NaN where n is 0."""
    lo, hi = np.maximum((n - 1) // 2, 0), np.minimum(n // 2, rows.shape[1] - 1)
    i = np.arange(len(n))
    return np.where(n > 0, (rows[i, lo] + rows[i, hi]) / 2, np.nan)


def medians(v: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
    w = gathered(v, start, stop, size)
    w.sort(axis=1)
    return middles(w, stop - start)


def medians_and_deviations(v: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and median absolute deviation of v[start:stop] for each row; NaN where it is empty."""
    w = gathered(v, start, stop, size)
    w.sort(axis=1)
    med = middles(w, stop - start)
    with np.errstate(invalid="ignore"):
        w = np.abs(w - med[:, None])
    w[np.isnan(w)] = np.inf
    w.sort(axis=1)
    return med, middles(w, stop - start)
