"""Order statistics of very many windows of one series, in log2(rows) steps each whatever the length of the windows.

The values are numbered by size. A wavelet matrix has, for each bit of these numbers from the most significant down, how many of the rows before each have a zero there, the rows being dealt by that bit
for the next one (zeros first, otherwise in order). Two look-ups a level carry the bounds of a window down it, so the k-th smallest value of a window and the number of its values below another are found in as many steps as there are
bits. It is all numpy, with one array operation for all windows; it takes 4 bytes a row and bit.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """The values of a series (NaN above all others), to be asked about windows [lo, hi) of its rows."""

    def __init__(self, values: np.ndarray):
        self.values, number = np.unique(values, return_inverse=True)
        self.number = number.astype(np.int64)
        self.bits = max(1, int(len(self.values) - 1).bit_length()) if len(self.values) else 1
        #: by bit, the most significant first: zeros among the rows before each, and among all
        self.zeros: list[np.ndarray] = []
        rows = self.number
        for b in reversed(range(self.bits)):
            one = (rows >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]).astype(np.int32))
            rows = np.concatenate([rows[~one], rows[one]])

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) of each window; 0 <= k < hi - lo."""
        lo, hi, k = (np.array(x, np.int64) for x in np.broadcast_arrays(lo, hi, k))
        found = np.zeros(len(lo), np.int64)
        for zeros in self.zeros:
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            one = k >= b - a
            k = np.where(one, k - (b - a), k)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
            found = found << 1 | one
        return self.values[found]

    def count_at_most(self, lo: np.ndarray, hi: np.ndarray, values: np.ndarray) -> np.ndarray:
        """How many values of each window are at most a value; NaN is at most nothing."""
        lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
        known = len(self.values) - int(np.isnan(self.values[-1:]).sum())
        # below this number
        limit = np.searchsorted(self.values[:known], values, "right")
        limit = np.where(np.isnan(values), 0, limit)
        every = limit >= 1 << self.bits
        total, start, end = np.zeros(len(lo), np.int64), lo, hi
        for b, zeros in zip(reversed(range(self.bits)), self.zeros):
            left, right = zeros[start].astype(np.int64), zeros[end].astype(np.int64)
            one = (limit >> b & 1).astype(bool)
            total += np.where(one, right - left, 0)
            start, end = np.where(one, zeros[-1] + start - left, left), np.where(one, zeros[-1] + end - right, right)
        return np.where(every, hi - lo, total)

    def quantile(self, lo: np.ndarray, w: int, q: float) -> np.ndarray:
        """Linear interpolation between order statistics of the windows of w rows from lo on."""
        place = q * (w - 1)
        low = int(np.floor(place))
        part = place - low
        a, b = (self.smallest(lo, lo + w, np.full(len(lo), k)) for k in (low, min(low + 1, w - 1)))
        return a + (b - a) * part if part < 0.5 else b - (b - a) * (1 - part)

    def median_distance(self, lo: np.ndarray, w: int) -> np.ndarray:
        """Median distance from the median of the windows of w rows from lo on.

        Distances of the lower half, from its greatest value down, and of the upper half, from its least up, are two sorted sequences; the place of the k-th of both is found by bisection.
        """
        half = (w + 1) // 2
        at = lambda k: self.smallest(lo, lo + w, k)
        middle = (at(np.full(len(lo), (w - 1) // 2)) + at(np.full(len(lo), w // 2))) / 2
        below = lambda i: np.abs(middle - at(np.clip(half - 1 - i, 0, w - 1)))
        above = lambda i: np.abs(at(np.clip(half + i, 0, w - 1)) - middle)

        def distance(k: int) -> np.ndarray:
            """The k-th smallest distance."""
            least, most = np.full(len(lo), max(0, k + 1 - (w - half))), np.full(len(lo), min(k + 1, half))
            while (least < most).any():
                i = (least + most) // 2
                # among the k + 1 smallest are more of the lower half than i
                more = (least < most) & (above(k - i) > below(i))
                least, most = np.where(more, i + 1, least), np.where(more, most, i)
            last_below = np.where(least > 0, below(least - 1), -np.inf)
            last_above = np.where(k - least >= 0, above(k - least), -np.inf)
            return np.maximum(last_below, last_above)

        return (distance((w - 1) // 2) + distance(w // 2)) / 2
