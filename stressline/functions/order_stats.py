"""Order statistics of rolling frames by a Fenwick tree over ranks: a row enters or leaves, and a quantile or a tail mean is found, in O(log n)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np


class RankedFrame:
    """Counts and sums of the values in a frame, by rank among all values that can ever enter it."""

    def __init__(self, values: Sequence[float]):
        self.values = sorted(set(values))
        self.size = len(self.values)
        self.count, self.total = [0] * (self.size + 1), [0.0] * (self.size + 1)
        self.top = 1 << max(self.size.bit_length() - 1, 0)
        self.n, self.sum = 0, 0.0

    def rank(self, x: float) -> int:
        return bisect_left(self.values, x)

    def add(self, rank: int, sign: int = 1) -> None:
        x = sign * self.values[rank]
        self.n += sign
        self.sum += x
        i = rank + 1
        while i <= self.size:
            self.count[i] += sign
            self.total[i] += x
            i += i & -i

    def kth(self, k: int) -> float:
        """The k-th smallest value, from 0."""
        at, step, left = 0, self.top, k
        while step:
            nxt = at + step
            if nxt <= self.size and self.count[nxt] <= left:
                at = nxt
                left -= self.count[nxt]
            step >>= 1
        return self.values[at]

    def quantile(self, q: float) -> float:
        """Linear between neighbours."""
        at = q * (self.n - 1)
        k = int(at)
        low = self.kth(k)
        return low if at == k else low + (self.kth(k + 1) - low) * (at - k)

    def mean_from(self, x: float) -> float:
        """Mean of the values from x on; at least one is."""
        n, total, i = self.n, self.sum, bisect_left(self.values, x)
        while i:
            n -= self.count[i]
            total -= self.total[i]
            i -= i & -i
        return total / n


def rolling_tails(loss: np.ndarray, levels: Sequence[float], window: int, *, lag: int = 0, least: int = 1, first: int = 0) -> np.ndarray:
    """(rows from ``first`` on, 2 x levels): quantile and mean from it on of each row's frame, NaN where fewer than ``least`` values are in it. The frame ends ``lag`` rows
    back; missing losses are in no count."""
    n = len(loss)
    out = np.full((n - first, 2 * len(levels)), np.nan)
    frame = RankedFrame(loss[~np.isnan(loss)].tolist())
    ranks = [-1 if x != x else frame.rank(x) for x in loss.tolist()]
    for i in range(n):
        if i - lag >= 0 and ranks[i - lag] >= 0:
            frame.add(ranks[i - lag])
        gone = i - lag - window
        if gone >= 0 and ranks[gone] >= 0:
            frame.add(ranks[gone], -1)
        if i >= first and frame.n >= least:
            for j, q in enumerate(levels):
                v = frame.quantile(q)
                out[i - first, 2 * j], out[i - first, 2 * j + 1] = v, frame.mean_from(v)
    return out
