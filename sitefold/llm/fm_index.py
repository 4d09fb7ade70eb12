"""An FM-index over integer sequences: suffix order, wavelet-tree ranks, sampled positions."""

from __future__ import annotations

import numpy as np

#: every so many text positions one is stored; a match walks at most this far to it
SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by doubling the compared length.

    The text must end with its only smallest symbol.
    """
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, width = len(text), 1
    while True:
        ahead = np.zeros(n, dtype=np.int64)
        if width < n:
            ahead[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.zeros(n, dtype=np.int64)
        new[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        rank, width = new, width * 2
        if rank[order[-1]] == n - 1:
            return order


class WaveletTree:
    """Rank and access on a sequence of small integers, all queries at once.

    The levels are stored one after another as in a wavelet matrix: a level holds one
    bit of each symbol, and symbols with bit 0 come before those with bit 1 on the next.
    """

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1
            ones = np.r_[0, np.cumsum(bit)]
            self.levels.append((shift, ones, len(symbols) - ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        start = np.zeros_like(end)
        for shift, ones, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            start, end = (np.where(one, zeros + ones[p], p - ones[p]) for p in (start, end))
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for shift, ones, zeros in self.levels:
            one = ones[at + 1] - ones[at]
            symbol |= one << shift
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Index of a text of integers >= 1; 0 is used as its end."""

    def __init__(self, text: np.ndarray, size: int):
        text = np.r_[text, 0].astype(np.int64)
        order = suffix_array(text)
        self.tree = WaveletTree(text[order - 1], size)
        self.smaller = np.r_[0, np.cumsum(np.bincount(text, minlength=size))]
        sampled = order % SAMPLE == 0
        self.sampled, self.slot, self.places = sampled, np.cumsum(sampled) - 1, order[sampled]
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns (rows padded on the left) by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1]
        for step in range(width):
            live = np.flatnonzero((lengths > step) & (high > low))
            symbol = patterns[live, width - 1 - step]
            low[live] = self.smaller[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[at])
        while len(open_):
            symbol = self.tree.access(at[open_])
            at[open_] = self.smaller[symbol] + self.tree.rank(symbol, at[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[at[open_]]]
        return self.places[self.slot[at]] + steps
