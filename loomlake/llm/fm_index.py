"""A full-text index in minute space over integer sequences, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank queries over symbols below 2**levels: one bit vector a level, with its prefix counts."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        # where each symbol's block begins after the last level
        self.sorted = symbols

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        lo, hi = np.zeros_like(i), i
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((symbol >> (self.levels - 1 - depth)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(bit, zeros + a, lo - a), np.where(bit, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Index of a text of symbols from 1; 0 separates its parts, and no pattern spans it; one is
    added where the last part has none.

    The suffix array is sorted by prefix doubling, with separators in text order. Text positions are kept for every
    eighth place and for the first of each part; others are found by walking back with the last-to-first
    mapping.
    """

    SAMPLE = 8

    def __init__(self, text: np.ndarray, size: int):
        if len(text) and text[-1]:
            text = np.append(text, 0).astype(text.dtype)
        n = len(text)
        cut = text == 0
        rank = text.astype(np.int64) + int(cut.sum())
        rank[cut] = np.arange(cut.sum())
        order, step = np.argsort(rank, kind="stable"), 1
        _, rank = np.unique(rank, return_inverse=True)
        while n and rank.max() < n - 1:
            tail = np.zeros(n, np.int64)
            tail[: n - step] = rank[step:] + 1
            key = rank.astype(np.int64) * (n + 1) + tail
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
            step *= 2
        self.n = n
        before = order - 1
        self.bwt = np.where(before >= 0, text[before], 0).astype(np.int32) if n else np.empty(0, np.int32)
        self.tree = WaveletMatrix(self.bwt, max(1, int(size).bit_length()))
        counts = np.bincount(text, minlength=size + 2)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        known = (order % self.SAMPLE == 0) | (self.bwt == 0)
        self.known, self.at = np.concatenate(([0], np.cumsum(known))), order[known]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, low, high): suffix ranges of the rows of ``patterns`` that occur."""
        who = np.arange(len(patterns))
        lo, hi = np.zeros(len(who), np.int64), np.full(len(who), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[who, j].astype(np.int64)
            lo = self.first[symbol] + self.tree.rank(symbol, lo)
            hi = self.first[symbol] + self.tree.rank(symbol, hi)
            live = lo < hi
            who, lo, hi = who[live], lo[live], hi[live]
        return who, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows."""
        rows, out, walked = rows.copy(), np.empty(len(rows), np.int64), 0
        left = np.arange(len(rows))
        while len(left):
            row = rows[left]
            done = self.known[row + 1] > self.known[row]
            out[left[done]] = self.at[self.known[row[done]]] + walked
            left, row = left[~done], row[~done]
            symbol = self.bwt[row].astype(np.int64)
            rows[left] = self.first[symbol] + self.tree.rank(symbol, row)
            walked += 1
        return out
