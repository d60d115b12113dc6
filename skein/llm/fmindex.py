"""FM-index over integer sequences, with a wavelet matrix on packed bits; all queries run in lockstep."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector: 64-bit words and a running count for each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, a: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.zeros = [], []
        for k in range(self.levels - 1, -1, -1):
            b = (a >> k) & 1
            self.bits.append(Bits(b))
            self.zeros.append(int(len(b) - b.sum()))
            a = np.concatenate([a[b == 0], a[b == 1]])
        c = np.arange(symbols)
        self.base = self._down(c, np.zeros(symbols, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            one = (c >> (self.levels - 1 - k)) & 1
            r = bits.rank(i)
            i = np.where(one == 1, zeros + r, i - r)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before it."""
        c = np.zeros(len(i), np.int64)
        for bits, zeros in zip(self.bits, self.zeros):
            one, r = bits.get(i), bits.rank(i)
            i = np.where(one, zeros + r, i - r)
            c = 2 * c + one
        return c, i - self.base[c]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c among the first i symbols."""
        return self._down(c, i) - self.base[c]


def sort_suffixes(t: np.ndarray) -> np.ndarray:
    """Starts of t's suffixes in order, by doubling."""
    n, h = len(t), 1
    _, rank = np.unique(t, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - h)] = rank[h:]
        key = rank * (n + 2) + nxt
        sa = np.argsort(key, kind="stable")
        new = np.concatenate([[1], np.cumsum(np.diff(key[sa]) > 0) + 1])
        rank = np.empty(n, np.int64)
        rank[sa] = new
        h *= 2
        if new[-1] == n:
            return sa


class FMIndex:
    """Compressed index of sequences of non-negative numbers, laid end to end with separators (symbol 1) and a last symbol of its own (0).

    What is kept: the alphabet, the wavelet matrix of the Burrows-Wheeler transform, and every
    RATE-th place of the suffix array; neither the text nor the whole array.
    """

    RATE = 8

    def __init__(self, sequences: list[np.ndarray]):
        self.alphabet = np.unique(np.concatenate([*sequences, np.zeros(0, np.uint64)]))
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.first = np.cumsum(sizes + 1) - sizes - 1  # where each sequence starts in the text
        self.n = int((sizes + 1).sum())
        t = np.ones(self.n + 1, np.int64)
        t[-1] = 0
        t[np.repeat(self.first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())] = self.encode(np.concatenate([*sequences, np.zeros(0, np.uint64)]))
        self.n += 1
        sa = sort_suffixes(t)
        S = len(self.alphabet) + 2
        self.below = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=S))])
        self.tree = WaveletMatrix(t[sa - 1], S)
        known = (sa % self.RATE == 0).astype(np.uint8)
        self.known, self.samples = Bits(known), sa[known == 1].astype(np.int32)

    def encode(self, s: np.ndarray) -> np.ndarray:
        """Symbols from 2; 0 for what the text doesn't hold."""
        if not len(self.alphabet):
            return np.zeros(len(s), np.int64)
        k = np.minimum(np.searchsorted(self.alphabet, s), len(self.alphabet) - 1)
        return np.where(self.alphabet[k] == s, k + 2, 0)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search, for all pairs of bounds at once."""
        n = self.below[c]
        both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return n + both[: len(c)], n + both[len(c) :]

    def statistics(self, q: np.ndarray, end: np.ndarray, depth: int, least=1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place `end` in q the length of the longest match that ends there and occurs `least` times (one number, or one for each; up to depth), and its interval.

        q: encoded; places before its start end a match.
        """
        length, live, least = np.zeros(len(end), np.int64), np.arange(len(end)), np.broadcast_to(least, len(end))
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.n)
        for k in range(depth):
            at = end[live] - k
            live, at = live[at >= 0], at[at >= 0]
            c = q[at]
            a, e = self.extend(c, lo[live], hi[live])
            ok = (e - a >= least[live]) & (c > 0)
            live = live[ok]
            if not len(live):
                break
            lo[live], hi[live], length[live] = a[ok], e[ok], k + 1
        return length, lo, hi

    def matching_statistics(self, s: np.ndarray, depth: int) -> np.ndarray:
        """For each place in s the length of the longest match that ends there (up to depth)."""
        return self.statistics(self.encode(s), np.arange(len(s)), depth)[0]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix array: steps back to the next known one."""
        out, live, row, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(live):
            have = self.known.get(row)
            at = np.flatnonzero(have)
            out[live[at]] = self.samples[self.known.rank(row[at])] + steps
            live, row = live[~have], row[~have]
            if len(live):
                c, r = self.tree.access(row)
                row = self.below[c] + r
            steps += 1
        return out

    def spans(self, s: np.ndarray, threshold: int) -> list[tuple[int, int]]:
        """Merged intervals of s that are covered by matches of at least `threshold`."""
        out: list[tuple[int, int]] = []
        for e in np.flatnonzero(self.matching_statistics(s, threshold) >= threshold).tolist():
            a = e + 1 - threshold
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], e + 1)
            else:
                out.append((a, e + 1))
        return out
