"""A word-level FM-index: suffix array, Burrows-Wheeler transform, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np

#: every how many text positions the suffix position is kept
SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``s`` (non-negative symbols) in lexicographic order.

    Prefix doubling from as many symbols as fit 62 bits; later rounds sort only what is still tied.
    """
    n = len(s)
    bits = max(1, int(s.max(initial=0)).bit_length())
    h = max(1, 62 // bits)
    padded = np.concatenate([s.astype(np.int64), np.zeros(h, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(h):
        key = key << bits | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    # a suffix shorter than h ends in padding: the shorter of two equal keys is the smaller
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    while True:
        tied = np.ones(n, bool)
        tied[:-1] = new[1:]
        slots = np.flatnonzero(~(new & tied))
        if not len(slots):
            return order
        members = order[slots]
        after = np.full(len(members), 0, np.int64)
        inside = members + h < n
        after[inside] = rank[members[inside] + h] + 1
        pair = rank[members] * (n + 1) + after
        by = np.argsort(pair, kind="stable")
        order[slots] = members[by]
        pair = pair[by]
        fresh = np.ones(len(slots), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[slots] = fresh | new[slots]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[slots]] = start[slots]
        h *= 2


class WaveletMatrix:
    """Rank of a symbol in a sequence, for arrays of symbols and positions."""

    def __init__(self, s: np.ndarray, bits: int):
        self.n, self.bits, self.levels = len(s), bits, []
        s = s.copy()
        for b in range(bits - 1, -1, -1):
            bit = (s >> b & 1).astype(np.int32)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = self.n - int(ones[-1])
            self.levels.append((b, ones, zeros))
            one = bit.astype(bool)
            s = np.concatenate([s[~one], s[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(at), at.copy()
        for b, ones, zeros in self.levels:
            one = (symbol >> b & 1).astype(bool)
            l1, h1 = ones[lo], ones[hi]
            lo = np.where(one, zeros + l1, lo - l1)
            hi = np.where(one, zeros + h1, hi - h1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at these positions."""
        out, at = np.zeros(len(at), np.int64), at.copy()
        for _, ones, zeros in self.levels:
            one = ones[at + 1] - ones[at]
            out = out << 1 | one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Counts and locates phrases (arrays of symbols > 0) in a text of symbols >= 0; ``top``: the greatest symbol that is asked for."""

    def __init__(self, text: np.ndarray, top: int = 0):
        self.n = len(text) + 1
        s = np.concatenate([text.astype(np.int64) + 1, [0]])  # 0 ends the text
        sa = suffix_array(s)
        bits = max(int(s.max()), top + 1).bit_length()
        self.bwt = WaveletMatrix(s[sa - 1], bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << bits))])
        self.marked = sa % SAMPLE == 0
        self.place = np.concatenate([[0], np.cumsum(self.marked)])
        self.sampled = sa[self.marked]

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the ranges of the phrases with a symbol put before them."""
        c = symbol + 1
        base = self.before[c]
        return base + self.bwt.rank(c, lo), base + self.bwt.rank(c, hi)

    def everything(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(k, np.int64), np.full(k, self.n, np.int64)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the sorted suffixes, by walking to the next sampled one."""
        at, out, steps, left = rows.copy(), np.full(len(rows), -1, np.int64), 0, np.arange(len(rows))
        while len(left):
            hit = self.marked[at]
            out[left[hit]] = self.sampled[self.place[at[hit]]] + steps
            left, at = left[~hit], at[~hit]
            if len(left):
                c = self.bwt.access(at)
                at = self.before[c] + self.bwt.rank(c, at)
            steps += 1
        return out
