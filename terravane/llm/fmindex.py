"""A compressed word-level FM-index and matching statistics of sequences that are streamed through it.

The Burrows-Wheeler transform of the indexed sequences is kept as a wavelet matrix of packed bits with a rank count for every
64 of them, about 1.5 * log2(words) bits a word.  Beside it stand, for every suffix, the length of the prefix that it has in common
with the one before it (one byte, more where sequences are longer) and the nearest suffixes with a shorter one (two
32-bit numbers): the links by which a match that cannot go on is shortened.  Neither the text nor the order of suffixes is kept.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Rank of a symbol in a prefix, by one packed bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.bits = len(symbols), bits
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        s = symbols.astype(np.int32)
        for b in range(bits - 1, -1, -1):
            on = ((s >> b) & 1).astype(bool)
            packed = np.packbits(np.concatenate([on, np.zeros(-len(on) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            self.zeros.append(int(len(on) - on.sum()))
            s = np.concatenate([s[~on], s[on]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        part = self.words[level][at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.counts[level][at] + np.bitwise_count(part)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Position, in the order of symbols at the last level, of the first occurrence of c at or after i."""
        i = i.astype(np.int64)
        for level in range(self.bits):
            ones = self._ones(level, i)
            bit = (c >> (self.bits - 1 - level)) & 1
            i = np.where(bit == 1, self.zeros[level] + ones, i - ones)
        return i


def suffix_order(text: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of sequences that end in a 0, and the common prefixes of neighbours, which end before the 0.

    ``left``: symbols before the next 0.  Suffixes that agree as far as that stay in the order of the text.
    """
    n, longest = len(text), int(left.max()) + 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while step < longest:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        step *= 2
        ranks.append(rank)
    order = np.argsort(rank, kind="stable")
    i, j, same = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        p, q = i + same, j + same
        on = (p < n) & (q < n)
        on[on] = ranks[k][p[on]] == ranks[k][q[on]]
        same[on] += 1 << k
    return order, np.minimum(same, np.minimum(left[i], left[j]))


def nearest_less(x: np.ndarray) -> np.ndarray:
    """For every place the nearest place before it with a smaller value; 0 where there is none."""
    at = np.maximum(np.arange(len(x)) - 1, 0)
    todo = np.flatnonzero((at > 0) & (x[at] >= x))
    while len(todo):
        at[todo] = at[at[todo]]
        todo = todo[(at[todo] > 0) & (x[at[todo]] >= x[todo])]
    return at.astype(np.int32)


class FMIndex:
    """Index over sequences of symbols from 1 on, each followed by a 0."""

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        ends = np.flatnonzero(text == 0)
        left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
        order, same = suffix_order(text, left)
        #: common[i]: prefix of suffixes i - 1 and i; 0 before the first and after the last.
        self.common = np.concatenate([[0], same, [0]]).astype(np.min_scalar_type(int(left.max())))
        self.before = nearest_less(self.common)
        self.after = (n - nearest_less(self.common[::-1])[::-1]).astype(np.int32)
        symbols = int(text.max()) + 1
        self.matrix = WaveletMatrix(text[order - 1], max(1, (symbols - 1).bit_length()))
        count = np.bincount(text, minlength=symbols)
        self.shift = np.cumsum(count) - count - self.matrix.rank(np.arange(symbols), np.zeros(symbols, np.int64))

    def extend(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that begin with c and go on with one of [lo, hi)."""
        both = self.matrix.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        m = len(c)
        return both[:m] + self.shift[c], both[m:] + self.shift[c]

    def shorten(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest proper prefix of each match that more suffixes have: its interval and length."""
        a, b = self.common[lo], self.common[hi]
        m = np.maximum(a, b)
        return np.where(a == m, self.before[lo], lo), np.where(b == m, self.after[hi], hi), m.astype(np.int64)

    def matching(self, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Matching statistics of text[first : first + size]: for each position the longest match with the index that starts there.

        Every sequence is read from its end by backward search; where the interval would become empty, the match is shortened
        until it can go on.  Symbols that the index lacks are -1.
        """
        length = np.zeros(len(text), np.int64)
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        lo, hi, m = np.zeros(len(size), np.int64), np.full(len(size), self.n, np.int64), np.zeros(len(size), np.int64)
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(longest), side="left")
        for t in range(longest):
            k = active[t]
            at = first[:k] + size[:k] - 1 - t
            c = text[at]
            lost = np.flatnonzero(c < 0)
            lo[lost], hi[lost], m[lost] = 0, self.n, 0
            todo = np.flatnonzero(c >= 0)
            while len(todo):
                a, b = self.extend(lo[todo], hi[todo], c[todo])
                ok = a < b
                done = todo[ok]
                lo[done], hi[done] = a[ok], b[ok]
                m[done] += 1
                todo = todo[~ok]
                if len(todo):
                    lo[todo], hi[todo], m[todo] = self.shorten(lo[todo], hi[todo])
                    whole = m[todo] == 0
                    lo[todo[whole]], hi[todo[whole]] = 0, self.n
            length[at] = m[:k]
        return length
