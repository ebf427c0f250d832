"""A compressed full-text index of word sequences: the Burrows-Wheeler transform in a wavelet matrix of packed bits.

Backward search runs for many patterns at once, one word of each at a time, as a few vector operations.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling: suffixes ordered by their first 1, 2, 4, ... symbols until all differ."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    size = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(0, n - size)] = rank[size:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        size *= 2
        if size >= n or step.sum() == n - 1:
            return order


class Bits:
    """A bit vector in 64-bit words with a count before each word: rank in constant time at 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many of the first ``i`` bits are set."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


class FMIndex:
    """``text``: ids from 1, with 0 between sequences; ``owner``: a number for each place of the text.

    ``least`` gives the smallest owner among the places of a suffix interval, from a sparse table of minima.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray):
        sa = suffix_array(text)
        n = len(text)
        bwt = text[sa - 1]
        self.n = n
        self.depth = max(1, int(text.max(initial=0)).bit_length())
        counts = np.bincount(text, minlength=(1 << self.depth) + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)  # suffixes of smaller symbols
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        row = bwt
        for level in range(self.depth - 1, -1, -1):
            bit = (row >> level & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            self.zeros.append(int(n - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        # Where each symbol's run starts behind the last level: what rank leaves of place 0.
        self.base = self._walk(np.arange(1 << self.depth), np.zeros(1 << self.depth, np.int64))
        self.minima = [owner[sa].astype(np.int32)]
        while (1 << len(self.minima)) <= n:
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[: len(last) - half], last[half:]))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.levels):
            ones = bits.rank(i)
            i = np.where(symbol >> (self.depth - 1 - k) & 1, self.zeros[k] + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ``symbol`` before what the intervals stand for; symbol 0 and unknown ones (-1) give empty ones."""
        known = (symbol > 0) & (symbol < 1 << self.depth)
        s = np.where(known, symbol, 0)
        both = self._walk(np.concatenate([s, s]), np.concatenate([lo, hi])) - np.concatenate([self.base[s]] * 2)
        m = len(s)
        start = self.first[s]
        return np.where(known, start + both[:m], 0), np.where(known, start + both[m:], 0)

    def alone(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each symbol by itself."""
        known = (symbol > 0) & (symbol < 1 << self.depth)
        s = np.where(known, symbol, 0)
        return np.where(known, self.first[s], 0), np.where(known, self.first[s + 1], 0)

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest owner in each (not empty) interval."""
        level = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), np.int32)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.minima[k][lo[at]], self.minima[k][hi[at] - (1 << k)])
        return out


#: Steps after which the patterns still at work are looked at window by window.
STEPS = 160


def long_matches(index: FMIndex, patterns: list[np.ndarray], most: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of ``w`` words of each pattern stand in the index at an owner of at most the pattern's ``most``.

    Returns all patterns' windows one after the other, and where each pattern's begin. Matching statistics from right to
    left: a match grows until its interval empties; if it is long enough and its least owner small enough, it covers its
    windows; the search goes on with the first window to its left. Long matches with larger owners only, and what is left
    of patterns with very many matches, are looked at window by window.
    """
    size = np.array([len(p) for p in patterns], np.int64)
    windows = np.maximum(0, size - w + 1)
    first = np.concatenate([[0], np.cumsum(windows)[:-1]]).astype(np.int64)
    hit = np.zeros(int(windows.sum()), bool)
    if not len(hit):
        return hit, first
    flat = np.concatenate(patterns).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    end, at = size.copy(), size.copy()  # a pattern's match is [at, end)
    lo, hi = np.zeros(len(size), np.int64), np.full(len(size), index.n)
    live = np.flatnonzero(size >= w)
    singly: list[tuple[int, int, int]] = []  # pattern, windows from, to
    for _ in range(STEPS):
        if not len(live):
            break
        more = live[at[live] > 0]
        new_lo, new_hi = index.extend(flat[start[more] + at[more] - 1], lo[more], hi[more])
        grows = new_lo < new_hi
        lo[more[grows]], hi[more[grows]] = new_lo[grows], new_hi[grows]
        at[more[grows]] -= 1
        failed = more[~grows]
        stuck = np.concatenate([live[at[live] == 0], failed])
        if not len(stuck):
            continue
        long = stuck[end[stuck] - at[stuck] >= w]
        if len(long):
            fits = index.least(lo[long], hi[long]) <= most[long]
            for k, a, z, f, ok in zip(long.tolist(), at[long].tolist(), end[long].tolist(), first[long].tolist(), fits.tolist(), strict=True):
                if ok:
                    hit[f + a : f + z - w + 1] = True
                elif z - a > w:
                    singly.append((k, a, z - w + 1))
        # The next window to the left starts just before a long match, or ends one word earlier; but where the word in
        # front doesn't stand in the index at all, or never before the match's first word, no window holds both.
        then = np.where(end[stuck] - at[stuck] >= w, at[stuck] - 1 + w, end[stuck] - 1)
        if len(failed):
            front = start[failed] + at[failed] - 1
            empty = at[failed] == end[failed]
            alone_lo, alone_hi = index.alone(np.where(empty, 0, flat[np.minimum(front + 1, len(flat) - 1)]))
            pair_lo, pair_hi = index.extend(flat[front], alone_lo, alone_hi)
            tail = len(stuck) - len(failed)
            then[tail:] = np.where(empty, at[failed] - 1, np.where(pair_lo >= pair_hi, at[failed], then[tail:]))
        end[stuck] = then
        at[stuck] = then
        lo[stuck], hi[stuck] = 0, index.n
        live = live[end[live] >= w]
    singly += [(k, 0, int(end[k]) - w + 1) for k in live.tolist()]
    if singly:
        k = np.repeat([x[0] for x in singly], [x[2] - x[1] for x in singly])
        s = np.concatenate([np.arange(a, b) for _, a, b in singly])
        lo, hi, left = np.zeros(len(k), np.int64), np.full(len(k), index.n), np.arange(len(k))
        for step in range(w - 1, -1, -1):
            lo, hi = index.extend(flat[start[k[left]] + s[left] + step], lo, hi)
            stays = lo < hi
            lo, hi, left = lo[stays], hi[stays], left[stays]
        left = left[index.least(lo, hi) <= most[k[left]]] if len(left) else left
        hit[first[k[left]] + s[left]] = True
    return hit, first
