"""FM-index over word symbols, with numpy: wavelet-matrix ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


class WaveletMatrix:
    """Rank of any symbol in any prefix of a sequence, in one step for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.levels = len(symbols), []
        now = symbols
        for level in range(bits - 1, -1, -1):
            ones = ((now >> level) & 1).astype(np.uint8)
            words = np.zeros(self.n // 64 + 1, np.uint64)
            packed = np.packbits(ones, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))
            zeros = self.n - int(ones.sum())
            self.levels.append((level, words, before, zeros))
            now = np.concatenate((now[ones == 0], now[ones == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first `at` places."""
        low, high = np.zeros_like(at), at
        for level, words, before, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            a, b = _ones(words, before, low), _ones(words, before, high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low


def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    word = at >> 6
    mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return before[word] + np.bitwise_count(words[word] & mask)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling. Zeros are ends of segments, each smaller than the next, so no
    comparison goes past one; the sequence must end with a zero.

    The first sort takes as many symbols as fit into 63 bits; each further round sorts only suffixes that aren't alone yet.
    """
    n = len(symbols)
    ends = symbols == 0
    code = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + int(ends.sum()))
    bits = max(1, int(code.max()).bit_length())
    key, reach = code, 1
    while (reach + 1) * bits <= 63 and reach < n:
        later = np.zeros(n, np.int64)
        later[: n - reach] = code[reach:]  # what stands behind an end never decides
        key, reach = key << bits | later, reach + 1
    order = np.argsort(key)
    heads = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))  # a group's rank is its first place
    while True:
        open_ = np.flatnonzero(~(heads & np.append(heads[1:], True)))
        if not len(open_):
            return order
        at = order[open_]
        behind = np.where(at + reach < n, rank[np.minimum(at + reach, n - 1)], 0)
        key = rank[at] * n + behind
        way = np.argsort(key)
        at, key = at[way], key[way]
        order[open_] = at
        heads[open_] = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = np.maximum.accumulate(np.where(heads[open_], open_, 0))
        reach *= 2


class FmIndex:
    """Index of segments of positive symbols, each closed by a zero."""

    def __init__(self, symbols: np.ndarray):
        order = suffix_array(symbols)
        last = symbols[order - 1]  # of the first suffix: the closing zero
        self.n, self.size = len(symbols), int(symbols.max(initial=0)) + 1
        self.tree = WaveletMatrix(last, max(1, int(self.size - 1).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=self.size))))
        self.last = last
        self.sampled = (order % SAMPLE_EVERY == 0) | (last == 0)
        self.slot = np.cumsum(self.sampled) - 1
        self.at = order[self.sampled]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range (low, high) of the suffixes that start with each phrase. Phrases are rows, set to the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        live = np.arange(len(phrases))
        for step in range(width):
            live = live[(sizes[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            c = phrases[live, width - 1 - step]
            known = (c > 0) & (c < self.size)
            low[live[~known]] = high[live[~known]] = 0
            live, c = live[known], c[known]
            low[live] = self.first[c] + self.tree.rank(c, low[live])
            high[live] = self.first[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows: walk towards the front until a sampled one."""
        found, steps = np.zeros(len(rows), np.int64), 0
        live, now = np.arange(len(rows)), rows
        while len(live):
            hit = self.sampled[now]
            found[live[hit]] = self.at[self.slot[now[hit]]] + steps
            live, now = live[~hit], now[~hit]
            c = self.last[now].astype(np.int64)
            now = self.first[c] + self.tree.rank(c, now)
            steps += 1
        return found
