"""An FM-index over integer words: the Burrows-Wheeler transform in a wavelet matrix of packed bits."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in [0, i)."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class Wavelet:
    """Rank of any symbol, one level for each bit of the symbols, from the highest."""

    def __init__(self, symbols: np.ndarray, largest: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> level & 1, zeros + ones, i - ones)
        return i


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, size = len(text), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - size] = rank[size:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        step = np.zeros(n, np.int64)
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        size *= 2
        if rank[order[-1]] == n - 1 or size >= n:
            return order


class FMIndex:
    """Of several sequences of symbols from 1 up; no match runs from one into the next."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths + 1) - 1
        n = int(lengths.sum() + len(lengths))
        own = np.ones(n, bool)
        own[ends] = False
        self.starts = ends - lengths
        text = np.empty(n, np.int64)
        text[own] = symbols + len(lengths) - 1
        text[ends] = np.arange(len(lengths))  # each end differs, so suffixes part there at the latest
        self.suffixes = suffix_array(text)
        kept = np.zeros(n, np.int64)
        kept[own] = symbols
        last = kept[self.suffixes - 1]
        largest = int(symbols.max(initial=1))
        self.less = np.concatenate([[0], np.cumsum(np.bincount(kept, minlength=largest + 1))])
        self.bwt = Wavelet(last, largest)
        self.zero = self.bwt.place(np.arange(largest + 1), np.zeros(largest + 1, np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the suffixes that begin with symbol before those of [low, high)."""
        both = self.bwt.place(np.concatenate([symbol, symbol]), np.concatenate([low, high])).reshape(2, -1)
        base = self.less[symbol] - self.zero[symbol]
        return base + both[0], base + both[1]

    def whole(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(n, np.int64), np.full(n, len(self.suffixes), np.int64)

    def statistics(self, query: np.ndarray, most: int, ends: np.ndarray | None = None, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics (size, low, high) of a streamed query: for each end in it (all, if none are named) how
        many words up to and with it, ``most`` at most, match in ``least`` places or more, and the suffixes that do.

        All ends go abreast; one leaves as soon as another word would leave too few places.
        """
        ends = np.arange(len(query)) if ends is None else ends
        size = np.zeros(len(ends), np.int64)
        lows, highs = self.whole(len(ends))
        at, low, high = np.arange(len(ends)), lows, highs
        for step in range(most):
            here = ends[at] - step
            symbol = query[here]  # a place before the query reads some word, and is left out
            go = (here >= 0) & (symbol > 0) & (symbol < len(self.zero))
            if not go.all():
                at, low, high, symbol = at[go], low[go], high[go], symbol[go]
            low, high = self.extend(symbol, low, high)
            found = high - low >= least
            at, low, high = at[found], low[found], high[found]
            size[at], lows[at], highs[at] = step + 1, low, high
        return size, lows, highs
