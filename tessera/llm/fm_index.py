"""An FM-index over word ids: BWT in a wavelet matrix, searched backwards for many patterns at a time.

Compressed to log2(different words) bits a word for the text, half a bit a level for ranks and, for weights, 32 bits a word
(64 if they add up to over 2**32); the suffix array is not kept.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text`` (small non-negative ints, the last one unique and least), by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    width = 1
    while int(rank.max(initial=0)) < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        width *= 2
    return order


class WaveletMatrix:
    """Bits of a sequence level by level, with ranks by popcount: n bits and n/2 bits of counts a level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        now = sequence.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(np.uint8)
            packed = np.packbits(np.pad(bit, (0, -len(bit) % 64 + 64)), bitorder="little").view("<u8")
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))]).astype(np.uint32))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.first = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, (bits, counts, zeros) in enumerate(zip(self.bits, self.counts, self.zeros, strict=True)):
            at = place >> 6
            ones = counts[at].astype(np.int64) + np.bitwise_count(bits[at] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)))
            place = np.where(symbol >> (self.levels - 1 - level) & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, place) - self.first[symbol]


class FmIndex:
    """Index of weighted word sequences (lists of ids from 0 on); matches never cross a sequence's end."""

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray, n_words: int):
        self.n_words = n_words
        size = np.fromiter(map(len, sequences), np.int64, len(sequences)) + 1
        text = np.ones(int(size.sum()) + 1, np.int64)  # 0 ends the text, 1 ends a sequence, words come from 2 on
        ends = np.cumsum(size)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = inside[-1] = False
        if len(sequences):
            text[inside] = np.concatenate(sequences) + 2
        text[-1] = 0
        order = suffix_array(text)
        self.matrix = WaveletMatrix(text[order - 1], n_words + 2)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_words + 2))])
        weight = np.concatenate([np.repeat(np.asarray(weights, np.int64), size), [0]])
        total = np.concatenate([[0], np.cumsum(weight[order])])
        self.weight = total.astype(np.uint32) if total[-1] < 1 << 32 else total

    def matches(self, stream: np.ndarray, ends: np.ndarray, length: int, least: int = 2, indexed: bool = False) -> np.ndarray:
        """Capped matching statistics: for each end place in ``stream`` (word ids, -1: not in the index), the weighted
        number of occurrences of the ``length`` words that end there, or 0 as soon as a suffix of them has fewer than ``least``.

        Backward search of all ends in step; an end whose interval grows too light is dropped.  If the streamed
        sequences are themselves in the index (``indexed``), an interval of one suffix is the words' own occurrence and
        stays it, so the search of that end is over.
        """
        out = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.weight) - 1, np.int64)
        for step in range(length):
            word = stream[ends[live] - step]
            known = word >= 0
            live, low, high, word = live[known], low[known], high[known], word[known] + 2
            start = self.before[word]
            both = start + self.matrix.rank(np.concatenate([word, word]), np.concatenate([low, high])).reshape(2, -1)
            heavy = self.weight[both[1]] - self.weight[both[0]] >= least
            live, low, high = live[heavy], both[0][heavy], both[1][heavy]
            if indexed:
                wide = high - low > 1
                if not wide.all():
                    own = ~wide
                    out[live[own]] = self.weight[high[own]] - self.weight[low[own]]
                    live, low, high = live[wide], low[wide], high[wide]
            if not len(live):
                return out
        out[live] = self.weight[high] - self.weight[low]
        return out
