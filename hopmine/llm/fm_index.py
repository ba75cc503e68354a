"""A compressed full-text index over sequences of numbers, and matching statistics by backward search, on many sequences at once."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with counts of ones in front of any place: packed bits and a running count per 64 of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The number of ones in front of each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletTree:
    """Ranks of symbols in a sequence, one bit vector a level; levels are laid out as a wavelet matrix."""

    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[int, Bits, int]] = []
        top = int(symbols.max(initial=0))
        for shift in reversed(range(top.bit_length())):
            one = (symbols >> shift) & 1 == 1
            zeros = len(one) - int(one.sum())
            self.levels.append((shift, Bits(one), zeros))
            symbols = np.concatenate([symbols[~one], symbols[one]])
        every = np.arange(top + 1)
        self.first = self._mapped(every, np.zeros(top + 1, np.int64))

    def _mapped(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbols >> shift) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in front of each place."""
        return self._mapped(symbols, at) - self.first[symbols]


def _suffixes(symbols: np.ndarray, depth: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` symbols at least, and the ranks of all suffixes by their first `half`."""
    rank, n = symbols.astype(np.int64), len(symbols)
    order, kept, length = np.argsort(rank), rank, 1
    while length < depth:
        if length == half:
            kept = rank
        behind = np.zeros(n, np.int64)
        behind[: max(n - length, 0)] = rank[length:] + 1
        key = rank * (int(behind.max(initial=0)) + 1) + behind
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        length *= 2
    return order, kept


class FMIndex:
    """The index of sequences of symbols (from 1 up), each with a number as its owner, for windows of a fixed length.

    It holds the Burrows-Wheeler transform as a wavelet tree, marks where rows begin to differ within window - 1 and
    within window symbols, and the smallest owner of each group of rows that agree on a window. Rows are sorted as deep as
    windows reach, which is as deep as searches go.
    """

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, window: int):
        self.window = window
        lengths = np.array([len(s) + 1 for s in sequences])
        text = np.zeros(int(lengths.sum()), np.int64)
        ends = np.cumsum(lengths)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False  # a separator, 0, ends each sequence
        text[inside] = np.concatenate(sequences)
        half = 1 << ((window - 1).bit_length() - 1) if window > 1 else 1
        order, rank = _suffixes(text, window + 1, half)
        self.tree = WaveletTree(text[order - 1])
        self.start = np.append(0, np.cumsum(np.bincount(text)))[:-1]
        self.rows = len(text)

        def begins(length: int) -> np.ndarray:
            # two suffixes agree on `length` symbols if they agree on the first `half` and on the last `half` of those
            if not length:
                return np.arange(len(order)) == 0
            wide = min(half, length)
            behind = np.zeros(len(order), np.int64)
            behind[: len(order) - (length - wide)] = rank[length - wide :] + 1
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(rank[order]) != 0) | (np.diff(behind[order]) != 0)
            return new

        shorter, whole = begins(window - 1), begins(window)
        self.shorter, self.whole = Bits(shorter), Bits(whole)
        self.shorter_start = np.append(np.flatnonzero(shorter), len(order))
        owner = np.repeat(owners, lengths)
        self.smallest = np.minimum.reduceat(owner[order], np.flatnonzero(whole))

    def _extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of the backward search: the rows that begin with the symbol and go on as the rows low to high do."""
        return tuple(self.start[symbols] + self.tree.rank(symbols, at) for at in (low, high))

    def smallest_owners(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """For every window of each sequence, which must be one of the index, the smallest owner of that window.

        All sequences are read from their ends at once. The statistic kept for a sequence is the rows that its last read
        symbols match, cut at the window's length: before each further symbol it goes back to the rows that agree on all
        but the last symbol of the window.
        """
        window = self.window
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        lengths = np.array([len(sequences[i]) for i in order])
        ends = np.cumsum(lengths)
        flat = np.concatenate([sequences[i] for i in order])
        found = np.full(len(flat), -1, np.int64)
        low, high = np.zeros(len(order), np.int64), np.full(len(order), self.rows, np.int64)
        for step in range(int(lengths.max(initial=0))):
            active = int(np.searchsorted(-lengths, -step))  # sequences longer than step
            at = ends[:active] - 1 - step
            low, high = self._extend(flat[at], low[:active], high[:active])
            if (low >= high).any():
                raise RuntimeError("a sequence of the index wasn't found in it")
            if step >= window - 1:
                found[at] = self.smallest[self.whole.ones(low + 1) - 1]
                group = self.shorter.ones(low + 1) - 1
                low, high = self.shorter_start[group], self.shorter_start[group + 1]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(order)
        for i, end, length in zip(order.tolist(), ends.tolist(), lengths.tolist(), strict=True):
            out[i] = found[end - length : max(end - window + 1, end - length)]
        return out
