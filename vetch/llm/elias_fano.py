"""Elias-Fano sequences and an n-gram trie built of them, whose levels are one buffer that is memory-mapped from a file."""

from __future__ import annotations

import numpy as np

#: Steps in which logarithms of probabilities are kept, per power of two; 16 bits reach down to 2 ** -64.
STEPS = 1023
#: Successors that are decoded at a time.
DECODED = 1 << 20


class EliasFano:
    """A sorted sequence of n numbers below a universe, in about 2 + log2(universe / n) bits each.

    Of each number the low bits are packed; the high bits are written in unary, as a one at (high + index). For each 64 bits of that
    vector the ones before it are counted, which makes the k-th one or zero a search among the counts and one word.
    """

    def __init__(self, buffer: np.ndarray):
        head = buffer[:40].view("<u8")
        self.n, self.low_bits, self.words, low, self.bytes = (int(x) for x in head)
        at = 40
        self.low = buffer[at : at + low]
        at += low
        self.high = buffer[at : at + 8 * self.words]
        at += 8 * self.words
        self.ones = buffer[at : at + 4 * (self.words + 1)].view("<u4")

    @staticmethod
    def build(values: np.ndarray, universe: int) -> np.ndarray:
        n = len(values)
        v = values.astype(np.uint64)
        bits = min(56, max(0, (universe // max(1, n)).bit_length() - 1))
        low = (v & np.uint64((1 << bits) - 1)).astype("<u8")
        if bits:
            flat = np.unpackbits(low.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :bits]
            packed = np.packbits(flat.ravel(), bitorder="little")
        else:
            packed = np.zeros(0, np.uint8)
        packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)])
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        words = ((universe >> bits) + n) // 64 + 1
        vector = np.zeros(words * 64, np.uint8)
        vector[ones] = 1
        before = np.concatenate([[0], np.cumsum(vector.reshape(words, 64).sum(axis=1))]).astype("<u4")
        counts = before.view(np.uint8)
        size = 40 + len(packed) + words * 8 + len(counts)
        pad = -size % 8
        head = np.array([n, bits, words, len(packed), size + pad], "<u8").view(np.uint8)
        return np.concatenate([head, packed, np.packbits(vector, bitorder="little"), counts, np.zeros(pad, np.uint8)])

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """The place of the k-th one or zero, counted from 0."""
        before = self.ones.astype(np.int64) if bit else np.arange(self.words + 1) * 64 - self.ones
        word = np.searchsorted(before, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), 1 << 17):
            w = word[a : a + (1 << 17)]
            bits = np.unpackbits(self.high.reshape(-1, 8)[w], axis=1, bitorder="little")
            bits = bits if bit else 1 - bits
            upto = np.cumsum(bits, axis=1, dtype=np.uint8)
            rest = (k[a : a + (1 << 17)] - before[w] + 1).astype(np.uint8)
            out[a : a + (1 << 17)] = w * 64 + (upto < rest[:, None]).sum(axis=1)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, 1) - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self._low(i)

    def span(self, a: int, b: int) -> np.ndarray:
        """The numbers from the a-th up to the b-th, decoded in one sweep."""
        if a >= b:
            return np.zeros(0, np.uint64)
        first = int(np.searchsorted(self.ones, a, side="right")) - 1
        last = int(np.searchsorted(self.ones, b - 1, side="right"))
        ones = np.flatnonzero(np.unpackbits(self.high[8 * first : 8 * last], bitorder="little"))[a - int(self.ones[first]) :][: b - a] + 64 * first
        i = np.arange(a, b)
        return (ones - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        view = np.ndarray((len(self.low) - 7,), "<u8", self.low, strides=(1,))
        return view[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The index of each value, or -1: a search among the numbers with its high bits. Low bits stay below 57."""
        v = values.astype(np.uint64)
        if not self.n or not len(v):
            return np.full(len(v), -1, np.int64)
        high = (v >> np.uint64(self.low_bits)).astype(np.int64)
        low = v & np.uint64((1 << self.low_bits) - 1)
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) - (high - 1), 0)
        end = self._select(high, 0) - high
        while True:  # halve all ranges at once
            open_ = begin < end
            if not open_.any():
                break
            mid = (begin + end) // 2
            less = open_.copy()
            less[open_] = self._low(mid[open_]) < low[open_]
            begin = np.where(less, mid + 1, begin)
            end = np.where(open_ & ~less, mid, end)
        stop = self._select(high, 0) - high
        inside = begin < stop
        hit = np.zeros(len(v), bool)
        hit[inside] = self._low(begin[inside]) == low[inside]
        return np.where(hit, begin, -1)


class Trie:
    """A bigram model's part: the words, their exact counts and back-off weights, pointers to their successors, the successors, and the
    successors' smoothed probabilities, quantised. Six levels in one buffer."""

    def __init__(self, buffer: np.ndarray):
        sizes = buffer[:48].view("<u8").astype(np.int64)
        at, parts = 48, []
        for s in sizes:
            parts.append(buffer[at : at + s])
            at += s
        self.words, self.pointers, self.successors = (EliasFano(parts[k]) for k in (0, 3, 4))
        self.counts, self.back_off, self.probability = parts[1].view("<i8"), parts[2].view("<u2")[: self.words.n], parts[5].view("<u2")[: self.successors.n]

    @staticmethod
    def build(words: np.ndarray, universe: int, counts: np.ndarray, back_off: np.ndarray, contexts: np.ndarray, successors: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """From different words in order, below ``universe``, with counts and back-off weights; and from different pairs in order, of a context's rank among the
        words and a successor of 32 bits, with probabilities. A successor is stored relative to its context, whose rank is put before
        it, which makes all successors one rising sequence."""
        starts = np.searchsorted(contexts, np.arange(len(words) + 1))
        padded = lambda x: np.concatenate([x, np.zeros(-len(x) % 8, np.uint8)])
        levels = [
            EliasFano.build(words, universe),
            counts.astype("<i8").view(np.uint8),
            padded(quantise(back_off).astype("<u2").view(np.uint8)),
            EliasFano.build(starts, len(contexts) + 1),
            EliasFano.build(contexts.astype(np.uint64) << np.uint64(32) | successors.astype(np.uint64), max(1, len(words)) << 32),
            padded(quantise(probability).astype("<u2").view(np.uint8)),
        ]
        return np.concatenate([np.array([*map(len, levels)], "<u8").view(np.uint8), *levels])

    @staticmethod
    def open(file) -> Trie:
        """The trie in a file (a path or an open file), memory-mapped."""
        return Trie(np.memmap(file, np.uint8, "r"))

    def successors_of(self, rank: int) -> tuple[np.ndarray, np.ndarray]:
        """The successors of a word by its rank, read through its pointers, and their probabilities."""
        a, b = self.pointers.get(np.array([rank, rank + 1])).astype(np.int64).tolist()
        return self.successors.span(a, b) & np.uint64(0xFFFFFFFF), dequantise(self.probability[a:b])

    def lookup(self, ranks: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """The quantised probabilities of different pairs (context's rank, successor) in order, 0 where there is none.

        The pointers of the contexts give the ranges of their successors; these are decoded some contexts at a time, and each
        successor is searched among those of its context.
        """
        out = np.zeros(len(ranks), np.uint16)
        if not len(ranks):
            return out
        context, first = np.unique(ranks, return_index=True)
        begin, end = (self.pointers.get(context + k).astype(np.int64) for k in (0, 1))
        first = np.concatenate([first, [len(ranks)]])
        sought = ranks.astype(np.uint64) << np.uint64(32) | successors.astype(np.uint64)
        k = 0
        while k < len(context):
            stop = max(k + 1, int(np.searchsorted(end, begin[k] + DECODED, side="right")))
            a, b = int(begin[k]), int(end[stop - 1])
            known, asked = self.successors.span(a, b), sought[first[k] : first[stop]]
            at = np.searchsorted(known, asked)
            hit = np.flatnonzero(at < len(known))
            hit = hit[known[at[hit]] == asked[hit]]
            out[first[k] + hit] = self.probability[a + at[hit]]
            k = stop
        return out


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit numbers; 0 stands for none."""
    some = p > 0
    return np.where(some, np.clip(np.rint(-np.log2(np.where(some, p, 1.0)) * STEPS), 0, 65534) + 1, 0).astype(np.uint16)


def dequantise(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, np.exp2(-(q.astype(np.float64) - 1) / STEPS), 0.0)
