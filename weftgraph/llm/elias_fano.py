"""Elias-Fano sequences and a trie of them, in flat buffers that can be mapped into memory.

A sequence keeps the low bits of its ascending numbers packed, and their high parts in unary. It answers by
successor search: the place of the first number that is no less than a given one. A level of the trie holds the children of
each node as such numbers, counted on from the last child of the node before, so that one sequence serves all nodes, and
monotone pointers tell where a node's children begin.

All searches are for whole arrays at once. Buffers are little-endian 64-bit words; a view of them is all that opening needs, so
bytes from a table and ``numpy.memmap`` of a file serve alike.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def words_of(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, with a spare one at the end."""
    raw = np.packbits(bits, bitorder="little")
    out = np.zeros((len(raw) + 7) // 8 + 1, U)
    out.view(np.uint8)[: len(raw)] = raw
    return out


class Ascending:
    """An ascending sequence of numbers below 2**63."""

    def __init__(self, words: np.ndarray, at: int = 0):
        n, low, highs, lows = (int(x) for x in words[at : at + 4])
        self.n, self.low = n, U(low)
        a = at + 4
        bits = np.unpackbits(words[a : a + highs].view(np.uint8), bitorder="little")
        ones = np.flatnonzero(bits)
        self.high = ones - np.arange(n)  # high part of each number
        zeros = np.flatnonzero(bits[: (ones[-1] if n else -1) + 2] == 0)
        self.starts = np.concatenate([[0], zeros - np.arange(len(zeros))])  # the first number of each high part
        self.lows = words[a + highs : a + highs + lows]
        self.end = a + highs + lows

    @staticmethod
    def pack(values: np.ndarray) -> np.ndarray:
        values = np.asarray(values, U)
        n = len(values)
        low = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        high = (values >> U(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 2 if n else 1, np.uint8)
        bits[high] = 1
        lows = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :low]
        h, w = words_of(bits), words_of(lows.ravel())
        return np.concatenate([np.array([n, low, len(h), len(w)], U), h, w])

    def low_of(self, i: np.ndarray) -> np.ndarray:
        bit = i.astype(U) * self.low
        at, shift = (bit >> U(6)).astype(np.int64), bit & U(63)
        both = (self.lows[at] >> shift) | ((self.lows[np.minimum(at + 1, len(self.lows) - 1)] << U(1)) << (U(63) - shift))
        return both & ((U(1) << self.low) - U(1))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.high[i].astype(U) << self.low) | self.low_of(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first number that is x or more; n where there is none."""
        x = np.asarray(x, U)
        part = (x >> self.low).astype(np.int64)
        last = len(self.starts) - 1
        part = np.minimum(part, last, out=part)
        lo, hi = self.starts[part], self.starts[np.minimum(part + 1, last)]
        lo[part == last] = self.n
        hi[part == last] = self.n
        want = x & ((U(1) << self.low) - U(1))
        at = np.flatnonzero(lo < hi)
        a, b, w = lo[at], hi[at], want[at]
        while len(at):  # halve what is left of each high part
            mid = (a + b) >> 1
            less = self.low_of(mid) < w
            a, b = np.where(less, mid + 1, a), np.where(less, b, mid)
            done = a >= b
            lo[at[done]] = a[done]
            at, a, b, w = at[~done], a[~done], b[~done], w[~done]
        return lo

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of x, or -1."""
        i = self.successor(x)
        out = np.full(len(i), -1, np.int64)
        inside = np.flatnonzero(i < self.n)
        hit = inside[self[i[inside]] == np.asarray(x, U)[inside]]
        out[hit] = i[hit]
        return out


class Children:
    """A level: the children of each node, ascending within it, found by successor search relative to the node's base."""

    def __init__(self, words: np.ndarray, at: int = 0):
        self.pointers = Ascending(words, at)
        self.values = Ascending(words, self.pointers.end)
        self.end = self.values.end

    @staticmethod
    def pack(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """``sizes``: the number of children of each node; ``values``: all children, node by node."""
        ends = np.cumsum(sizes)
        values = np.asarray(values, U)
        last = np.zeros(len(sizes), U)
        last[sizes > 0] = values[ends[sizes > 0] - 1] + U(1)
        base = np.concatenate([np.zeros(min(1, len(sizes)), U), np.cumsum(last)[:-1]])
        return np.concatenate([Ascending.pack(np.concatenate([[0], ends])), Ascending.pack(values + np.repeat(base, sizes))])

    def find(self, node: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The place of a child over all nodes, or -1; -1 also where the node is -1."""
        out = np.full(len(node), -1, np.int64)
        some = np.flatnonzero(node >= 0) if self.values.n else np.zeros(0, np.int64)
        nodes, which = np.unique(node[some], return_inverse=True)
        a, b = self.pointers[nodes].astype(np.int64), self.pointers[nodes + 1].astype(np.int64)
        base = np.where(a > 0, self.values[np.maximum(a - 1, 0)] + U(1), U(0)) if len(nodes) else np.zeros(0, U)
        b = b[which]
        x = base[which] + np.asarray(child)[some].astype(U)
        i = self.values.successor(x)
        near = np.flatnonzero(i < b)
        hit = near[self.values[i[near]] == x[near]]
        out[some[hit]] = i[hit]
        return out

    def first(self, node: np.ndarray) -> np.ndarray:
        return self.pointers[node].astype(np.int64)


def packed_codes(codes: np.ndarray) -> np.ndarray:
    """16-bit codes as words, their count first."""
    out = np.zeros((len(codes) + 3) // 4 + 1, U)
    out[0] = len(codes)
    out[1:].view(np.uint16)[: len(codes)] = codes
    return out


def codes_at(words: np.ndarray, at: int) -> tuple[np.ndarray, int]:
    n = int(words[at])
    end = at + 1 + (n + 3) // 4
    return words[at + 1 : end].view(np.uint16)[:n], end
