"""FM-index over integer words: wavelet-matrix ranks, sampled suffix positions.

The text is a sequence of codes in which 0 separates runs; phrases hold no 0.
Suffixes are ordered up to the end of their run and by position after that, so
that a step back (LF) keeps the order inside a run.  Positions at run starts
and at every ``STEP``-th place are sampled; a step never crosses a separator.
"""

from __future__ import annotations

import numpy as np

STEP = 8


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Positions in suffix order (prefix doubling); the separators first, by position."""
    n = len(codes)
    pos = np.flatnonzero(codes)
    stops = np.append(np.flatnonzero(codes == 0), n)
    end = stops[np.searchsorted(stops, pos)]
    rank = np.zeros(n + 1, np.int64)
    rank[:n] = codes
    k, groups = 1, -1
    while True:
        ahead = np.where(pos + k < end, rank[np.minimum(pos + k, n)], 0)
        key = rank[pos] * (n + 2 + int(codes.max(initial=0))) + ahead
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(pos) else np.empty(0, int)
        rank[pos[order]] = new
        now = int(new[-1]) if len(new) else 0
        if now == len(pos) or now == groups:
            return np.concatenate((stops[:-1], pos[order]))
        k, groups = 2 * k, now


class Bits:
    """Bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate((packed, np.zeros(8 + -len(packed) % 8, np.uint8)))
        self.words = packed.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))[:-1]

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask).astype(np.int64)


class FMIndex:
    """Index of one shard; all methods work on arrays of queries at once."""

    def __init__(self, codes: np.ndarray):
        codes = np.append(np.asarray(codes, np.int64), 0)  # the last run ends too
        order = suffix_order(codes)
        self.n, top = len(order), int(codes.max(initial=0))
        bwt = np.where(order > 0, codes[order - 1], 0)
        seen = np.bincount(codes, minlength=top + 1)
        self.first = np.concatenate(([0], np.cumsum(seen)))  # rows whose suffix starts with a smaller code
        self.top = top
        self.levels, self.zeros = [], []
        rest = bwt
        for bit in range(max(1, top.bit_length()) - 1, -1, -1):
            ones = (rest >> bit) & 1
            self.levels.append(Bits(ones.astype(bool)))
            self.zeros.append(int(len(rest) - ones.sum()))
            rest = np.concatenate((rest[ones == 0], rest[ones == 1]))
        sampled = (order % STEP == 0) | (bwt == 0)
        self.sampled, self.places = Bits(sampled), order[sampled]

    def rank(self, code: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``code`` is among the first i symbols before the suffixes."""
        start = np.zeros_like(i)
        for depth, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (code >> (len(self.levels) - 1 - depth)) & 1
            a, b = level.rank(start), level.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def back(self, row: np.ndarray) -> np.ndarray:
        """Row of the suffix one place further left (for rows whose symbol before isn't 0)."""
        code, start, i = np.zeros_like(row), np.zeros_like(row), row
        for level, zeros in zip(self.levels, self.zeros):
            one = level.get(i).astype(np.int64)
            a, b = level.rank(start), level.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
            code = code << 1 | one
        return self.first[code] + i - start

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of phrases, one per line, all of one length."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            code = phrases[live, j].astype(np.int64)
            known = (code > 0) & (code <= self.top)
            hi[live[~known]] = lo[live[~known]] = 0
            live, code = live[known], code[known]
            lo[live] = self.first[code] + self.rank(code, lo[live])
            hi[live] = self.first[code] + self.rank(code, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back to a sampled one."""
        row = row.copy()
        steps = np.zeros_like(row)
        todo = np.arange(len(row))
        while len(todo):
            todo = todo[self.sampled.get(row[todo]) == 0]
            row[todo] = self.back(row[todo])
            steps[todo] += 1
        return self.places[self.sampled.rank(row)] + steps
