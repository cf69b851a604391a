"""FM-index over a sequence of small integers, with numpy throughout."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of non-negative symbols in order; a suffix that is a prefix of another comes first.

    The first sort takes as many symbols as fit a 62-bit key; prefix doubling then goes on among suffixes that are still equal.
    """
    n = len(seq)
    if n < 2:
        return np.arange(n)
    seq = np.asarray(seq, np.int64) + 1
    bits = int(seq.max()).bit_length()
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: max(0, n - k)] |= seq[k:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # place of the first of its equals
    while True:
        at = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
        if not len(at):
            return order
        some = order[at]
        behind = some + step
        key = rank[some] * (n + 1) + np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        some, key = some[by], key[by]
        order[at] = some
        first[at] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[some] = np.maximum.accumulate(np.where(first[at], at, 0))
        step *= 2


class FMIndex:
    """Count and locate phrases by backward search.

    ``seq`` holds symbols from 1; a final 0 is added. The Burrows-Wheeler transform is kept in a wavelet matrix whose
    levels carry prefix sums of bits, so a rank is two look-ups a level. Every ``sample``-th text position keeps its
    suffix-array entry; others are found by walking back to one.
    """

    def __init__(self, seq: np.ndarray, sample: int = 8):
        seq = np.concatenate([np.asarray(seq, np.int64), [0]])
        n = len(seq)
        order = suffix_array(seq)
        bwt = seq[order - 1]
        self.n, self.bits = n, max(1, int(seq.max()).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=(1 << self.bits)))])
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.concatenate(([0], np.cumsum(bit))).astype(np.int32)
            self.levels.append((bit.astype(bool), ones, int(n - ones[-1])))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.marked = order % sample == 0
        self.marks_before = np.concatenate(([0], np.cumsum(self.marked))).astype(np.int32)
        self.samples = order[self.marked]

    def _step(self, symbol: np.ndarray, *rows: np.ndarray) -> list[np.ndarray]:
        """For each row bound: the first row of the symbol's range plus its rank before the bound."""
        zero, rows = np.zeros(len(symbol), np.int64), list(rows)
        for k, (_, ones, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            move = lambda r, one=one, ones=ones, zeros=zeros: np.where(one, zeros + ones[r], r - ones[r])
            zero, rows = move(zero), [move(r) for r in rows]
        return [self.first[symbol] + r - zero for r in rows]

    def _back(self, rows: np.ndarray) -> np.ndarray:
        """LF mapping: the row of the suffix that starts one symbol earlier."""
        symbol, at = np.zeros(len(rows), np.int64), rows
        zero_of = np.zeros(len(rows), np.int64)
        for bit, ones, zeros in self.levels:
            one = bit[at]
            symbol = symbol * 2 + one
            at = np.where(one, zeros + ones[at], at - ones[at])
            zero_of = np.where(one, zeros + ones[zero_of], zero_of - ones[zero_of])
        return self.first[symbol] + at - zero_of

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that start with each phrase; ``phrases`` is padded on the right."""
        m = len(lengths)
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        low[lengths == 0] = high[lengths == 0] = 0
        live = np.flatnonzero(lengths > 0)
        for back in range(int(lengths.max(initial=0))):
            live = live[(lengths[live] > back) & (high[live] > low[live])]
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - back].astype(np.int64)
            known = symbol < (1 << self.bits)
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live], high[live] = self._step(symbol, low[live], high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, rows, open_, steps = np.empty(len(rows), np.int64), rows.astype(np.int64).copy(), np.arange(len(rows)), 0
        while len(open_):
            hit = self.marked[rows[open_]]
            done = open_[hit]
            out[done] = self.samples[self.marks_before[rows[done]]] + steps
            open_ = open_[~hit]
            rows[open_] = self._back(rows[open_])
            steps += 1
        return out
