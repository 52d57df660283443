"""Monotone integer sequences in Elias-Fano form, with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_ONES = U64(0x0101010101010101)
_SELECT = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    for _k, _bit in enumerate(b for b in range(8) if _byte >> b & 1):
        _SELECT[_byte, _k] = _bit


def encode(values: np.ndarray) -> tuple[dict[str, int], list[np.ndarray]]:
    """Header and word arrays (high bits, ones before each high word, low bits) of a non-decreasing sequence."""
    n = len(values)
    values = values.astype(np.uint64)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    high = (values >> U64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(high[-1]) + 64 if n else 64) // 64 * 64 + 64, np.uint8)
    bits[high] = 1
    words = np.packbits(bits, bitorder="little").view(U64)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.uint64)[:-1]]).astype(np.uint32)
    fields = np.zeros(n * low + 128 - n * low % 64, np.uint8)
    for bit in range(low):
        fields[bit : n * low : low] = values >> U64(bit) & U64(1)
    lows = np.packbits(fields, bitorder="little").view(U64)
    return {"n": n, "low": low}, [words, before, lows]


class Sequence:
    """Reads what encode wrote; the arrays may be memory-mapped."""

    def __init__(self, head: dict[str, int], arrays: list[np.ndarray]) -> None:
        self.n, self.low = head["n"], head["low"]
        self.words, self.before, self.lows = arrays
        self._mask = U64((1 << self.low) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int64)
        word = np.searchsorted(self.before, at.astype(np.uint32), "right") - 1
        bits, k = self.words[word], (at - self.before[word]).astype(np.uint64)
        # ones up to and including each byte of the word
        sums = bits - (bits >> U64(1) & U64(0x5555555555555555))
        sums = (sums & U64(0x3333333333333333)) + (sums >> U64(2) & U64(0x3333333333333333))
        sums = (sums + (sums >> U64(4)) & U64(0x0F0F0F0F0F0F0F0F)) * _ONES
        # the byte that holds one number k: how many byte sums are at most k
        below = ((k * _ONES | _ONES << U64(7)) - sums) >> U64(7) & _ONES
        byte = np.bitwise_count(below).astype(np.uint64)
        shift = byte << U64(3)
        inside = k - (np.where(byte > 0, sums << U64(8), U64(0)) >> shift & U64(0xFF))
        place = _SELECT[(bits >> shift & U64(0xFF)).astype(np.intp), inside.astype(np.intp)]
        high = (word.astype(np.uint64) << U64(6)) + shift + place - at.astype(np.uint64)
        if not self.low:
            return high
        start = at.astype(np.uint64) * U64(self.low)
        w, s = (start >> U64(6)).astype(np.intp), start & U64(63)
        field = self.lows[w] >> s | np.where(s > 0, self.lows[w + 1] << (U64(64) - s & U64(63)), U64(0))
        return high << U64(self.low) | field & self._mask

    def all(self) -> np.ndarray:
        """The whole sequence, read from front to back."""
        high = np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little")) - np.arange(self.n)
        if not self.low or not self.n:
            return high
        start = np.arange(self.n, dtype=np.uint64) * U64(self.low)
        w, s = (start >> U64(6)).astype(np.intp), start & U64(63)
        # a shift in two steps, since one by 64 has no defined result
        field = (self.lows[w] >> s | self.lows[w + 1] << (U64(63) - s) << U64(1)) & self._mask
        return high << self.low | field.view(np.int64)

    def successor(self, begin: np.ndarray, end: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first index in [begin, end) whose value is at least target, else end."""
        lo, hi = begin.astype(np.int64), end.astype(np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            less = self.get(mid) < target[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
