"""Elias-Fano coding of monotone sequences, queried in bulk with numpy.

Each value is cut into low bits, stored packed, and a high part, stored in
unary: bit ``high + i`` is set for element ``i``.  About 2 + log2(range / n)
bits an element.  Finding a value is a successor search: the zeros number its
high part delimit the few elements to look at.
"""

from __future__ import annotations

import numpy as np

#: Values encoded at once.
BLOCK = 1 << 18

_ONE = np.uint64(1)
# Bits of every second bit, pair and half byte, of every byte the lowest and the highest.
_PAIRS, _FOURS, _EIGHTS = np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)
_EACH, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _select_table() -> np.ndarray:
    """Place of the r-th one of every byte, by rule."""
    out = np.full((256, 9), 8, np.uint8)
    for byte in range(256):
        for r, bit in enumerate([b for b in range(8) if byte >> b & 1], 1):
            out[byte, r] = bit
    return out


_PLACE = _select_table()


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays that hold a non-decreasing uint64 sequence."""
    n = len(values)
    base = int(values[0]) if n else 0
    span = int(values[-1]) - base if n else 0
    width = max(0, (span // max(1, n)).bit_length() - 1)
    low = np.zeros((n * width >> 6) + 2, np.uint64)
    bits = np.zeros(((span >> width) + n + 1 if n else 2) + 63 >> 6, np.uint64)
    for start in range(0, n, BLOCK):  # neighbours share words, blocks too, so they are combined word by word
        v = values[start:start + BLOCK] - np.uint64(base)
        place = np.arange(start, start + len(v))
        if width:
            part = v & np.uint64((1 << width) - 1)
            at = place.astype(np.uint64) * np.uint64(width)
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[first]] |= np.bitwise_or.reduceat(part << off, first)
            over = off + np.uint64(width) > np.uint64(64)
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - off[over])
        high = (v >> np.uint64(width)).astype(np.int64) + place
        word = high >> 6
        first = np.flatnonzero(np.diff(word, prepend=-1))
        bits[word[first]] |= np.bitwise_or.reduceat(_ONE << (high & 63).astype(np.uint64), first)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
    return {"head": np.array([n, width, base, span >> width], np.uint64), "low": low, "bits": bits, "ones": ones.astype(np.uint32), "zeros": (np.arange(len(ones)) * 64 - ones).astype(np.uint32)}


class EliasFano:
    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.n, self.width, self.base, self.top = (int(x) for x in parts["head"])
        self.low, self.bits, self.ones, self.zeros = (parts[k] for k in ("low", "bits", "ones", "zeros"))

    def __len__(self) -> int:
        return self.n

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th (from 1) one or zero."""
        before = self.ones if one else self.zeros
        k = k.astype(before.dtype)  # else the whole directory is cast
        word = np.searchsorted(before, k, "left") - 1
        x = self.bits[word]
        if not one:
            x = ~x
        r = (k - before[word]).astype(np.uint64)
        # ones up to each byte of a word, side by side in a word
        s = x - ((x >> _ONE) & _PAIRS)
        s = (s & _FOURS) + ((s >> np.uint64(2)) & _FOURS)
        upto = ((s + (s >> np.uint64(4))) & _EIGHTS) * _EACH
        less = (((r * _EACH - _EACH) | _TOPS) - upto) & _TOPS  # bytes up to which there are fewer than r
        shift = np.bitwise_count(less).astype(np.uint64) << np.uint64(3)
        r -= ((upto << np.uint64(8)) >> shift) & np.uint64(255)
        inside = _PLACE[((x >> shift) & np.uint64(255)).astype(np.int64), r.astype(np.int64)]
        return word * 64 + shift.astype(np.int64) + inside

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        rest = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> off) | rest) & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements at the places ``i``."""
        i = np.asarray(i, np.int64)
        high = (self._select(i + 1, True) - i).astype(np.uint64)
        return ((high << np.uint64(self.width)) | self._low(i)) + np.uint64(self.base)

    def ends(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements at the places ``i`` and at the places after them."""
        i = np.asarray(i, np.int64)
        at = self._select(i + 1, True)
        # the next one mostly lies in the same word
        rest = self.bits[at >> 6] >> (at & 63).astype(np.uint64) >> _ONE
        then = at + 1 + np.bitwise_count((rest & (~rest + _ONE)) - _ONE)
        far = np.flatnonzero(rest == 0)
        then[far] = self._select(i[far] + 2, True)
        width, base = np.uint64(self.width), np.uint64(self.base)
        return ((((at - i).astype(np.uint64) << width) | self._low(i)) + base,
                (((then - i - 1).astype(np.uint64) << width) | self._low(i + 1)) + base)

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value, or -1."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        inside = np.flatnonzero(values >= np.uint64(self.base))
        v = values[inside] - np.uint64(self.base)
        high = v >> np.uint64(self.width)
        ok = high <= np.uint64(self.top)
        inside, v, high = inside[ok], v[ok], high[ok].astype(np.int64)
        if not len(v):
            return out
        low = v & np.uint64((1 << self.width) - 1)
        at = np.zeros(len(v), np.int64)
        later = high > 0
        at[later] = self._select(high[later], False) + 1
        begin = at - high
        # the ones from here on are the elements of this high part
        off = (at & 63).astype(np.uint64)
        rest = self.bits[at >> 6] >> off
        n_ones = np.bitwise_count(rest ^ (rest + _ONE)).astype(np.int64) - 1
        end = begin + n_ones
        far = np.flatnonzero(n_ones + off.astype(np.int64) >= 63)  # perhaps beyond the word
        if len(far):
            last = high[far] == self.top
            end[far[last]] = self.n
            far = far[~last]
            end[far] = self._select(high[far] + 1, False) - high[far]
        open_ = np.flatnonzero(begin < end)
        inside, lo, hi, low = inside[open_], begin[open_], end[open_], low[open_]
        limit = hi
        first = lo.copy()
        todo = np.arange(len(lo))
        while len(todo):
            mid = (lo + hi) >> 1
            less = self._low(mid) < low[todo]
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            first[todo] = lo
            still = lo < hi
            todo, lo, hi = todo[still], lo[still], hi[still]
        hit = np.flatnonzero(first < limit)
        hit = hit[self._low(first[hit]) == low[hit]]
        out[inside[hit]] = first[hit]
        return out
