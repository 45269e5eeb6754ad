"""Non-decreasing integers in near-minimal space, with the k-th one found through a select structure.

A value v of ``n`` values up to ``top`` is cut into ``low`` lower bits, kept packed, and a high part h, kept as a one at
place h + k of a bit string. That takes about 2 + log2(top / n) bits a value. The k-th value needs the place of the
k-th one: every ``STEP``-th place is stored in 32 bits, and from there words are counted on by their population.

Layout, little endian: n, top, low (unsigned 64, 64, 8), words of lower bits, words of the bit string, stored places.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
_HEAD = struct.Struct("<QQB7x")
#: Rows handled at once where a row takes 64 bits apart.
_AT_ONCE = 1 << 15


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits as 64-bit words, first bit lowest, with one word to spare."""
    raw = np.packbits(bits, bitorder="little")
    out = np.zeros(len(raw) // 8 + 2, np.uint64)
    out.view(np.uint8)[: len(raw)] = raw
    return out


class EliasFano:
    def __init__(self, n: int, top: int, low: int, lower: np.ndarray, upper: np.ndarray, places: np.ndarray):
        self.n, self.top, self.low, self.lower, self.upper, self.places = n, top, low, lower, upper, places

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        if n and (v[1:] < v[:-1]).any():
            raise ValueError("the values must not decrease")
        low = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low, dtype=np.uint64)
        bits = [((v[s : s + _AT_ONCE, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel() for s in range(0, n, _AT_ONCE)]
        at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        if n and at[-1] >= 2**32:
            raise ValueError("the bit string is longer than 32-bit places reach; write smaller files")
        upper = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        upper[at] = 1
        return cls(n, top, low, _packed(np.concatenate([*bits, np.zeros(0, np.uint8)])), _packed(upper), at[::STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.top, self.low) + self.lower.tobytes() + self.upper.tobytes() + self.places.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, top, low = _HEAD.unpack_from(data)
        bits = (n + (top >> low)) if n else 0
        sizes = [(-(-n * low // 8)) // 8 + 2, (-(-bits // 8)) // 8 + 2]
        lower = np.frombuffer(data, np.uint64, sizes[0], _HEAD.size)
        upper = np.frombuffer(data, np.uint64, sizes[1], _HEAD.size + 8 * sizes[0])
        places = np.frombuffer(data, np.uint32, -(-n // STEP), _HEAD.size + 8 * sum(sizes))
        return cls(n, top, low, lower, upper, places)

    def _select(self, k: np.ndarray) -> np.ndarray:
        """Places of the k-th ones."""
        start = self.places[k // STEP].astype(np.int64)
        left = k % STEP
        word, offset = start >> 6, (start & 63).astype(np.uint64)
        here = (self.upper[word] >> offset) << offset
        found = np.bitwise_count(here).astype(np.int64)
        ahead = np.flatnonzero(found <= left)
        while len(ahead):
            left[ahead] -= found[ahead]
            word[ahead] += 1
            here[ahead] = self.upper[word[ahead]]
            found[ahead] = np.bitwise_count(here[ahead])
            ahead = ahead[found[ahead] <= left[ahead]]
        ones = np.unpackbits(here.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = (np.cumsum(ones, axis=1) == left[:, None] + 1).argmax(axis=1)
        return word * 64 + inside

    def get(self, k: np.ndarray) -> np.ndarray:
        """The values numbered ``k``, from 0."""
        k = np.asarray(k, np.int64)
        if len(k) and (k.min() < 0 or k.max() >= self.n):
            raise IndexError("no such value")
        out = np.empty(len(k), np.uint64)
        for s in range(0, len(k), _AT_ONCE):
            part = k[s : s + _AT_ONCE]
            high = (self._select(part) - part).astype(np.uint64)
            bit = part * self.low
            word, offset = bit >> 6, (bit & 63).astype(np.uint64)
            lower = self.lower[word] >> offset
            over = offset + np.uint64(self.low) > np.uint64(64)
            lower[over] |= self.lower[word[over] + 1] << (np.uint64(64) - offset[over])
            mask = np.uint64((1 << self.low) - 1)
            out[s : s + _AT_ONCE] = (high << np.uint64(self.low)) | (lower & mask)
        return out
