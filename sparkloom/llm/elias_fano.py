"""Elias-Fano code of a non-decreasing sequence: about 2 + log2(last / n) bits a number, with random access.

The low bits of each number stand packed one after another; the high parts stand in unary, number i as a one at
position high(i) + i. select(i) finds the i-th one: every SAMPLE-th one's place is kept, and the bytes behind it are
counted.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Ones of each byte, and the place of its k-th one.
_ONES = _BITS.sum(1)
_NTH = np.zeros((256, 8), np.int64)
for _byte, _bits in enumerate(_BITS):
    _NTH[_byte, : _ONES[_byte]] = np.flatnonzero(_bits)
_HEAD = struct.Struct("<QQB")


class EliasFano:
    def __init__(self, n: int, last: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.last, self.low_bits, self.low, self.high, self.samples = n, last, low_bits, low, high, samples

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        numbers = np.asarray(numbers, np.uint64)
        n, last = len(numbers), int(numbers[-1]) if len(numbers) else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        shift = np.uint64(low_bits)
        cut = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((numbers[:, None] >> cut) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (numbers >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros((last >> low_bits) + n + 1, np.uint8)
        bits[ones] = 1
        return cls(n, last, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.last, self.low_bits) + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, last, low_bits = _HEAD.unpack_from(data)
        a = _HEAD.size
        b = a + 4 * -(-n // SAMPLE)
        c = b + -(-n * low_bits // 8)
        raw = np.frombuffer(data, np.uint8)
        return cls(n, last, low_bits, raw[b:c], raw[c:], np.frombuffer(data[a:b], "<u4"))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        """The low bits of numbers i."""
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)

    def select(self, i):
        """Number i of the sequence, or numbers i for an array of places.

        From the sampled one before it, whole bytes of the high bits are passed by their counts of ones, and a table tells the
        place within the byte.
        """
        at = np.atleast_1d(np.asarray(i, np.int64))
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError(i)
        out = np.empty(len(at), np.int64)
        for a in range(0, len(at), 1 << 16):
            out[a : a + (1 << 16)] = self._select(at[a : a + (1 << 16)])
        return int(out[0]) if np.ndim(i) == 0 else out

    def _select(self, at: np.ndarray) -> np.ndarray:
        sample = self.samples[at // SAMPLE].astype(np.int64)
        first, last = int(sample.min()) >> 3, len(self.high)
        beyond = int(at.max()) // SAMPLE + 1
        if beyond < len(self.samples):
            last = (int(self.samples[beyond]) >> 3) + 1
        ones = np.concatenate(([0], np.cumsum(_ONES[self.high[first:last]], dtype=np.int64)))  # before each byte
        # Ones before the first byte: those before the first sample less those that share its byte.
        low = int(at.min()) // SAMPLE
        inside = int(self.high[first] & ((1 << (int(self.samples[low]) & 7)) - 1)).bit_count()
        rank = at - (low * SAMPLE - inside)
        byte = np.searchsorted(ones, rank, "right") - 1
        place = _NTH[self.high[first + byte], rank - ones[byte]]
        return ((8 * (first + byte) + place - at) << self.low_bits) | self._lows(at)
