"""Elias-Fano code of a non-decreasing sequence, with a sampled select structure."""

from __future__ import annotations

import numpy as np

#: Every so many set bits, the position of one is kept.
SAMPLE = 256


class EliasFano:
    """values[i] is (select1(i) - i) << low | lower bits of i; about 2 + log2(universe / n) bits each.

    The upper bits stand in unary in one bit vector, the lower ones packed in another. A lookup goes to the
    sampled position before it and counts set bits from there.
    """

    def __init__(self, n: int, low: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lower, self.upper, self.samples = n, low, lower, upper, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("values must not decrease")
        low = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        ones = ((values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        upper = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        upper[ones] = 1
        return cls(n, low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(upper, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def select(self, begin: int, end: int) -> np.ndarray:
        """values[begin:end]"""
        end = min(end, self.n)
        if begin >= end:
            return np.zeros(0, np.uint64)
        first = int(self.samples[begin // SAMPLE])
        after = -(-end // SAMPLE)
        last = int(self.samples[after]) if after < len(self.samples) else len(self.upper) * 8
        block = np.unpackbits(self.upper[first // 8 : -(-last // 8)], bitorder="little")
        block[: first % 8] = 0
        ones = np.flatnonzero(block)[begin % SAMPLE : begin % SAMPLE + end - begin] + first // 8 * 8
        high = ones.astype(np.uint64) - np.arange(begin, end, dtype=np.uint64)
        bits = np.unpackbits(self.lower[begin * self.low // 8 : -(-end * self.low // 8)], bitorder="little")
        bits = bits[begin * self.low % 8 :][: (end - begin) * self.low].reshape(end - begin, self.low)
        return high << np.uint64(self.low) | (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low, len(self.lower), len(self.upper), len(self.samples)], dtype="<u8")
        return head.tobytes() + self.lower.tobytes() + self.upper.tobytes() + self.samples.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple["EliasFano", int]:
        """The sequence, and the bytes that it took."""
        n, low, a, b, c = map(int, np.frombuffer(data, "<u8", 5))
        at = 40
        lower = np.frombuffer(data, np.uint8, a, at)
        upper = np.frombuffer(data, np.uint8, b, at + a)
        samples = np.frombuffer(data[at + a + b : at + a + b + 8 * c], "<u8")
        return cls(n, low, lower, upper, samples), at + a + b + 8 * c
