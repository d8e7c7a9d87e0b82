"""Rabin-Karp hashes of the words of whole batches, and of all their windows, in NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import common

#: Odd multipliers modulo 2**64: of bytes in a word, of words in a window, of words in a shorter one.
BYTES, WINDOW, GRAM = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes, or words, hashed at a time, so that a long text needs little more memory than its words.
STEP = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
common.CACHES.append(_powers.clear)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[:1] = 1
            out.append(np.multiply.accumulate(x))
        _powers[base] = tuple(out)
    up, down = _powers[base]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads what polynomial hashes leave regular."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of a batch of texts: document, first byte, end and hash of each, in order."""

    def __init__(self, texts: pa.Array, table: np.ndarray | None = None):
        """table: what each byte counts as, such as a space for a sign that parts words."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        self.data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.data = self.data if table is None else table[self.data]
        self.offsets = offsets - offsets[0]
        space = IS_SPACE[self.data]
        if len(space):
            first = ~space
            last = first.copy()
            first[1:] &= space[:-1]
            last[:-1] &= space[1:]
            edges = self.offsets[:-1][np.diff(self.offsets) > 0]
            first[edges] = ~space[edges]
            edges = self.offsets[1:][np.diff(self.offsets) > 0] - 1
            last[edges] = ~space[edges]
            self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, self.offsets)  # of each document, and their number
        self.hash = np.zeros(len(self.starts), np.uint64)
        at = 0
        while at < len(self.hash):
            begin = int(self.starts[at])
            to = max(at + 1, int(np.searchsorted(self.ends, begin + STEP, "right")))
            if self.ends[to - 1] - begin > STEP:
                self.hash[at] = self.long_word(begin, int(self.ends[at]))
            else:
                sums, down = self.sums(begin, int(self.ends[to - 1]))
                own = self.starts[at:to] - begin
                self.hash[at:to] = (sums[self.ends[at:to] - begin] - sums[own]) * down[own]
            at = to
        self.hash = mix(self.hash)

    def sums(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = powers(BYTES, end - begin + 1)
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum((self.data[begin:end].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return sums, down

    def long_word(self, begin: int, end: int) -> np.uint64:
        parts = (int(self.sums(a, min(end, a + STEP))[0][-1]) * pow(BYTES, a - begin, 1 << 64) for a in range(begin, end, STEP))
        return np.uint64(sum(parts) & (1 << 64) - 1)

    def windows(self, k: int, base: int) -> np.ndarray:
        """Hash of the k words from each word on; those that would leave the document count only where `whole`."""
        out = np.zeros(max(0, len(self.hash) - k + 1), np.uint64)
        for at in range(0, len(out), STEP):
            own = self.hash[at : at + STEP + k - 1]
            up, down = powers(base, len(own) + 1)
            sums = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(own * up[:-1], out=sums[1:])
            out[at : at + STEP] = mix((sums[k:] - sums[:-k]) * down[: len(own) - k + 1])
        return out

    def whole(self, k: int) -> np.ndarray:
        """Words from which a window of k words stays in its document."""
        n = len(self.doc)
        return np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :]) if n >= k else np.zeros(0, np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x
