"""Word and word-window fingerprints of many texts at once, in numpy.

The texts of a block are laid end to end as UTF-8 bytes.  Prefix sums of
byte values times powers of an odd base give the polynomial hash of every word
by one subtraction (the base has an inverse modulo 2**64); prefix sums over
words give every window of k words in the same way.  No Python loop runs over
words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words are runs of bytes other than these (space, tab, LF, VT, FF, CR).
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Blocks hold about so many bytes of text; a longer single text is a block of its own.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 65536)
        have = np.full(size, base & _M64, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


_INVERSE = {_BASE: pow(_BASE, -1, 1 << 64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_prints(raw: np.ndarray, start: np.ndarray, step: int = BLOCK_BYTES) -> np.ndarray:
    """A 64-bit fingerprint of each run of bytes from one start to the next, the last one to the end; about `step` bytes are at work at once."""
    values = np.random.default_rng(3).integers(1, 1 << 64, 256, dtype=np.uint64)
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        lo = int(start[at])
        to = max(at + 1, int(np.searchsorted(start, lo + step)))
        hi = int(start[to]) if to < len(start) else len(raw)
        edge = np.append(start[at:to], hi).astype(np.int64) - lo
        sums = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(values[raw[lo:hi]] * _power_table(_BASE, hi - lo), out=sums[1:])
        out[at:to] = mix(np.diff(sums[edge]) * _power_table(_INVERSE[_BASE], hi - lo)[edge[:-1]] + np.diff(edge).astype(np.uint64))
        at = to
    return out


class Words:
    """The words of a block of texts.

    buf: the bytes; start, end: of each word; ptr: words of text i are
    ptr[i] to ptr[i + 1]; hash: a 64-bit fingerprint of each word.
    """

    def __init__(self, texts: list[bytes | None], seed: int = 1):
        raw = b" ".join(t or b"" for t in texts) + b" "
        self.buf = np.frombuffer(raw, dtype=np.uint8)
        self.raw = raw
        word = ~_SPACE[self.buf]
        edge = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0))
        self.start, self.end = edge[0::2], edge[1::2]
        begins = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
        self.ptr = np.searchsorted(self.start, begins)
        values = np.random.default_rng(seed).integers(1, 1 << 64, 256, dtype=np.uint64)
        self.hash = np.empty(len(self.start), dtype=np.uint64)
        at = 0
        while at < len(self.start):  # about a block of bytes is at work at once: its numbers take eight times its room, thrice
            lo = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.start, lo + BLOCK_BYTES)))
            hi = int(self.end[to - 1])
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(values[self.buf[lo:hi]] * _power_table(_BASE, hi - lo), out=sums[1:])
            s, e = self.start[at:to] - lo, self.end[at:to] - lo
            self.hash[at:to] = mix((sums[e] - sums[s]) * _power_table(_INVERSE[_BASE], hi - lo)[s] + (e - s).astype(np.uint64))
            at = to

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, first word) of every k consecutive words of one text."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.hash * _power_table(_BASE, n), out=sums[1:])
        inside = np.ones(n, dtype=bool)
        for back in range(1, k):  # windows that would run past the end of their text
            at = self.ptr[1:] - back
            inside[at[at >= self.ptr[:-1]]] = False
        first = np.flatnonzero(inside)
        return mix((sums[first + k] - sums[first]) * _power_table(_INVERSE[_BASE], n)[first]), first

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts())


def blocks(ids: list, texts: list[bytes | None], size: int = BLOCK_BYTES, most: int = 60000) -> Iterator[tuple[list, list]]:
    """Cut parallel lists into blocks of about `size` bytes and at most `most` texts."""
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if i > begin and (total + n > size or i - begin >= most):
            yield ids[begin:i], texts[begin:i]
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield ids[begin:], texts[begin:]
