"""Word and shingle hashes over blocks of UTF-8 texts, a block at a time in numpy."""

from __future__ import annotations

import functools

import numpy as np

MULT = 0x9E3779B97F4A7C15 | 1
MASK = 2**64 - 1
#: Bytes of text hashed at a time.
HASH_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
STEP = mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
LENGTH = mix(np.arange(0, 33, dtype=np.uint64) + np.uint64(0x1234567))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, MULT, np.uint64))
        down = np.cumprod(np.full(n, pow(MULT, -1, 2**64), np.uint64))
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(16, (n - 1).bit_length()))
    return up[:n], down[:n]


def words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (a run without the bytes 0x20, 0x09-0x0D) of every text, end to end,
    and the offsets of the texts among them."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=off[1:])
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    up, down = powers(len(buf))
    with np.errstate(over="ignore"):
        value = BYTE[LOWER[buf]] if lower else BYTE[buf]
        total = np.cumsum(value * up)
        before = np.where(start > 0, total[start - 1], np.uint64(0))
        hashes = mix((total[end - 1] - before) * down[start])
    return hashes, np.searchsorted(start, off)


def shingles(texts: list[bytes], n: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of every text and their offsets. A text of fewer words (but one at
    least) has one shingle, its whole sequence; a text without words has none."""
    w, off = words(texts, lower)
    count = np.diff(off)
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, len(w) - n + 1), np.uint64)
        for k in range(n):
            acc += w[k : len(w) - n + 1 + k] * STEP[k] if len(acc) else acc
        full = np.maximum(count - n + 1, 0)
        outs = np.where((count > 0) & (count < n), 1, full)
        out_off = np.concatenate(([0], np.cumsum(outs)))
        out = np.zeros(out_off[-1], np.uint64)
        here = np.arange(out_off[-1]) - np.repeat(out_off[:-1] - off[:-1], outs)
        long = np.repeat(count >= n, outs)
        out[long] = acc[here[long]] + LENGTH[n]
        for t in np.flatnonzero((count > 0) & (count < n)).tolist():
            m = int(count[t])
            out[out_off[t]] = np.add.reduce(w[off[t] : off[t + 1]] * STEP[:m]) + LENGTH[m]
    return mix(out), out_off
