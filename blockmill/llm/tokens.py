"""Vectorised words, hashes and shingles of many texts at once."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

U = np.uint64
#: Multipliers of the 64-bit mixing steps; any odd numbers with well spread bits do.
MUL_A, MUL_B, MUL_C = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xC2B2AE3D27D4EB4F)
#: ASCII white space, the only characters that part words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits.
MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Bytes of a word above which one call hashes it whole.
LONG = 64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * MUL_B
    x = (x ^ (x >> U(29))) * MUL_C
    return x ^ (x >> U(32))


@dataclass
class Words:
    """Words of several texts: byte ranges in buf; words bounds[i]:bounds[i + 1] are those of text i."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    text_start: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(texts: list[bytes], lower: bool = True, parts: np.ndarray = WHITE) -> Words:
    joined = b"\n" + b"\n".join(texts) + b"\n" + b" " * 16
    if lower:
        joined = joined.lower()  # of bytes: A-Z only
    buf = np.frombuffer(joined, np.uint8)
    white = parts[buf[: len(buf) - 15]]
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    text_start = np.cumsum([1, *[len(x) + 1 for x in texts]])
    return Words(buf, start, end, np.searchsorted(start, text_start), text_start)


def hashes(w: Words) -> np.ndarray:
    """64-bit hash of each word, eight bytes of all words at a time; equal on every machine."""
    wide = np.ndarray(len(w.buf) - 7, np.dtype("<u8"), w.buf, strides=(1,))
    left = w.end - w.start
    h = mix((wide[w.start] & _MASKS[np.minimum(left, 8)]) + left.astype(np.uint64) * MUL_A)
    for i in np.flatnonzero(left > LONG):
        word = w.buf[w.start[i] : w.end[i]].tobytes()
        h[i], left[i] = U(int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")), 0
    at, rest = w.start + 8, np.flatnonzero(left > 8)
    while len(rest):
        size = left[rest] - 8
        h[rest] = mix(h[rest] * MUL_A + (wide[at[rest]] & _MASKS[np.minimum(size, 8)]))
        left[rest], at[rest] = size, at[rest] + 8
        rest = rest[size > 8]
    return h


def shingles(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words inside each text, in order, and their bounds.

    A text of fewer words, but one at least, has one shingle: its whole sequence.
    """
    n = np.diff(bounds)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    out = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(bounds[:-1] - out[:-1], count) + np.arange(out[-1])
    long = np.repeat(n >= size, count)
    x = np.full(out[-1], MUL_C, np.uint64)
    at = first[long]
    y = x[long]
    for k in range(size):
        y = mix(y * MUL_A + h[at + k])
    x[long] = y
    for i in np.flatnonzero((n > 0) & (n < size)):
        z = np.array([U(n[i])]) * MUL_B
        for v in h[bounds[i] : bounds[i + 1]]:
            z = mix(z * MUL_A + v)
        x[out[i]] = z[0]
    return x, out


def distinct(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values within each range, and their bounds."""
    x = x.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        x[a:b].sort()
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    counts = np.concatenate(([0], np.cumsum(keep)))
    return x[keep], counts[bounds]
