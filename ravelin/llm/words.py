"""Word tokens of many texts at once, in numpy: a 64-bit hash, the document and the code-point span of each word.

A word is a maximal run of letters and digits in lower case; an ideograph or kana is a word of its own.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Code points handled at once; a longer text forms a slice of its own, whole.
SLICE = 2_000_000
_R = np.uint64(0x9E3779B97F4A7C15)
_RI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _classes() -> np.ndarray:
    """0: separator, 1: part of a word, 2: a word by itself."""
    out = np.fromiter((chr(i).isalnum() for i in range(0x110000)), np.uint8, 0x110000)
    for a, b in ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)):
        out[a : b + 1] *= 2
    return out


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _R, np.uint64), np.full(n, _RI, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def lower(text: str) -> str:
    """Lower case with every position kept."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokenize(texts: list[str], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the text, start, end), in order; starts and ends are code points within the text.

    With prefixes, hashes have further columns: those of the word's first characters, as many as each prefix says.
    """
    lows = [lower(t) + "\n" for t in texts]
    lens = np.fromiter(map(len, lows), np.int64, len(lows))
    base = np.concatenate(([0], np.cumsum(lens)))
    n = int(base[-1])
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), z, z, z
    cps = np.frombuffer("".join(lows).encode("utf-32-le", "surrogatepass"), "<u4")
    cls = _classes()[cps]
    prev = np.concatenate((np.zeros(1, np.uint8), cls[:-1]))
    starts = np.flatnonzero((cls != 0) & ((prev != 1) | (cls == 2)))
    nxt = np.concatenate((cls[1:], np.zeros(1, np.uint8)))
    ends = np.flatnonzero((cls != 0) & ((nxt != 1) | (cls == 2))) + 1
    size = max(1 << 21, 1 << (n + 1).bit_length())
    up, down = _powers(size)
    t = cps.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    t ^= t >> np.uint64(32)
    t *= up[:n]
    h = np.concatenate((np.zeros(1, np.uint64), np.cumsum(t)))
    hashed = lambda ends: mix((h[ends] - h[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    words = np.stack([hashed(ends), *(hashed(np.minimum(ends, starts + p)) for p in prefixes)], 1) if prefixes else hashed(ends)
    doc = np.searchsorted(base, starts, "right") - 1
    return words, doc, starts - base[doc], ends - base[doc]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Batches cut so that their texts have at most limit code points together, with the texts (null as empty)."""
    for b in batches:
        texts = [t or "" for t in b.column(text).to_pylist()]
        i = 0
        while i < len(texts):
            j, total = i, 0
            while j < len(texts) and (j == i or total + len(texts[j]) <= limit):
                total += len(texts[j])
                j += 1
            yield b.slice(i, j - i), texts[i:j]
            i = j
