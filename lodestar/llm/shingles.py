"""Hashed words and word shingles of Arrow text columns, without a Python object per word.

Words are runs of bytes other than ASCII white space. A word's hash is that of its bytes as a number
in a random odd base modulo 2^64, from prefix sums over the whole column, and then finalised.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

SIZE = 5

STEP = np.uint64(0x9E3779B97F4A7C15)
FACTOR = np.uint64(0xD6E8FEB86659FD93)
BASE = 0x5851F42D4C957F2D

#: Bytes whose words are hashed together; a longer word is hashed alone.
BLOCK = 1 << 17

KIND = np.zeros(256, "uint8")  # 1: white space, 2: line feed
KIND[[9, 11, 12, 13, 32]] = 1
KIND[10] = 2


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, 2^bits of each."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        found = np.ones(1, "uint64")
        while len(found) < 1 << bits:
            found = np.concatenate((found, found * np.uint64(pow(base, len(found), 1 << 64))))
        out.append(found)
    return out[0], out[1]


class Words:
    """All words of a text column in order: hash, doc (row) and line (line feeds before it in its row)."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        rows = len(texts)
        _, offsets, data = texts.buffers()
        starts = np.frombuffer(offsets, "int64")[texts.offset : texts.offset + rows + 1] if rows else np.zeros(1, "int64")
        raw = np.frombuffer(data, "uint8")[starts[0] : starts[-1]] if data is not None and starts[-1] > starts[0] else np.empty(0, "uint8")
        starts = starts - starts[0]
        kind = KIND[raw]
        word = np.append(kind == 0, False)
        edge = np.empty(len(raw), bool)  # where a word begins
        if len(raw):
            edge[0] = word[0]
            edge[1:] = word[1:-1] & ~word[:-2]
            inner = starts[1:-1][starts[1:-1] < len(raw)]
            edge[inner] = word[inner]
        begin = np.flatnonzero(edge)
        stop = word[:-1] & ~word[1:]  # where one ends
        if len(raw) and rows > 1:
            cut = starts[1:-1]
            cut = cut[(cut > 0) & (cut <= len(raw))] - 1
            stop[cut] = word[cut]
        end = np.flatnonzero(stop) + 1
        self.hash = np.empty(len(begin), "uint64")
        k = 0
        while k < len(begin):  # words of some bytes at once, which bounds the prefix sums
            stop = max(k + 1, int(np.searchsorted(end, begin[k] + BLOCK, side="right")))
            own = raw[begin[k] : end[stop - 1]]
            up, down = powers(max(18, int(len(own)).bit_length()))
            sums = np.zeros(len(own) + 1, "uint64")
            np.cumsum((own.astype("uint64") + np.uint64(1)) * up[: len(own)], out=sums[1:])
            a, b = begin[k:stop] - begin[k], end[k:stop] - begin[k]
            self.hash[k:stop] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype("uint64"))
            k = stop
        self.rows = rows
        self.doc = np.searchsorted(starts[1:], begin, side="right")
        feeds = np.flatnonzero(kind == 2)
        self.line = np.searchsorted(feeds, begin) - np.searchsorted(feeds, starts[:-1])[self.doc]


def windows(words: np.ndarray, group: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words within equal neighbours of ``group``, and their groups."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, "uint64"), np.empty(0, group.dtype)
    found = words[:n].copy()
    for k in range(1, size):
        found *= FACTOR
        found += words[k : n + k]
    inside = group[:n] == group[size - 1 :]
    return mix(found[inside] + np.uint64(size)), group[:n][inside]


def bags(texts: pa.Array, size: int = SIZE) -> list[np.ndarray]:
    """Per row the hashes of its word shingles, sorted, with repeats; of all its words, if they are fewer."""
    words = Words(texts)
    counts = np.bincount(words.doc, minlength=words.rows) if words.rows else np.empty(0, "int64")
    found, owner = windows(words.hash, words.doc, size)
    ends = np.searchsorted(owner, np.arange(words.rows + 1))
    begin = np.cumsum(counts) - counts
    out = []
    for k in range(words.rows):
        if counts[k] >= size:
            bag = found[ends[k] : ends[k + 1]]
            bag.sort()
        else:
            own = words.hash[begin[k] : begin[k] + counts[k]]
            bag = own[:1].copy()
            for w in own[1:]:
                bag = bag * FACTOR + w
            bag = mix(bag + np.uint64(counts[k]))
        out.append(bag)
    return out


def as_set(bag: np.ndarray) -> np.ndarray:
    """A sorted multiset as a sorted set: the k-th copy of a hash becomes a hash of its own."""
    if len(bag) > 1 and (bag[1:] == bag[:-1]).any():
        copy = (np.arange(len(bag)) - np.searchsorted(bag, bag)).astype("uint64")
        bag = np.sort(np.where(copy > 0, mix(bag + copy * STEP), bag))
    return bag


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())
