"""Hashed character n-grams of whole texts, computed on arrays of code points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

SPACE = 32
_BASE = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The top ``bits`` of mixed 64-bit hashes."""
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(_MIX)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def grams(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, bucket) of the n-grams of each size; words are separated by one space, and a gram has none inside.

    A space may begin or end a gram, as the border of a word; a gram is never a space alone.
    """
    wide = points.astype(np.uint64) + np.uint64(1)
    spaces = np.concatenate(([0], np.cumsum(points == SPACE, dtype=np.int32)))
    hashes, n = np.zeros(len(points), np.uint64), 0
    for size in range(1, max(sizes) + 1):
        count = len(points) - size + 1
        if count <= 0:
            return
        power = np.uint64(pow(_BASE, size, 1 << 64))
        hashes, n = hashes[:count] + wide[size - 1:] * power, size
        if size not in sizes:
            continue
        if size <= 2:
            inside = (spaces[size: size + count] - spaces[:count]) < size
        else:
            inside = spaces[size - 1: size - 1 + count] == spaces[1: 1 + count]
        at = np.flatnonzero(inside)
        yield at, buckets(hashes[at] + np.uint64(n), bits)
