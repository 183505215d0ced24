"""Content-defined blocks of window starts, the core that both window de-duplication operators share.

A window is ``width`` consecutive units (bytes, or words) of one document. Inside every window the unit n-gram with the
smallest hash, the first on ties, is its *anchor*; which one that is depends on the window's content alone, so equal
windows have equal anchors. Consecutive window starts with one anchor form a *block*: ``count`` windows from ``start``,
covering ``count + width - 1`` units. Every window of a document lies in exactly one block, and a block is a few dozen
windows long, so blocks stand for windows wherever whole blocks are equal.

Everything here is vectorised over a buffer of bounded size; blocks that the end of a buffer cuts in two are still
blocks (equal content is then found window by window instead of block by block).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Unit n-grams are compared by the upper 40 bits of their hash; the lower bits hold the place, which settles ties.
PLACE_BITS = 24
_PLACE = np.uint64((1 << PLACE_BITS) - 1)
#: Window starts handled at once; bounds a task's memory to some tens of MB.
CHUNK = 1 << 19

# Fixed odd multipliers of the hashes.
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0x165667B19E3779F9)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    values = values ^ (values >> np.uint64(32))
    values = values * _A
    return values ^ (values >> np.uint64(29))


class Blocks(NamedTuple):
    """Blocks of one stretch of units, in order; all arrays have one entry per block."""

    start: np.ndarray  # first window start
    count: np.ndarray  # number of window starts
    anchor: np.ndarray  # unit where the anchor n-gram begins
    key: np.ndarray  # signed 64-bit hash of the anchor n-gram


def byte_grams(buffer: np.ndarray, gram: int = 16) -> np.ndarray:
    """Hash of the ``gram`` (8 or 16) bytes from every position that has so many."""
    n = len(buffer) - 7
    if n <= 0:
        return np.empty(0, np.uint64)
    words = np.empty(n, np.uint64)
    for shift in range(min(8, n)):
        part = buffer[shift : shift + (n - shift + 7) // 8 * 8]
        words[shift::8] = np.frombuffer(part.tobytes(), "<u8")
    if gram == 8:
        return mix(words * _B)
    return mix(mix(words[:-8] * _B) + words[8:] * _C)


def word_grams(hashes: np.ndarray, gram: int = 8) -> np.ndarray:
    """Hash of ``gram`` (a power of two) consecutive words from their hashes, by doubling."""
    span = 1
    while span < gram:
        if len(hashes) <= span:
            return np.empty(0, np.uint64)
        hashes = mix(hashes[:-span] * _B + hashes[span:] * _C)
        span *= 2
    return hashes


def find_blocks(grams: np.ndarray, gram: int, width: int) -> Blocks:
    """Blocks of a stretch whose n-gram hashes are ``grams``; none if it is shorter than ``width`` units."""
    windows = len(grams) + gram - width
    if windows <= 0:
        empty = np.empty(0, np.int64)
        return Blocks(empty, empty, empty, empty)
    parts = []
    for begin in range(0, windows, CHUNK):
        size = min(CHUNK, windows - begin)
        local = grams[begin : begin + size + width - gram]
        packed = (local & ~_PLACE) | np.arange(len(local), dtype=np.uint64)
        held, span = packed, 1
        while span * 2 <= width - gram + 1:
            held = np.minimum(held[:-span], held[span:])
            span *= 2
        rest = width - gram + 1 - span
        if rest:
            held = np.minimum(held[:-rest], held[rest:])
        place = (held & _PLACE).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        count = np.diff(np.concatenate((first, [size])))
        anchor = place[first]
        parts.append((first + begin, count, anchor + begin, mix(local[anchor]).view(np.int64)))
    return Blocks(*(np.concatenate(column) for column in zip(*parts)))


def word_starts(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word in the bytes of words joined by single spaces."""
    if not len(joined):
        empty = np.empty(0, np.int64)
        return empty, empty
    spaces = np.flatnonzero(joined == 32)
    return np.concatenate(([0], spaces + 1)), np.concatenate((spaces, [len(joined)]))


def word_hashes(joined: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: the sum of its bytes, each scrambled with its place, and its length."""
    if not len(begin):
        return np.empty(0, np.uint64)
    place = np.arange(len(joined), dtype=np.uint64) - np.repeat(begin, np.diff(np.append(begin, len(joined)))).astype(np.uint64)
    scrambled = mix((joined.astype(np.uint64) + np.uint64(1)) * _C + place * _B)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scrambled, dtype=np.uint64)))
    return mix(total[end] - total[begin] + (end - begin).astype(np.uint64) * _A)
