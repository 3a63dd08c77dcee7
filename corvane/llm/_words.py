"""Word splitting and hashing over whole Arrow text columns, vectorised on UTF-8 bytes.

Words are maximal runs of the bytes a 256-entry mask marks.  A-Z are lower-cased first; every other
byte stays as it is, so a non-ASCII letter is never changed.  Memory follows PIECE, not the longest
text: long texts are cut between words and their hashes joined again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19  # bytes of text that are hashed at once

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: tuple[np.ndarray, np.ndarray] | None = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least n of each."""
    global _POWERS
    if _POWERS is not None and len(_POWERS[0]) >= n:
        return _POWERS
    made = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(max(n, PIECE + 1), x, dtype=np.uint64)
        p[0] = 1
        made.append(np.cumprod(p, dtype=np.uint64))
    if n <= PIECE + 1:  # the tables of a word that is longer than a piece are not kept
        _POWERS = (made[0], made[1])
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def _spans(data: np.ndarray, cuts: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of data; no word goes over a cut."""
    inside = mask[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = before[-1] = False
    before[1:-1] = inside[:-1]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.empty(len(data) + 1, dtype=bool)
    after[-1] = False
    after[:-1] = inside
    after[cuts] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends


def _cut(data: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Pieces of one long text, of about PIECE bytes, which end between words."""
    out, lo = [], 0
    while len(data) - lo > PIECE:
        hi = lo + PIECE
        free = np.flatnonzero(~mask[LOWER[data[lo:hi]]])
        if len(free):
            hi = lo + int(free[-1]) + 1
        else:  # one word is longer than a piece
            while hi < len(data):
                free = np.flatnonzero(~mask[LOWER[data[hi : hi + PIECE]]])
                hi += int(free[0]) if len(free) else min(PIECE, len(data) - hi)
                if len(free):
                    break
        out.append((lo, hi))
        lo = hi
    return [*out, (lo, len(data))]


def _hash_piece(data: np.ndarray, cuts: np.ndarray, mask: np.ndarray, stem: int) -> tuple[np.ndarray, ...]:
    data = LOWER[data]
    starts, ends = _spans(data, cuts, mask)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    back = down[starts]
    whole = mix((sums[ends] - sums[starts]) * back)
    if not stem:
        return starts, whole
    short = np.minimum(starts + stem, ends)
    return starts, whole, mix((sums[short] - sums[starts]) * back + np.uint64(stem))


def hashed_words(column: pa.Array, mask: np.ndarray, stem: int = 0) -> Iterator[tuple]:
    """Yields (first row, end row, word offsets by row, a 64-bit hash for each word) over runs of rows.

    stem: yields a fifth array, the hashes of the first `stem` bytes of each word.
    """
    data, at = text_bytes(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE, side="right")) - 1)
        part = data[at[lo] : at[hi]]
        cuts = at[lo : hi + 1] - at[lo]
        if len(part) > PIECE:
            made = [_hash_piece(part[a:b], np.zeros(0, np.int64), mask, stem) for a, b in _cut(part, mask)]
            whole = [np.concatenate([m[i] for m in made]) for i in range(1, 3 if stem else 2)]
            yield lo, hi, np.array([0, len(whole[0])]), *whole
        else:
            starts, *whole = _hash_piece(part, cuts, mask, stem)
            yield lo, hi, np.searchsorted(starts, cuts), *whole
        lo = hi


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; of a shorter text, one hash of the whole sequence."""
    if not len(words):
        return words
    n = min(width, len(words))
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + len(out)]
    return mix(out + np.uint64(n))
