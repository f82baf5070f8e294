"""Words of many texts as flat numpy arrays.

A batch of texts is one UTF-8 buffer plus offsets, the layout Arrow already
uses, so finding words and hashing them takes a few vector passes over the
bytes and no Python object per word. Work goes in slices of ``SLICE`` bytes
cut at word ends: memory stays bounded however long one text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE = 2 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: space, tab, line feed, vertical tab, form feed, carriage return
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True

#: every ASCII character that is neither a letter nor a digit
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, kept at the longest length seen."""
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return cls.up, cls.down


def _hash_slice(b: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words in ``b`` and their hashes."""
    gap = gaps[b]
    edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return start, np.empty(0, dtype=np.uint64)
    up, down = _Powers.upto(len(b) + 1)
    total = np.empty(len(b) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[b] * up[:len(b)], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return start, mix(h + (end - start).astype(np.uint64))


def words(texts: pa.Array, gaps: np.ndarray = SPACES,
          lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, offsets)``: text ``i`` has words ``hashes[offsets[i]:offsets[i+1]]``.

    Words are runs of bytes outside ``gaps``; ``lower`` folds A-Z only. A null
    text has no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return np.empty(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = (np.frombuffer(texts.buffers()[2], dtype=np.uint8) if bounds[-1] > bounds[0]
            else np.empty(0, dtype=np.uint8))
    starts, hashes = [], []
    at, last = int(bounds[0]), int(bounds[-1])
    while at < last:
        stop = min(at + SLICE, last)
        if stop < last:
            # back to the end of a word or of a text, whichever is nearer
            back = np.flatnonzero(gaps[data[at:stop]])
            t = int(bounds[np.searchsorted(bounds, stop, side="right") - 1])
            cut = max(at + int(back[-1]) + 1 if len(back) else at, t)
            if cut > at:
                stop = cut
            else:  # one word longer than a slice: take it whole
                t = int(bounds[np.searchsorted(bounds, stop, side="left")])
                size = SLICE
                while True:
                    ahead = np.flatnonzero(gaps[data[stop:min(stop + size, t)]])
                    if len(ahead):
                        stop += int(ahead[0]) + 1
                        break
                    stop = min(stop + size, t)
                    if stop >= t:
                        break
        s, h = _slice_by_text(data[at:stop], at, bounds, gaps, lower)
        starts.append(s)
        hashes.append(h)
        at = stop
    start = np.concatenate(starts) if starts else np.empty(0, dtype=np.int64)
    offsets = np.searchsorted(start, bounds, side="left").astype(np.int64)
    return (np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)), offsets


def _slice_by_text(b, at, bounds, gaps, lower):
    """Words of one slice; a text's end also ends a word."""
    if lower:
        b = _LOWER[b]
    lo, hi = np.searchsorted(bounds, at, side="right"), np.searchsorted(bounds, at + len(b), side="left")
    inner = np.unique(bounds[lo:hi])
    if not len(inner):
        s, h = _hash_slice(b, gaps)
        return s + at, h
    # put a gap byte between texts, then take the shift out again
    sep = np.uint8(np.flatnonzero(gaps)[0])
    s, h = _hash_slice(np.insert(b, inner - at, sep), gaps)
    shift = np.searchsorted(inner - at + np.arange(len(inner)), s, side="left")
    return s - shift + at, h


def row_slices(texts: pa.Array, limit: int = 2 * SLICE):
    """``(first, array)`` of consecutive rows of about ``limit`` bytes at most,
    one row at least: working memory follows the slice, not the batch."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.array(pa.compute.binary_length(texts).fill_null(0), dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop


def windows(hashes: np.ndarray, offsets: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word windows that ``mask`` marks (1 counts, 0 is ignored):
    ``(hash, text, position)`` with the position counted in words of the text."""
    span = len(mask)
    n = np.diff(offsets)
    count = np.maximum(n - span + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = offsets[:-1][text] + pos
    h = np.zeros(len(first), dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit:
            h = (h ^ hashes[first + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return mix(h), text, pos
