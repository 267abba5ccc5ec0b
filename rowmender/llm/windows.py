"""Content-determined segments of a text, so that equal long strings meet in one bucket.

A text is read as UTF-8 bytes. Every string of ``length`` bytes (a *window*) gets a key:
the smallest hash of the ``gram``-byte strings inside it. The key depends on the content
of the window alone, so equal windows have equal keys wherever they stand. Consecutive
windows with one key form a *segment*; a text has about ``2 / (length - gram)`` segments
per byte.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers can be inverted
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(32)


class Powers:
    """Powers of the base and of its inverse, grown to the longest text seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            up, down = np.full(size, BASE), np.full(size, INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up[:n], self.down[:n]


def gram_hashes(data: bytes, gram: int, powers: Powers) -> np.ndarray:
    """A mixed 64-bit hash of each ``gram`` bytes."""
    codes = np.frombuffer(data, np.uint8).astype(np.uint64)
    up, down = powers.upto(len(codes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * up, dtype=np.uint64)])
    h = (total[gram:] - total[:-gram]) * down[: len(codes) - gram + 1]
    h ^= h >> SHIFT
    h *= MIX
    h ^= h >> SHIFT
    h *= MIX
    h ^= h >> SHIFT
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def segments(data: bytes, length: int, gram: int, most: int, powers: Powers) -> list[tuple[int, int, int, bool]]:
    """Key, first window, number of windows, and whether a window may recur inside, of each segment.

    A text below ``length`` bytes has none. Runs of periodic text are cut every ``most`` windows.
    """
    if len(data) < length:
        return []
    width = length - gram + 1
    grams = gram_hashes(data, gram, powers)
    low = sliding_min(grams, width)
    starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    counts = np.diff(np.append(starts, len(low)))
    if counts.max() > most:
        pieces = -(-counts // most)
        at = np.repeat(starts, pieces)
        step = np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        ends = np.repeat(starts + counts, pieces)
        starts = at + step * most
        counts = np.minimum(ends - starts, most)
    # the smallest gram stands twice among the windows of a segment that repeats inside
    keys = low[starts]
    out = []
    for key, signed, start, count in zip(keys, keys.view(np.int64).tolist(), starts.tolist(), counts.tolist()):
        twice = np.count_nonzero(grams[start : start + count + width - 1] == key) > 1
        out.append((signed, start, count, twice))
    return out
