"""Content-chosen anchors: every string of ``REACH`` bytes holds at least one.

The anchor of a ``REACH``-byte window is its ``GRAM``-byte gram with the smallest hash (the
leftmost of equal ones). Equal windows choose the same anchor at the same place, so only
windows around an anchor that occurs again can be repeats.
"""

from __future__ import annotations

import numpy as np
import xxhash

REACH = 100
GRAM = 32
BLOCK = 1 << 20
_PLACE = 21  # bits that hold a place inside a block

_MULT = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of each ``GRAM``-byte gram, doubled up from single bytes."""
    h = raw.astype(np.uint64) + np.uint64(1)
    for step, mult in zip((1, 2, 4, 8, 16), _MULT):
        h = h[:-step] * mult + h[step:]
        h ^= h >> np.uint64(29)
    return h * _MULT[0]


def _block(raw: bytes, at: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, windows, anchor hash) of runs with one anchor, starts in at..stop."""
    part = np.frombuffer(raw, np.uint8, stop - at + REACH - 1, at)
    h = gram_hashes(part)
    low = (h & ~np.uint64((1 << _PLACE) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, n = 1, REACH - GRAM + 1
    while width * 2 <= n:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < n:
        low = np.minimum(low[: len(low) - (n - width)], low[n - width :])
    place = (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    size = np.diff(np.append(first, len(place)))
    return first + at, size, h[place[first]], place[first] + at


def owned_windows(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (start, windows, anchor, content): runs of window starts that share an anchor.

    ``anchor`` is the hash of the anchor gram, ``content`` a hash of all bytes of the run
    and of the place of its anchor. A run never crosses a block of ``BLOCK`` starts; the
    cut is made by the place of the anchor, so equal windows keep equal anchors.
    """
    if len(raw) < REACH:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    parts = [
        _block(raw, at, min(at + BLOCK, len(raw) - REACH + 1))
        for at in range(0, len(raw) - REACH + 1, BLOCK)
    ]
    start, size, anchor, place = (np.concatenate(p) for p in zip(*parts))
    view = memoryview(raw)
    digest = xxhash.xxh3_64_intdigest
    content = np.array(
        [
            digest(view[s : s + n + REACH - 1], p)
            for s, n, p in zip(start.tolist(), size.tolist(), (place - start).tolist())
        ],
        np.uint64,
    )
    return start, size, anchor, content
